"""Free-text resumes to records in column expressions, without Python workers.

A text becomes an array of lines; headings cut it into sections.  Each line of the career becomes two letters
(:func:`letters`), one regular expression finds the jobs on the string of letters, and the first ten of them are
looked up by their place in it.  Rules, patterns and results are those of :func:`resume.parse_resume`, which serves
readers that hold a text already; here the separator U+001F is no white space and only ASCII digits make numbers.

Every pattern is linear in the text: no run of white space, colons or word characters is scanned from each of its places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.functions.dates import AS_OF
from meritlens.functions.text import strings
from meritlens.sources import resume as rs
from meritlens.sources.schema import generated_id

LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085\u2028\u2029]"
MOST_JOBS, MOST_SCHOOLS, MOST_SKILLS = 10, 5, 30


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also where lambdas inside the body name it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uni(pattern: str, caseless: bool = False) -> str:
    """The pattern with character classes over all of Unicode."""
    return f"(?{'i' if caseless else ''}U){pattern}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, uni(r"^\s+|(?<!\s)\s+$"), "")


def has(c: Column, pattern: str, caseless: bool = False) -> Column:
    return F.regexp_like(c, F.lit(uni(pattern, caseless)))


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """What the first match of a caseless pattern holds, empty without one."""
    return F.regexp_extract(c, uni(pattern, caseless=True), group)


def words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(uni(r"\S+")))


def first(c: Column) -> Column:
    """The first element of an array of strings, empty without one."""
    return F.coalesce(F.get(c, F.lit(0)), F.lit(""))


# Lines and sections.


def heading(line: Column) -> Column:
    """The section that a line of up to three words names, else null."""
    low = strip(F.regexp_replace(F.lower(line), "(?<!:):+$", ""))
    name = F.lit(None).cast("string")
    for section, pattern in reversed(rs.SECTIONS.items()):
        name = F.when(has(low, rf"^{pattern}\b\z"), section).otherwise(name)
    # most lines begin with no section word, which is told without reading them
    return F.when(has(line, rf"^(?:{'|'.join(rs.SECTIONS.values())})\b", True) & (words(line) <= 3), name)


def lines_of(text: Column) -> Column:
    """All lines, blank ones too: struct(raw without white space at its end, text, heading)."""
    ended = F.regexp_replace(text, rf"(?:{LINE_END})\z", "")
    raws = F.transform(F.split(ended, LINE_END), lambda x: F.regexp_replace(x, uni(r"(?<!\s)\s+$"), ""))
    both = F.transform(raws, lambda x: F.struct(x.alias("raw"), strip(x).alias("text")))
    return F.transform(both, lambda x: F.struct(x["raw"].alias("raw"), x["text"].alias("text"), heading(x["text"]).alias("heading")))


def sections(every: Column) -> Column:
    """struct of the lines under each section's headings, in order; what stands before any heading is summary."""

    def cut(every: Column, heads: Column) -> Column:
        def under(name: str) -> Column:
            def own(head: Column, k: Column) -> Column:
                end = F.coalesce(F.get(heads, k + 1)["at"], F.size(every) + 1)
                return F.when(head["name"] == name, F.slice(every, head["at"] + 1, end - head["at"] - 1))

            return F.flatten(F.array_compact(F.transform(heads, own)))

        return F.struct(*(under(name).alias(name) for name in rs.SECTIONS))

    def heads(every: Column) -> Column:
        placed = F.transform(every, lambda x, i: F.struct((i + 1).alias("at"), x["heading"].alias("name")))
        start = F.array(F.struct(F.lit(0).alias("at"), F.lit("summary").alias("name")))
        return F.concat(start, F.filter(placed, lambda h: h["name"].isNotNull()))

    return held(every, lambda e: held(heads(e), lambda h: cut(e, h)))


def told(lines: Column) -> Column:
    """The lines that are not blank, as texts."""
    return F.filter(F.transform(lines, lambda x: x["text"]), lambda x: x != "")


def joined(lines: Column) -> Column:
    return F.array_join(F.transform(lines, lambda x: x["raw"]), " ")


# Jobs.


def span_of(line: Column) -> Column:
    """The dates that a line names, empty without."""
    century = F.contains(line, F.lit("19")) | F.contains(line, F.lit("20"))
    return F.when(century, found(line, rs.DATES.pattern)).otherwise("")


def pieces(line: Column, span: Column) -> Column:
    """What a head holds beside its dates: title, company and more."""
    bare = F.btrim(F.regexp_replace(F.when(span != "", F.replace(line, span, F.lit(" "))).otherwise(line), "[()]", " "), F.lit(" ,-|"))
    return held(bare, lambda b: F.struct(b.alias("bare"), F.filter(F.transform(F.split(b, uni(rs.CUT)), strip), lambda x: x != "").alias("parts")))


def letters(line: Column) -> Column:
    """Two letters of a line: what it lacks as a job's head, and what it could add to the head before it."""

    def told_by(d: Column) -> Column:
        start, dated = F.left(line, F.lit(1)), d["span"] != ""
        # a title word matters in short lines and in those with bars
        titled = ((d["words"] <= 8) | F.contains(line, F.lit("|"))) & has(line, rs.TITLE_WORD.pattern, True)
        opens = ~start.isin(*"-•·*") & (dated | titled | has(line, rs.AT.pattern))
        named = F.size(pieces(line, d["span"])["parts"]) > 1
        lacks = F.when(~opens, rs.NO_HEAD).when(named, F.when(dated, rs.NOTHING).otherwise(rs.SPAN)).otherwise(F.when(dated, rs.COMPANY).otherwise(rs.BOTH))
        adds = F.when(d["words"] > 4, rs.OTHER).when(dated, rs.WHEN).when(start.isin(*"-•") | titled, rs.OTHER).otherwise(rs.NAME)
        return F.concat(lacks, adds)

    return held(F.struct(span_of(line).alias("span"), words(line).alias("words")), told_by)


def marks(lines: Column) -> Column:
    """The letters of all lines in one string."""
    return F.array_join(F.transform(lines, letters), "")


def job(title: Column, company: Column, span: Column, body: Column) -> Column:
    """A job of the record; a span without an end is the present one."""
    start = found(span, rs.DATES.pattern, 1)
    end = F.regexp_extract(found(span, rs.DATES.pattern, 2), r"^\d{4}$", 0)
    last = F.when(end == "", 12 * AS_OF.year + AS_OF.month).otherwise(12 * end.try_cast("int") + 1)
    months = F.greatest(F.lit(0), last - (12 * start.try_cast("int") + 1))
    return F.struct(
        F.left(strip(title), F.lit(60)).alias("title"), F.left(strip(company), F.lit(60)).alias("company"),
        F.left(strip(body), F.lit(800)).alias("description"), F.when(start == "", "").otherwise(F.concat(start, F.lit("-01"))).alias("start_date"),
        F.when(end != "", F.concat(end, F.lit("-01"))).alias("end_date"), ((start != "") & (end == "")).alias("is_current"),
        F.coalesce(F.when(start != "", months), F.lit(0)).alias("duration_months"), F.lit("").alias("industry"), F.lit("51-200").alias("company_size"),
    )


def jobs(lines: Column) -> Column:
    """The first ten jobs that the lines tell of."""

    def at(lines: Column, m: Column) -> Column:
        def one(k: Column) -> Column:
            start = F.length(m["before"]) + F.length(F.array_join(F.slice(m["all"], 1, k), ""))
            return F.struct((start / 2).cast("int").alias("at"), F.get(m["heads"], k).alias("head"), F.get(m["all"], k).alias("all"))

        def made(x: Column) -> Column:
            line, gives = F.get(lines, x["at"]), lambda i: F.substring(x["head"], 2 * i + 2, 1)
            span = span_of(line)
            end = (F.length(x["head"]) / 2).cast("int")
            body = F.array_join(F.slice(lines, x["at"] + end + 1, (F.length(x["all"]) / 2).cast("int") - end), " ")

            def from_next(kind: str, own: Column) -> Column:
                return F.when(own != "", own).when(gives(1) == kind, F.get(lines, x["at"] + 1)).when(gives(2) == kind, F.get(lines, x["at"] + 2)).otherwise("")

            own = held(pieces(line, span), lambda p: F.struct(
                F.coalesce(F.get(p["parts"], F.lit(0)), p["bare"]).alias("title"), F.coalesce(F.get(p["parts"], F.lit(1)), F.lit("")).alias("company"), span.alias("span")))
            return held(own, lambda o: job(o["title"], from_next(rs.NAME, o["company"]), from_next(rs.WHEN, o["span"]), body))

        return F.transform(F.transform(F.sequence(F.lit(1), F.least(F.size(m["all"]), F.lit(MOST_JOBS))), lambda k: one(k - 1)), made)

    def matched(text: Column) -> Column:
        return F.struct(
            F.regexp_extract(text, f"^(?:{rs.NO_HEAD}.)*+", 0).alias("before"), F.regexp_extract_all(text, F.lit(rs.JOBS.pattern), 0).alias("all"),
            F.regexp_extract_all(text, F.lit(rs.JOBS.pattern), 1).alias("heads"),
        )

    none = F.slice(F.array(job(F.lit(""), F.lit(""), F.lit(""), F.lit(""))), 1, 0)
    return held(lines, lambda ls: held(held(marks(ls), matched), lambda m: F.when(F.size(m["all"]) > 0, at(ls, m)).otherwise(none)))


# Skills, schools, names and places.


def skills(listed: Column, text: Column) -> Column:
    """The first thirty distinct skill names: the section's, those of lists in the text, known names anywhere."""
    inline = F.regexp_extract_all(text, F.lit(f"(?id){uni(rs.SKILL_LIST)}"), F.lit(1))
    near = lambda k: rf"(?<![a-z0-9])\Q{k}\E(?![a-z0-9])"
    known = held(F.lower(text), lambda low: F.array_compact(F.array(*(
        F.when(F.contains(low, F.lit(k)) & F.regexp_like(low, F.lit(near(k))), rs.shown(k)) for k in rs.KNOWN_SKILLS))))
    split = F.flatten(F.transform(F.concat(F.array(listed), inline), lambda part: F.split(part, r"[,;|•·\n]+")))
    names = F.transform(F.concat(split, known), lambda x: F.btrim(x, F.lit(" .-•·|")))
    kept = F.filter(names, lambda x: F.length(x).between(2, 30) & ~F.startswith(F.lower(x), F.lit("skill")))

    def distinct(names: Column) -> Column:
        return held(F.transform(names, F.lower), lambda low: F.transform(
            F.slice(F.array_distinct(low), 1, MOST_SKILLS), lambda x: strip(F.get(names, (F.array_position(low, x) - 1).cast("int")))))

    return held(kept, distinct)


def school(line: Column) -> Column:
    low, year = F.lower(line), F.regexp_extract(line, r"(?:19|20)\d{2}", 0).try_cast("int")
    degree = first(F.filter(strings(rs.DEGREES), lambda d: F.contains(low, d)))
    return F.struct(
        F.left(line, F.lit(80)).alias("institution"), F.upper(degree).alias("degree"), F.lit("").alias("field_of_study"),
        (year - 4).alias("start_year"), year.alias("end_year"), F.lit("unknown").alias("tier"),
    )


def personal(line: Column) -> Column:
    """A line that may be a name: short, no address, no number, no heading."""
    headed = "|".join(rs.SECTIONS.values())
    return (words(line) <= 6) & ~has(line, rs.EMAIL.pattern) & ~has(line, rs.PHONE.pattern) & ~has(F.lower(line), rf"^(?:{headed})\b")


def place(line: Column) -> Column:
    """City and country that a line names; null without either."""

    def named(places) -> Column:
        return first(F.array_compact(F.array(*(F.when(has(line, rf"\b{p}\b"), p) for p in places))))

    return held(F.struct(named(rs.CITIES).alias("city"), named(rs.COUNTRIES).alias("country")), lambda p: F.when(
        (p["city"] != "") | (p["country"] != ""),
        F.struct(
            F.when(p["city"] != "", p["city"]).otherwise(p["country"]).alias("city"),
            F.when(p["country"] != "", p["country"]).when(p["city"].isin(*rs.HOME_CITIES), "India").otherwise("").alias("country"),
        )))


def title_in(text: Column) -> Column:
    """The first title that the text names."""
    title = F.regexp_replace(strip(found(text, rs.TITLE.pattern)), uni(r"\s+"), " ")
    return held(title, lambda t: F.when(t == F.lower(t), F.replace(F.initcap(t), F.lit("Full-stack"), F.lit("Full-Stack"))).otherwise(t))


# Records.


def described(texts: DataFrame, text: str) -> DataFrame:
    """Each input row as ``_row``, its ``_text``, ``_every`` line, ``_under`` each section and the ``_lines`` of the career."""
    cut = texts.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))
    cut = cut.withColumn("_every", lines_of(F.col("_text"))).withColumn("_under", sections(F.col("_every")))
    own = F.col("_under.experience")
    return cut.withColumn("_lines", told(F.when(F.size(own) > 0, own).otherwise(F.col("_every"))))


def records(texts: DataFrame, text: str = "value") -> DataFrame:
    """All columns of ``texts`` and the ``record`` of each resume; null and blank texts give no row."""
    at = described(texts.where(strip(F.coalesce(F.col(text), F.lit(""))) != ""), text)
    value, lines = F.col("_text"), told(F.col("_every"))
    rows = (
        at.withColumn("_told", lines)
        .withColumn("_career", jobs(F.col("_lines")))
        .withColumn("_name", first(F.filter(F.slice("_told", 1, 5), personal)))
        .withColumn("_place", F.get(F.array_compact(F.transform(F.slice("_told", 1, 6), place)), F.lit(0)))
        .withColumn("_own", F.left(strip(joined(F.col("_under.summary"))), F.lit(1000)))
        .withColumn("_lead", joined(F.slice(F.filter("_every", lambda x: x["text"] != ""), 2, 3)))
        .withColumn("_summary", F.when(F.col("_own") != "", F.col("_own")).otherwise(F.left("_lead", F.lit(600))))
        .withColumn("_skills", skills(joined(F.col("_under.skills")), value))
        .withColumn("_education", F.transform(F.slice(told(F.col("_under.education")), 1, MOST_SCHOOLS), school))
        .withColumn("_stated", F.coalesce(found(value, rs.YEARS.pattern, 1).try_cast("double"), F.lit(0.0)))
        .withColumn("_months", F.aggregate("_career", F.lit(0), lambda a, j: a + j["duration_months"]))
        .withColumn("_years", F.when(F.col("_stated") != 0, F.col("_stated")).otherwise(F.bround(F.col("_months") / 12, 1)))
        .withColumn("_first", F.coalesce(F.get("_career", F.lit(0))["title"], F.lit("")))
        .withColumn("_title", F.when(F.col("_first") != "", F.col("_first")).otherwise(title_in(value)))
    )
    # a role without jobs is the one that the summary tells of
    body = F.when(F.col("_summary") != "", F.col("_summary")).otherwise(value)
    sole = job(F.col("_title"), F.lit(""), F.lit(""), body).withField("is_current", F.lit(True)).withField("duration_months", (F.col("_years") * 12).cast("int"))
    rows = rows.withColumn("_career", F.when((F.size("_career") == 0) & (F.col("_title") != ""), F.array(sole)).otherwise(F.col("_career")))
    career, title, summary = F.col("_career"), F.col("_title"), F.col("_summary")
    company = F.coalesce(F.get(career, F.lit(0))["company"], F.lit(""))
    now = F.coalesce(F.get(F.filter(career, lambda j: j["is_current"]), F.lit(0)), F.get(career, F.lit(0)))
    late = (title == "") & (F.size(career) > 0)
    seed = F.concat_ws(
        "|", "_name", summary, company, title, F.array_join("_skills", " "),
        F.array_join(F.transform(career, lambda j: F.concat(j["title"], F.lit("@"), j["company"])), "|"), F.left(value, F.lit(500)),
    )
    known = lambda *cs: sum((c.cast("int") for c in cs), F.lit(0))
    location, shown_title = F.coalesce(F.col("_place.city"), F.lit("")), F.when(late, now["title"]).otherwise(title)
    complete = 20 + 16 * known(summary != "", shown_title != "", location != "", F.size(career) > 0, F.size("_skills") > 0)
    found_out = known(F.col("_name") != "", summary != "", F.size(career) > 0, F.size("_skills") > 0, F.col("_years") != 0)
    record = F.struct(
        generated_id(seed).alias("candidate_id"),
        F.struct(
            F.when(F.col("_name") == "", "Candidate").otherwise(F.col("_name")).alias("anonymized_name"), title.alias("headline"), summary.alias("summary"),
            location.alias("location"), F.coalesce(F.col("_place.country"), F.lit("")).alias("country"), F.col("_years").alias("years_of_experience"),
            shown_title.alias("current_title"), F.when(late & (company == ""), now["company"]).otherwise(company).alias("current_company"),
            F.lit("51-200").alias("current_company_size"), F.lit("").alias("current_industry"),
        ).alias("profile"),
        career.alias("career_history"), F.col("_education").alias("education"),
        F.transform("_skills", lambda s: F.struct(
            s.alias("name"), F.lit("intermediate").alias("proficiency"), F.lit(0).alias("endorsements"), F.lit(12).alias("duration_months"))).alias("skills"),
        F.struct(complete.alias("profile_completeness_score"), F.lit(False).alias("verified_email")).alias("signals"),
        F.struct(F.lit("resume:local").alias("source"), F.round(0.2 + 0.16 * found_out, 3).alias("confidence")).alias("_ingest"),
    )
    # in one select with the input's columns, names inside lambdas could be taken for aliases of those
    return rows.select("_row", record.alias("record")).select("_row.*", "record")


def parse_resumes(texts: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of records from a column of resumes; null and blank texts give none.

    The explode of one line keeps readers, which take many fields and filters from it, from working it out for each."""
    line = F.to_json("record", {"ignoreNullFields": "false"})
    return records(texts.select(F.col(column).alias("value"))).select(F.explode(F.array(line)).alias("value"))
