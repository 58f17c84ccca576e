"""URL filtering by host and path rules, then by mined association rules; DataFrame operations only.

A page that an explicit rule fits gets that rule's verdict (the longest rule wins).  For all other
pages Spark's FP-growth mines which combinations of URL tokens go with which label, from the labelled
ones among them: pages that an explicit rule judges say nothing about those it leaves.  Association
rules under the support or the confidence asked for are pruned, and so is a rule that says no more than
one with fewer tokens.  Pages are matched by an inverted index from each rule's rarest token, and a
rule holds if the page has all of its tokens.  The rule of most confidence, then support, then tokens
decides (block before allow in a tie); without one the page is allowed.

The index is small for any input: a token of a kept rule occurs in at least the minimum share of
the labelled pages.  Matching runs over distinct token combinations, not over pages.

Edge cases: a null url or one without "://" has an empty host and path and no tokens; a very long url
is parsed whole; repeated rows are judged alike; of several labels of one page block wins; without labels
nothing is mined; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meritlens.llm.common import discard, materialize

#: Least share of the labelled pages, and least pages, that hold a rule's tokens and verdict; least share
#: of the pages with its tokens that have its verdict.
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE = 0.01, 25, 0.7
#: Parts that pages of one token combination are dealt into when verdicts are joined to them.
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LABEL = "verdict="


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains and the paths that begin with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"

    def fits(self) -> Column:
        host = (F.col("host") == self.host) | F.col("host").endswith(f".{self.host}")
        return host & F.col("path").startswith(self.path)


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host (A-Z lowered) and path of the url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce("url", F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)).withColumn(
        "path", F.regexp_extract(url, pattern, 2)
    )


def by_rules(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``pages`` with ``rule`` and ``ruled``: the longest rule that fits and its verdict, or null."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        name = F.when(rule.fits(), rule.name).otherwise(name)
        verdict = F.when(rule.fits(), rule.verdict).otherwise(verdict)
    return pages.withColumn("rule", name).withColumn("ruled", verdict)


def tokens() -> Column:
    """Tokens of a url: domain, host labels, path segments (numbers as one), ending, query keys."""
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    query = F.split(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)\?([^#]*)", 1), "&")
    return F.array_distinct(
        F.concat(
            F.transform(F.slice(labels, -1, 1), lambda x: F.concat(F.lit("top="), x)),
            F.transform(labels, lambda x: F.concat(F.lit("host="), x)),
            F.transform(
                segments,
                lambda x: F.concat(
                    F.lit("path="), F.regexp_replace(F.regexp_replace(x, r"\.[A-Za-z0-9]{1,5}$", ""), "[0-9]+", "0")
                ),
            ),
            F.transform(
                F.filter(F.transform(segments, lambda x: F.regexp_extract(x, r"\.([A-Za-z0-9]{1,5})$", 1)), lambda x: x != ""),
                lambda x: F.concat(F.lit("ending="), x),
            ),
            F.transform(
                F.filter(F.transform(query, lambda x: F.substring_index(x, "=", 1)), lambda x: x != ""),
                lambda x: F.concat(F.lit("query="), x),
            ),
        )
    )


def mine(
    labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE, least: int = MIN_PAGES
) -> DataFrame:
    """(tokens, verdict, confidence, support) of the rules kept, from rows of (tokens, verdict).

    A rule's tokens and verdict must occur together in ``support`` of the rows and ``least`` rows."""
    items = labelled.select(
        F.concat(F.col("tokens"), F.array(F.concat(F.lit(LABEL), F.col("verdict")))).alias("items")
    ).where(F.size("items") > 1)
    spark = labelled.sparkSession
    items = materialize(spark, items, "urls-items")
    share = max(support, min(1.0, least / max(1, items.count())))
    model = FPGrowth(itemsCol="items", minSupport=share, minConfidence=confidence).fit(items)
    rules = (
        model.associationRules.where(F.element_at("consequent", 1).startswith(LABEL))
        .where(~F.exists("antecedent", lambda t: t.startswith(LABEL)))
        .select(
            F.sort_array("antecedent").alias("tokens"),
            F.substring(F.element_at("consequent", 1), len(LABEL) + 1, 100).alias("verdict"),
            "confidence",
            "support",
        )
    )
    rules = materialize(spark, rules, "urls-rules")
    discard(spark, items)
    shorter = rules.select(F.col("tokens").alias("s"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    # rules that share their first or any other token are compared through that token
    keyed = rules.withColumn("key", F.explode("tokens"))
    covered = (
        keyed.join(shorter.withColumn("key", F.element_at("s", 1)), "key")
        .where(
            (F.col("v") == F.col("verdict"))
            & (F.size("s") < F.size("tokens"))
            & (F.col("c") >= F.col("confidence"))
            & (F.size(F.array_except("s", "tokens")) == 0)
        )
        .select("tokens", "verdict")
        .distinct()
    )
    return rules.join(covered, ["tokens", "verdict"], "left_anti")


def by_mined(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``pages`` (with ``tokens``) with ``mined`` and ``confidence`` of the deciding rule."""
    kept = rules.select(
        F.concat_ws("\n", F.col("verdict"), F.col("tokens")).alias("id"), "tokens", "verdict", "confidence", "support"
    )
    # at most (tokens of a page) / (minimum support) different tokens
    known = kept.select(F.explode("tokens").alias("token")).agg(F.sort_array(F.collect_set("token")).alias("known")).first().known
    signed = pages.withColumn(
        "signature",
        F.array_join(F.sort_array(F.array_intersect("tokens", F.array(*map(F.lit, known)).cast("array<string>"))), "\n"),
    )
    signatures = signed.select("signature", F.split("signature", "\n").alias("held")).distinct()
    listed = signatures.select("signature", "held", F.explode("held").alias("token"))
    often = listed.groupBy("token").agg(F.count("*").alias("n"))
    # each rule under its rarest token, so that common ones lead nowhere
    index = kept.withColumn("token", F.explode("tokens")).join(often, "token", "left").groupBy("id").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"),
        *(F.first(c).alias(c) for c in ("tokens", "verdict", "confidence", "support")),
    )
    best = (
        listed.join(index.withColumn("token", F.col("rarest.token")).drop("rarest"), "token")
        .where(F.size(F.array_except("tokens", "held")) == 0)
        .groupBy("signature")
        .agg(F.max(F.struct("confidence", "support", F.size("tokens").alias("n"), F.col("verdict") == "block", "verdict")).alias("best"))
        .select("signature", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("confidence"))
    )
    # most pages share a few combinations, so each verdict goes to several places
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = signed.withColumn("salt", F.pmod(F.xxhash64("page_id", F.array_join("tokens", " ")), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, ["signature", "salt"], "left").drop("signature", "salt")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the mined rule's confidence.

    ``labels`` has (page_id, block boolean); those of pages that no explicit rule judges are mined."""
    own = by_rules(parts(pages.select("page_id", "url")), rules).withColumn("tokens", tokens())
    named = labels.where("block is not null").groupBy("page_id").agg(F.max("block").alias("block"))
    left = own.where("ruled is null").join(named, "page_id")
    mined = mine(left.select("tokens", F.when(F.col("block"), "block").otherwise("allow").alias("verdict")))
    matched = by_mined(own, mined)
    return matched.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", "mined", F.lit("allow")).alias("verdict"),
        F.when(F.col("ruled").isNull(), F.col("confidence")).alias("confidence"),
    )


def op3(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Pages judged; a labelled page of low quality or with toxic text counts as one to block."""
    known = labels.select(
        F.col("doc_id").alias("page_id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("block")
    )
    return judge(pages, known)
