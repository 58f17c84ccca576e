import json

from pyspark.sql import functions as F

from meritlens.plans import engine
from meritlens.sources import records, repair

LINES = [
    json.dumps({"candidate_id": "a", "career_history": [{"title": "T", "company": "C", "duration_months": "30", "is_current": True}, "x"], "skills": None, "profile": 3}),
    json.dumps({"candidate_id": 7, "profile": {"years_of_experience": 4.5, "current_title": "Cook"}, "signals": {"verified_email": True, "open_to_work_flag": False}}),
    json.dumps({"career_history": [{"duration_months": 2.9}, {"title": "Now", "company": "N", "is_current": True, "duration_months": 1}], "skills": ["Go", {"name": "SQL"}, 5]}),
    json.dumps({"candidate_id": "q", "profile": {"current_company": "Own", "years_of_experience": 0}, "career_history": [{"title": "A", "company": "B", "duration_months": 27}]}),
    "{}", "", "  \t", None, "{broken", "[1]", "5", "null", '"text"',
]


def rows_of(spark, lines=LINES, **more):
    df = spark.createDataFrame([(i, v, "z") for i, v in enumerate(lines)], "pos int, value string, candidate_id string")
    return repair.repaired(df, **more)


def test_every_line_gives_one_row(spark):
    rows = rows_of(spark, position="pos")
    assert rows.count() == len(LINES)
    kinds = [(r.source, r.kind, r.detail) for r in repair.rejected(rows).collect()]
    assert sorted(kinds, key=str) == sorted([
        ("", "blank", None), ("  \t", "blank", None), (None, "blank", None), ("{broken", "not_json", "{broken"), ("[1]", "not_object", "array"),
        ("5", "not_object", "bigint"), ("null", "not_object", "void"), ('"text"', "not_object", "string"),
    ], key=str)
    assert rows.where("error is not null and (candidate_id is not null or profile is not null or size(fixes) > 0)").count() == 0
    assert repair.rejected(rows_of(spark, [])).count() == repair.accepted(rows_of(spark, [])).count() == 0


def test_repairs(spark):
    got = {r.source: r for r in rows_of(spark, position="pos").where("error is null").collect()}
    first, second, third, fourth, empty = (got[x] for x in LINES[:5])
    assert (first.profile.years_of_experience, first.profile.current_title, first.profile.current_company) == (2.5, "T", "C")
    assert first.signals == {"profile_completeness_score": "52", "verified_email": "false"} and len(first.career_history) == 1
    assert first.fixes == ["profile", "education", "skills", "signals", "jobs", "years", "title", "company", "completeness", "verified"]
    assert second.candidate_id == "7" and second.profile.years_of_experience == 4.5 and second.signals["open_to_work_flag"] == "false"
    assert second.signals["verified_email"] == "true" and second.signals["profile_completeness_score"] == "36"
    # the open-to-work flag is never filled in
    assert "open_to_work_flag" not in third.signals and third.candidate_id == "CAND_0000002"
    assert (third.profile.current_title, third.profile.current_company) == ("Now", "N")
    assert third.profile.years_of_experience == 0.2  # 3 months: a quarter goes to the even digit
    assert [s.name for s in third.skills if s.name] == ["Go", "SQL"]
    assert fourth.profile.current_company == "Own" and fourth.profile.current_title == "A" and fourth.profile.years_of_experience == 2.2
    assert empty.candidate_id == "CAND_0000004" and empty.signals["profile_completeness_score"] == "20" and empty.profile.years_of_experience is None


def test_equals_the_repair_of_dicts(spark):
    """What the repair of single dicts derives, the columns derive too."""
    for line in LINES[:5]:
        plain = records.normalized(json.loads(line))
        row = rows_of(spark, [line], position="pos").first()
        for key in ("years_of_experience", "current_title", "current_company"):
            assert (row.profile[key] or None) == (plain["profile"].get(key) or None)
        assert float(row.signals["profile_completeness_score"]) == plain["signals"]["profile_completeness_score"]
        assert len(row.career_history) == len(plain["career_history"])


def test_ids_by_content_and_ranking(spark):
    rows = rows_of(spark, ['{"profile": {"summary": "search"}}'] * 2 + ['{"profile": {"summary": "python"}}'])
    ids = [r.candidate_id for r in rows.collect()]
    assert len(set(ids)) == 2 and all(i.startswith("CAND_") and len(i) == 20 for i in ids)
    assert len(engine.rank(spark, "Engineer.\nMust have python and search.", repair.accepted(rows), top_n=3, engine="spine").collect()) == 3


def test_no_python_worker(spark):
    plan = rows_of(spark).select("candidate_id", "error", F.size("fixes"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
