import gzip
import hashlib
import json
import random
import re
import time

import pytest

from meritlens.plans import engine
from meritlens.sources import readers, records
from meritlens.sources import resume as rs
from meritlens.sources import resume_columns as rc
from meritlens.sources.schema import generated_id

RESUMES = {
    "paragraph": "Asha Rao\nPune, India\nI am a staff AI engineer with 8 years of experience in search. I built retrieval with Python, FAISS and Kafka for a marketplace.",
    "bullets": "John Doe\njohn@x.io\nSUMMARY\nBackend developer, 6 years.\nEXPERIENCE\nSenior Engineer at Acme (2019 - present)\n- built APIs with FastAPI\n"
    "Engineer at Beta (2016 - 2019)\n- kept services running\nSKILLS\nPython, Docker; AWS\nEDUCATION\nB.Tech, Some Institute 2016",
    "split": "Mira K\nEXPERIENCE\nData Engineer\nGamma Labs\n2018 - 2022\nbuilt pipelines in Spark and Kafka\nAnalyst\nDelta\n2016 - 2018\nreports\nSKILLS\nSQL, Kafka, Terraform, Redis",
    "pipes": "JANE ROE\nEXPERIENCE\nLEAD ARCHITECT | OMEGA | 2018-PRESENT\ndesigned systems\nTECHNICAL SKILLS: Java, AWS, Kubernetes",
    "terse": "Sam. ML engineer, 6 years, Bangalore. PyTorch.",
}


@pytest.mark.parametrize(
    ("name", "years", "n_skills", "n_jobs"),
    [("paragraph", (7, 9), 3, 1), ("bullets", (5, 12), 3, 2), ("split", (5, 16), 4, 2), ("pipes", (5, 12), 3, 1), ("terse", (5, 7), 1, 0)],
)
def test_messy_resumes(name, years, n_skills, n_jobs):
    got = rs.parse_resume(RESUMES[name])
    assert years[0] <= got["profile"]["years_of_experience"] <= years[1]
    assert len(got["skills"]) >= n_skills and len(got["career_history"]) >= n_jobs
    assert 0.2 <= got["_ingest"]["confidence"] <= 1.0
    assert "open_to_work_flag" not in got["signals"]


def test_resume_details():
    got = rs.parse_resume(RESUMES["bullets"])
    first, second = got["career_history"]
    assert (first["title"], first["company"], first["is_current"], first["start_date"]) == ("Senior Engineer", "Acme", True, "2019-01")
    assert second["duration_months"] == 36 and got["education"][0]["degree"] == "B.TECH"
    split = rs.parse_resume(RESUMES["split"])["career_history"]
    assert [j["company"] for j in split] == ["Gamma Labs", "Delta"]


RESUME_LINES = (
    "EXPERIENCE", "Work History:", "Skills", "Education :", "Summary", "Senior Engineer at Acme (2019 - present)", "Data Engineer", "Gamma Labs",
    "2018 - 2022", "- built x", "• y", "LEAD ARCHITECT | OMEGA | 2018-PRESENT", "Manager, Beta, 2010 to 2012", "", "  ", "\t  Staff ML engineer  ",
    "a b c d e f g h i j", "Technical Skills: Java, AWS, Kubernetes", "Python; c++, go | rust · x", "B.Tech, Some Institute 2016", "MSc 1999 Paris",
    "London, United Kingdom", "Pune", "x.y@z.io", "+91 98765 43210", "7.5 years in search", "ai", "full-stack developer", "2001 - 2003", "0 years",
    "Engineer @ X at Y, Z", "engineer at at b", "(2019 - 2020) Head at", "skills - scikit-learn, fine-tuning", "Ünïcode ÄRGER", "head,of , , x",
    "12 months", "Intern\u00a0at  Foo\u2003",
)


def test_resumes_in_columns_equal_single_ones(spark):
    rnd = random.Random(11)
    made = (rnd.choice(("\n", "\n", "\r\n", "\x0b", "\u2028")).join(rnd.choices(RESUME_LINES, k=rnd.randint(1, 24))) for _ in range(300))
    texts = [*RESUMES.values(), "x", " \n", "", "head\n\n\nfoo", *made]
    rows = [(i, t, "kept") for i, t in enumerate(texts)] + [(-1, None, "kept")]
    got = {r.id: r for r in rc.records(spark.createDataFrame(rows, "id int, value string, _name string")).collect()}
    assert set(got) == {i for i, t in enumerate(texts) if t.strip()}  # null and blank texts give none
    for i, row in got.items():
        assert row["_name"] == "kept" and row.record.asDict(recursive=True) == rs.parse_resume(texts[i]), texts[i]


def test_resume_parsing_is_linear(spark):
    """Long runs without a break, very many heads and headings."""
    runs = ["w" * 400_000, " " * 200_000 + "x", "x" + " \t" * 200_000 + "y", ":" * 300_000, "Engineer at A\n" * 20_000, "skills\nx\n" * 10_000, "1." * 200_000]
    started = time.monotonic()
    lines = rc.parse_resumes(spark.createDataFrame([(t,) for t in runs], "value string")).collect()
    assert len(lines) == len(runs) and time.monotonic() - started < 60
    assert len(json.loads(lines[4].value)["career_history"]) == 10


def test_resume_tables_start_no_python(spark, tmp_path):
    spark.range(3).selectExpr("'x' as value").write.parquet(str(tmp_path / "texts"))
    texts = spark.read.parquet(str(tmp_path / "texts"))
    plan = rc.parse_resumes(texts)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|MapIn|pythonUDF|Exchange", plan)
    assert plan.count("u0085") == 2  # lines are cut once, after one last line end is dropped
    assert rc.parse_resumes(texts.where("false")).count() == 0


def test_pasted_resumes(spark):
    pasted = "\n\n\n".join(RESUMES[k] for k in ("bullets", "split"))
    assert len(rs.split_pasted(pasted)) == 2 and len(rs.split_pasted("a\n\n\nb")) == 1
    assert readers.ingest(spark, pasted).count() == 2


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_forms(spark, tmp_path):
    a, b = ({"candidate_id": x, "profile": {"summary": x}} for x in "ab")
    array = write(tmp_path / "a.json", json.dumps([a, b, 5, None]))
    lines = write(tmp_path / "b.jsonl", json.dumps(a) + "\ngarbage\n\n" + json.dumps(b) + "\n")
    assert readers.ingest(spark, array).count() == readers.ingest(spark, lines).count() == 2
    assert readers.ingest(spark, json.dumps(a)).count() == 1 and readers.ingest(spark, a).first().candidate_id == "a"
    assert readers.ingest(spark, [a, b]).count() == 2
    table = write(tmp_path / "c.csv", "﻿Name,Title,Years,Skills,Other\nAnn,Cook,about 7.5 years,knives;sauces|stock,x\nBob,,,,\n")
    rows = {r.profile.anonymized_name: r for r in readers.ingest(spark, table).collect()}
    assert rows["Ann"].profile.years_of_experience == 7.5 and [s.name for s in rows["Ann"].skills] == ["knives", "sauces", "stock"]
    assert rows["Bob"].profile.years_of_experience == 0.0
    tabs = write(tmp_path / "c.tsv", "full_name\tcity\nCy\tPune\n")
    text = write(tmp_path / "r.txt", RESUMES["bullets"])
    assert readers.ingest(spark, [array, table, tabs, text]).count() == 6


def test_latin1_text(spark, tmp_path):
    path = tmp_path / "l.txt"
    path.write_bytes("José Peña\nengineer, 5 years of search".encode("latin-1"))
    assert readers.ingest(spark, str(path)).first().profile.anonymized_name == "José Peña"


def test_strict_reader(spark, tmp_path):
    good = json.dumps({"candidate_id": "a"})
    packed = tmp_path / "p.jsonl.gz"
    packed.write_bytes(gzip.compress((good + "\n\n" + good + "\n").encode()))
    assert readers.read_candidates(spark, str(packed)).count() == 2
    for bad in ("{broken", json.dumps({"name": "x"}), "[1]"):
        path = write(tmp_path / "bad.jsonl", good + "\n" + bad + "\n")
        with pytest.raises(Exception, match="not a candidate record"):
            readers.read_candidates(spark, path).collect()


def test_network_export(spark):
    export = {"profile": {"First Name": "A", "Last Name": "B", "Headline": "H"}, "positions": [{"Company Name": "C", "Title": "T", "Started On": "2020"}], "skills": [{"Name": "S"}]}
    got = readers.ingest(spark, export).first()
    assert got.profile.anonymized_name == "A B" and got.career_history[0].is_current and got.skills[0].name == "S"


def test_ids(spark):
    for seed in ("", "x|y", "é漢"):
        expected = "CAND_" + str(int(hashlib.sha256(seed.encode()).hexdigest(), 16) % 10**15).zfill(15)
        assert records.generated_id(seed) == expected
        df = spark.createDataFrame([(seed,)], "s string")
        assert df.select(generated_id(df.s).alias("i")).first().i == expected


def test_repair():
    got = records.normalized({"career_history": [{"title": "T", "company": "C", "duration_months": "30", "is_current": True}, "x"], "skills": None, "profile": 3})
    assert got["profile"] == {"years_of_experience": 2.5, "current_title": "T", "current_company": "C"}
    assert got["signals"] == {"profile_completeness_score": 52, "verified_email": False} and len(got["career_history"]) == 1
    assert [r["candidate_id"] for r in records.hardened([{"a": 1}, "x", None, {"candidate_id": 7}])] == ["CAND_0000000", "7"]


def test_registry_and_labels(spark, tmp_path):
    assert {"json", "csv", "text", "pdf", "docx", "network"} <= set(readers.list_adapters())
    assert readers.detect_format("x.CSV") == "csv" and readers.detect_format({"a": 1}) == "json" and readers.detect_format("free text\nmore") == "text"
    with pytest.raises(ValueError):
        readers.ingest(spark, "x", "unheard")
    labels = write(tmp_path / "labels.json", json.dumps({"a": {"grade": 5, "archetype": "strong"}}))
    assert tuple(readers.read_labels(spark, labels).first()) == ("a", 5, "strong")
    with pytest.raises(Exception):
        readers.read_index(spark, str(tmp_path / "none"))
    assert readers.read_index(spark, str(tmp_path / "none"), required=False) is None
    assert readers.pool_state(spark, labels) == readers.pool_state(spark, labels)


def test_rank_from_text(spark):
    result = engine.rank(spark, "Engineer.\nMust have python, kafka and retrieval.", [RESUMES["paragraph"], RESUMES["split"]], top_n=2)
    assert len(result.collect()) == 2


def test_signal_keys():
    from meritlens.sources.schema import SIGNAL_KEYS

    for key in SIGNAL_KEYS:
        got = records.normalized({key: {"verified_email": True}})
        assert got["signals"]["verified_email"] is True and [k for k in got if k in SIGNAL_KEYS] == ["signals"]
