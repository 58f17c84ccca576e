import gzip
import io
import json

import pytest

from meritlens.sources import datasource, readers

RESUME = "John Doe\njohn@x.io\nSUMMARY\nBackend developer, 6 years.\nEXPERIENCE\nSenior Engineer at Acme (2019 - present)\n- built APIs\nSKILLS\nPython, Docker"
EXPORT = {"profile": {"First Name": "A", "Last Name": "B"}, "positions": [{"Company Name": "C", "Title": "T", "Started On": "2020"}], "skills": [{"Name": "S"}]}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("mixed")
    (base / "deep").mkdir()
    many = "".join(json.dumps({"candidate_id": f"L{i}", "profile": {"summary": "é漢" * (i % 40)}}, ensure_ascii=False) + ("\r\n" if i % 3 else "\n\n") for i in range(500))
    (base / "many.jsonl").write_text(many, encoding="utf-8", newline="")
    (base / "deep" / "packed.ndjson.gz").write_bytes(gzip.compress(b'{"candidate_id": "z1"}\n{"candidate_id": "z2"}'))
    (base / "array.json").write_text(json.dumps([{"candidate_id": "a"}, 5, None, EXPORT]))
    (base / "lines.json").write_text('{"candidate_id": "p"}\ngarbage\n\n{"candidate_id": "q"}\n')
    (base / "blank.md").write_text(" \n")
    (base / "broken.json").write_text("{broken")
    (base / "people.CSV").write_text("﻿Name,Title,Years,Skills,Other\nAnn,Cook,about 7.5 years,knives;sauces|stock,x\n\"Bob\nby\",,,,\n", encoding="utf-8")
    (base / "deep" / "tabs.tsv").write_text("full_name\tcity\nCy\tPune\n")
    (base / "one.txt").write_text(RESUME)
    (base / "other.bin").write_bytes(b"\x00\x01")
    (base / "empty.csv").write_text("")
    (base / "_SUCCESS.json").write_text("{}")
    return str(base)


@pytest.fixture(scope="module")
def rows(spark, folder):
    datasource.register(spark)
    return spark.read.format("records").option("split", "700").load(folder)


def test_all_formats_in_one_table(rows):
    count = {r.format: r["count"] for r in rows.where("error is null").groupBy("format").count().collect()}
    assert count == {"jsonl": 500, "ndjson": 2, "json": 4, "csv": 2, "tsv": 1, "txt": 1}
    wrong = rows.where("error is not null").collect()
    assert [(r.path.rsplit("/", 1)[1], r.value) for r in wrong] == [("broken.json", None)] and "JSONDecodeError" in wrong[0].error


def test_splits_lose_and_repeat_no_line(spark, folder, rows):
    whole = [json.loads(r.value)["candidate_id"] for r in rows.where("format = 'jsonl'").collect()]
    assert sorted(whole) == sorted(f"L{i}" for i in range(500))
    assert rows.rdd.getNumPartitions() > 20
    data = b"ab\n\ncd\nefg"
    for split in range(1, len(data) + 2):
        got = [line for at in range(0, len(data), split) for line in datasource.lines_between(io.BytesIO(data), at, min(at + split, len(data)))]
        assert got == [b"ab\n", b"\n", b"cd\n", b"efg"]


def test_same_candidates_as_the_adapters(spark, folder):
    got = {r.profile.anonymized_name: r for r in datasource.read_folder(spark, f"{folder}/people.CSV").collect()}
    other = {r.profile.anonymized_name: r for r in readers.ingest(spark, f"{folder}/people.CSV").collect()}
    assert got.keys() == other.keys()
    for name, r in got.items():
        o = other[name]
        assert (r.candidate_id, r.profile.years_of_experience, [s.name for s in r.skills]) == (o.candidate_id, o.profile.years_of_experience, [s.name for s in o.skills])
    ids = lambda df: sorted(r.candidate_id for r in df.select("candidate_id").collect())
    for name in ("one.txt", "many.jsonl", "lines.json"):
        assert ids(datasource.read_folder(spark, f"{folder}/{name}")) == ids(readers.ingest(spark, f"{folder}/{name}"))
    assert "A B" in {r.profile.anonymized_name for r in datasource.read_folder(spark, f"{folder}/array.json").collect()}


def test_own_parsers_empty_and_missing_folders(spark, folder, tmp_path):
    def parse(text):
        yield {"candidate_id": f"own{len(text)}"}
        raise ValueError("the rest is damaged")

    datasource.register(spark, {"bin": parse})
    own = spark.read.format("records").load(folder).where("format = 'bin'").collect()
    assert [(r.value, r.error) for r in own] == [('{"candidate_id": "own2"}', None), (None, "ValueError: the rest is damaged")]
    assert datasource.read_folder(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="FileNotFoundError"):
        datasource.read_folder(spark, str(tmp_path / "none")).count()


def test_pieces():
    made = datasource.pieces_of([("b.jsonl", 25), ("a.CSV", 25), ("c.jsonl.gz", 25), ("d.exe", 5), ("e.csv", 0)], ["csv", "jsonl"], 10)
    assert [(p.path, p.kind, p.start, p.end) for p in made] == [("a.CSV", "csv", 0, 25), ("b.jsonl", "jsonl", 0, 10), ("b.jsonl", "jsonl", 10, 20), ("b.jsonl", "jsonl", 20, 25), ("c.jsonl.gz", "jsonl", 0, 25)]
