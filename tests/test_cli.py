import csv
import json

from meritlens.__main__ import main
from meritlens.sources import readers


def embed(texts):
    return [[float(len(t)), 1.0] for t in texts]


def write_pool(tmp_path, n=12):
    path = tmp_path / "pool.jsonl"
    records = [{"candidate_id": f"c{i:02}", "profile": {"summary": "search and ranking " * (i % 3), "current_title": "Engineer", "years_of_experience": i}} for i in range(n)]
    path.write_text("\n".join(map(json.dumps, records)), encoding="utf-8")
    return str(path)


def test_rank_writes_a_csv(spark, tmp_path):
    out = str(tmp_path / "out.csv")
    main(["rank", "Search engineer.\nMust have search and ranking.", write_pool(tmp_path), out, "--top", "5"])
    with open(out, encoding="utf-8", newline="") as lines:
        rows = list(csv.DictReader(lines))
    assert [r["rank"] for r in rows] == list("12345")
    assert all(float(a["score"]) >= float(b["score"]) for a, b in zip(rows, rows[1:]))


def test_index_writes_unit_vectors(spark, tmp_path):
    main(["index", write_pool(tmp_path), str(tmp_path / "index"), "--embedder", "tests.test_cli:embed"])
    got = readers.read_index(spark, str(tmp_path / "index")).collect()
    assert len(got) == 12 and all(abs(sum(x * x for x in r.vec) - 1) < 1e-9 for r in got)
