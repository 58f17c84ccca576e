from collections import Counter

import corpus_pipeline
import pytest

from meritlens.llm.queries import oracle_sql, queries
from tests.llm.samples import prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Clean documents, toxic ones, poor ones and copies, with labels for the first 400."""
    rows, labels = [], []
    for i in range(480):
        text, toxic, quality = prose(i, 80), 0, 1
        if i % 8 == 1:
            words = text.split()
            for k, w in enumerate(["vilename", "rotword", "grimslur"]):
                words.insert(7 * k + i % 5, w)
            text, toxic = " ".join(words), 1
        elif i % 8 == 2:
            text, quality = " ".join(w.upper() + "!!" for w in text.split()), 0
        elif i % 8 == 3:
            text = prose(i - 3, 80)  # a copy of a clean document
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, quality, toxic))
    where = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels[:400], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def kept_ids(spark, folder, stages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:stages]:
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages(spark, folder):
    everyone = set(range(480))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]
    clean = kept_ids(spark, folder, 1)
    assert clean == {i for i in everyone if i % 8 != 1}
    good = kept_ids(spark, folder, 2)
    assert good == {i for i in clean if i % 8 != 2}
    single = kept_ids(spark, folder, 3)
    assert single == {i for i in good if i % 8 != 3}


def test_run_equals_its_stages(spark, folder):
    packed = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in packed.select("doc_id").distinct().collect()}
    assert ids == {i for i in range(480) if i % 8 not in (1, 2, 3)}
    pieces = packed.collect()
    total = sum(r.length for r in pieces)
    assert len({r.sequence_id for r in pieces}) == -(-total // 1024)


def test_every_operator_is_registered():
    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 11))
    assert set(oracle_sql()) <= set(names)


AWKWARD = [
    (None, None, None, None, None), (None, prose(5, 60), "en", "s", 1), (1, "", None, None, 0), (2, prose(2, 30000), "en", "s", 1),
    (2, prose(2, 30000), "en", "s", 1), (3, None, "en", None, 0), (4, prose(4, 60), None, "s", 2), (5, prose(4, 60), None, "s", 2),
    (6, prose(6, 60), "en", "s", 1), (6, prose(7, 60), "en", "s", 1),
]


def test_stages_take_awkward_tables(spark, folder):
    docs = spark.createDataFrame(AWKWARD, COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    good = Counter(r.text or "" for r in stages["quality"](spark, docs, folder).collect())
    every = Counter(t or "" for _, t, *_ in AWKWARD)
    assert good and all(n == every[t] for t, n in good.items())  # rows of one text share its fate
    single = stages["near_duplicates"](spark, docs, folder).collect()
    kept = sorted(((r.doc_id, r.text) for r in single if r.doc_id is not None), key=str)
    assert kept == sorted([(1, ""), (2, prose(2, 30000)), (4, prose(4, 60)), (6, prose(6, 60)), (6, prose(7, 60))], key=str)
    assert sum(r.doc_id is None for r in single) == 2
    pieces = stages["packing"](spark, docs, folder).collect()
    assert sum(r.start == 0 for r in pieces) == len(AWKWARD)
    assert sorted({r.doc_tokens for r in pieces if r.doc_id in (1, 3)}) == [1]


def test_stages_take_empty_tables_and_clashing_columns(spark, folder):
    empty = spark.createDataFrame([], COLUMNS)
    wide = spark.createDataFrame([(*r, 0.5, "x") for r in AWKWARD], COLUMNS + ", score double, node string")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0
        if name != "packing":
            assert stage(spark, wide, folder).columns == wide.columns
            assert {(r.score, r.node) for r in stage(spark, wide, folder).collect()} <= {(0.5, "x")}
