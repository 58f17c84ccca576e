from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from meritlens.llm import minhash, similar, simhash
from tests.llm.samples import awkward, documents, frame, prose


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def plain(sets):
    """Smallest id of each one's component, and the linked pairs, of all pairs that share a rare shingle."""
    counts = Counter(s for x in sets.values() for s in x)
    held, root, links = defaultdict(set), {i: i for i in sets}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        prefix = sorted(own, key=lambda s: (counts[s], s))[: len(own) - -(-4 * len(own) // 5) + 1] if own else []
        for j in {j for s in prefix for j in held[s]}:
            both = len(own & sets[j])
            if 100 * both >= 80 * (len(own) + len(sets[j]) - both):
                links.append((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in prefix:
            held[s].add(i)
    return {i: find(i) for i in sets}, links


def like(seed, base, changes):
    words = base.split()
    for i in changes:
        words[i] = f"changed{seed}x{i}"
    return " ".join(words)


def got(spark, texts):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.op13(spark, documents(spark, texts)).collect()}


def check(spark, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    expected, links = plain(sets)
    assert got(spark, texts) == {i: (len(s), expected[i], expected[i] == i) for i, s in sets.items()}
    return links


def edited_copies():
    rng, texts = np.random.default_rng(3), {}
    for g in range(12):
        texts[g * 100] = base = prose(1000 + g, 300)
        for k in range(1, 60 if g == 0 else 4):
            texts[g * 100 + k] = like(g * 100 + k, base, rng.choice(300, 5, replace=False))
    return texts | {5000 + i: prose(3000 + i, 200) for i in range(60)} | {9000: None, 9001: "", 9002: " ", 9003: "One  word", 9004: "one word"}


@pytest.mark.parametrize("small, pivots", [(16, 2), (2, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, small, pivots):
    """Also where nearly every bucket is crowded and its rows meet one pivot only."""
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "PIVOTS", pivots)
    monkeypatch.setattr(minhash, "CHUNK", 3)
    monkeypatch.setattr(minhash, "STREAM", 5)
    assert len(check(spark, edited_copies())) > 100


def test_many_pairs_near_the_threshold(spark):
    """1500 planted pairs of 0.80 to 0.85: none is missed, and pairs just under 0.8 are not linked."""
    texts = {}
    for g in range(1500):
        words = [f"w{g}x{i}" for i in range(103)]  # 100 shingles
        more = [f"m{g}x{i}" for i in range(17 + g % 9)]  # 100 of 117 to 125
        texts |= {10 * g: " ".join(words), 10 * g + 1: " ".join(words + more)}
    for g in range(1500, 1700):
        words = [f"w{g}x{i}" for i in range(103)]
        texts |= {10 * g: " ".join(words), 10 * g + 1: " ".join([*words, *(f"m{g}x{i}" for i in range(26))])}
    assert len(check(spark, texts)) == 1500


def test_pairs_that_share_a_passage(spark, monkeypatch):
    """Hundreds of texts share half of their words, so that buckets are crowded; near pairs among them are found."""
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash, "CHUNK", 40)
    monkeypatch.setattr(minhash, "STREAM", 64)
    passage, texts = prose(7, 100), {}
    for g in range(150):
        own = f"{passage} {prose(100 + g, 100)}"
        texts |= {10 * g: own} | ({10 * g + 1: like(g, own, [150, 170])} if g % 3 == 0 else {})
    assert len(check(spark, texts)) == 50


def test_large_group_of_copies(spark):
    texts = {i: prose(1) for i in range(300)} | {1000 + i: prose(100 + i) for i in range(20)}
    check(spark, texts)


def test_awkward_rows(spark):
    rows = minhash.op13(spark, frame(spark)).collect()
    assert len(rows) == len(awkward())
    by = {r.doc_id: r for r in rows}
    for i in (0, 1, 2):
        assert tuple(by[i]) == (i, 0, i, True)
    assert (by[3].n_shingles, by[9].n_shingles) == (1, 1)
    assert by[6].component_id == 5 and not by[6].kept and by[5].kept
    assert [tuple(r)[2:] for r in rows if r.doc_id == 7] == [(7, True)] * 2
    assert tuple(by[None])[2:] == (None, True)
    copies = spark.createDataFrame([(None, prose(1)), (4, prose(1)), (9, prose(1))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id, r.kept) for r in minhash.op13(spark, copies).collect()} == {(None, 4, False), (4, 4, True), (9, 4, False)}
    assert minhash.op13(spark, frame(spark, [])).count() == 0


def test_sketches_fill_and_agree():
    """Every bin is filled for any size, and bins agree as often as sets are similar."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 400, 70_000):
        hashes = rng.integers(0, 1 << 63, n).astype("<u8")
        least = {}
        for r in range(2 * minhash.COORDINATES):  # the definition, a round at a time
            bins, values = minhash.throws(hashes, np.array([r], dtype=np.uint64))
            for b, v in zip(bins[0].tolist(), values[0].tolist()):
                least[b] = min(v, least.get(b, v))
            if len(least) == minhash.COORDINATES:
                break
        assert len(least) == minhash.COORDINATES
        assert minhash.sketch(hashes).tolist() == [least[b] & 0xFFFF for b in range(minhash.COORDINATES)]
    shares = []
    for k in range(300):
        common, apart = rng.integers(0, 1 << 63, 80).astype("<u8"), rng.integers(0, 1 << 63, (2, 10)).astype("<u8")
        a, b = (minhash.sketch(np.concatenate([common, x])) for x in apart)
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01
    assert np.std(shares) < 1.1 * (0.8 * 0.2 / minhash.COORDINATES) ** 0.5


def test_agreement_in_columns(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (20, minhash.COORDINATES)).astype("<u2")
    b = np.where(rng.random(a.shape) < 0.5, a, a ^ 1)
    rows = [(x.view("<i8").tolist(), y.view("<i8").tolist()) for x, y in zip(a, b)]
    found = spark.createDataFrame(rows, "a array<long>, b array<long>").select(minhash.agreeing("a", "b").alias("n")).collect()
    assert [r.n for r in found] == (a == b).sum(axis=1).tolist()


def test_recall_on_the_documents_table(spark):
    folder = "/root/testdata/sf0.1"
    if not Path(f"{folder}/documents.parquet").exists():
        pytest.skip("the generated tables are not here")
    read = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    sets = {i: shingles(t) for i, t in zip(read["doc_id"], read["text"])}
    expected, links = plain(sets)
    rows = minhash.op13(spark, spark.read.parquet(f"{folder}/documents.parquet")).collect()
    assert links and {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == {i: (len(s), expected[i]) for i, s in sets.items()}


def test_words_are_ascii_words():
    assert simhash.words_of("A\xa0b \x0bC\x1cd É") == ["a\xa0b".encode(), b"c\x1cd", "É".encode()]
    assert similar.Block in minhash.Block.__mro__
