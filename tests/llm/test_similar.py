from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from meritlens.llm import similar, simhash
from tests.llm.samples import documents, frame, prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_groups(sets, similarity=0.8):
    """Smallest id of each one's component, and the linked pairs, by comparing all pairs that share a rare shingle."""
    counts = Counter(s for x in sets.values() for s in x)
    held, root, links = defaultdict(set), {i: i for i in sets}, []

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in sets.items():
        prefix = sorted(own, key=lambda s: (counts[s], s))[: len(own) - int(np.ceil(similarity * len(own))) + 1]
        for j in {j for s in prefix for j in held[s]} if own else {j for j in held[()]}:
            if jaccard(own, sets[j]) >= similarity:
                links.append((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in prefix if own else [()]:
            held[s].add(i)
    return {i: find(i) for i in sets}, links


def like(seed, base, changes):
    """``base`` with the words at ``changes`` replaced."""
    words = base.split()
    for i in changes:
        words[i] = f"changed{seed}x{i}"
    return " ".join(words)


def groups_of(spark, texts):
    return {r.doc_id: r.component_id for r in similar.similar_groups(spark, documents(spark, texts)).collect()}


def edited_copies():
    """Groups of copies with about 1.5 % of the words changed, other texts, texts without words."""
    rng, texts = np.random.default_rng(3), {}
    for g in range(12):
        texts[g * 100] = base = prose(1000 + g, 300)
        for k in range(1, 40 if g == 0 else 4):
            texts[g * 100 + k] = like(g * 100 + k, base, rng.choice(300, 4, replace=False))
    return texts | {5000 + i: prose(3000 + i, 200) for i in range(60)} | {9000: None, 9001: "", 9002: " "}


@pytest.mark.parametrize("small, pivots", [(32, 2), (2, 1)])
def test_groups_equal_brute_force(spark, monkeypatch, small, pivots):
    """Also where nearly every bucket is crowded and its rows meet one pivot only."""
    monkeypatch.setattr(similar, "SMALL", small)
    monkeypatch.setattr(similar, "PIVOTS", pivots)
    monkeypatch.setattr(similar, "CHUNK", 3)
    monkeypatch.setattr(similar, "STREAM", 5)
    texts = edited_copies()
    expected, links = plain_groups({i: shingles(t) for i, t in texts.items()})
    assert len(links) > 60
    assert groups_of(spark, texts) == expected


def test_pairs_of_one_crowded_bucket_are_all_compared(spark, monkeypatch):
    """All rows share one bucket; pairs of like texts are found though rows are pivots, or no pivot's neighbours."""
    monkeypatch.setattr(similar, "plan", lambda nodes, similarity: [(0, [], 0)])
    monkeypatch.setattr(similar, "SMALL", 2)
    monkeypatch.setattr(similar, "PIVOTS", 1)
    monkeypatch.setattr(similar, "CHUNK", 7)
    monkeypatch.setattr(similar, "STREAM", 9)
    base, rng, texts = prose(77, 300), np.random.default_rng(1), {}
    for g in range(40):  # pairs of like texts, all with about two thirds of their shingles in common
        own = like(g, base, rng.choice(300, 6, replace=False))
        texts |= {10 * g: own, 10 * g + 1: like(100 + g, own, rng.choice(300, 3, replace=False))}
    expected, links = plain_groups({i: shingles(t) for i, t in texts.items()})
    assert len(links) >= 30
    assert groups_of(spark, texts) == expected


def test_no_pair_below_the_similarity_is_linked(spark):
    """Estimates do not decide: pairs of 0.6 to 0.8 stay apart."""
    texts = {}
    for g in range(40):
        own = prose(500 + g, 300)
        texts |= {10 * g: own, 10 * g + 1: like(g, own, range(3, 300, 300 // (8 + g % 3)))}
    sets = {i: shingles(t) for i, t in texts.items()}
    assert all(0.6 < jaccard(sets[i], sets[i + 1]) < 0.8 for i in range(0, 400, 10))
    assert groups_of(spark, texts) == {i: i for i in texts}


def test_similarity_is_that_of_sets(spark):
    """Links are exact at 0.8, and repeats of a line do not count."""
    words = [f"w{i}" for i in range(94)]  # 90 shingles
    at = {50 + k: words[:-k] + [f"n{k}x{i}" for i in range(k)] for k in (10, 11)}
    texts = {0: " ".join(words)} | {i: " ".join(t) for i, t in at.items()}  # 80 / 100 and 79 / 101
    line = "this text may be used by all who keep this line with every copy of it " * 100
    texts |= {200: line + prose(5, 200), 201: line + prose(6, 200)}
    docs = documents(spark, texts)
    pairs = spark.createDataFrame([(0, 60), (0, 61), (200, 201)], "a long, b long")
    wanted = docs.selectExpr("doc_id node", "struct(doc_id, xxhash64(text) th) first")
    got = {(r.a, r.b) for r in similar.verified(pairs, similar.shingle_sets(docs, wanted), 0.8).collect()}
    assert got == {(0, 60)}


def test_recall_on_the_documents_table(spark):
    """Of all pairs of 0.8 or more, found without any candidate search, hardly one is missed."""
    folder = "/root/testdata/sf0.1"
    if not Path(f"{folder}/documents.parquet").exists():
        pytest.skip("the generated tables are not here")
    read = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    expected, links = plain_groups({i: shingles(t) for i, t in zip(read["doc_id"], read["text"])})
    got = {r.doc_id: r.component_id for r in similar.similar_groups(spark, spark.read.parquet(f"{folder}/documents.parquet")).collect()}
    assert sum(got[a] == got[b] for a, b in links) >= 0.98 * len(links)
    joined = defaultdict(set)
    for i, c in got.items():
        joined[c].add(expected[i])
    assert all(len(v) == 1 for v in joined.values())


def test_plan_reaches_its_goal(spark):
    """Unequal thresholds whose chances to miss multiply to less than 1 - GOAL; wider partitions where rows crowd."""
    texts = {i: prose(i, 60) for i in range(400)}
    nodes = similar.distinct_sets(spark, similar.profiles(documents(spark, texts)))
    chosen = similar.plan(nodes)
    missed = np.prod([1 - similar.success(len(bits), 0.8)[t] for _, bits, t in chosen])
    assert missed <= 1 - similar.GOAL + 0.005
    assert len({(w, b) for w, bits, _ in chosen for b in bits}) == sum(len(bits) for _, bits, _ in chosen)


def test_choices_are_the_cheapest():
    """Against all combinations of thresholds."""
    parts = [([0], [1.0, 3.0], (0.5, 0.7)), ([1], [2.0, 2.5], (0.3, 0.8)), ([2], [4.0, 9.0], (0.6, 0.9))]
    gain = lambda p: int(-np.log1p(-p) / similar.STEP)
    found = similar.word_choices(parts, 200)
    every = {}
    for a in (-1, 0, 1):
        for b in (-1, 0, 1):
            for c in (-1, 0, 1):
                picked = [(p, t) for p, t in zip(parts, (a, b, c)) if t >= 0]
                key, cost = min(200, sum(gain(p[2][t]) for p, t in picked)), sum(p[1][t] for p, t in picked)
                every[key] = min(every.get(key, cost), cost)
    assert {k: v[0] for k, v in found.items()} == every
    word = {0: (0.0, ()), 60: (2.0, ("x",)), 120: (9.0, ("y",))}
    assert similar.allocate([word, word], 110) == [("x",), ("x",)]


def test_keys_follow_the_definition():
    rng = np.random.default_rng(4)
    prints = rng.integers(0, 1 << 63, (50, similar.WORDS), dtype=np.uint64)
    soft = np.array([rng.permutation(64 * similar.WORDS)[: similar.SOFT] for _ in range(50)], dtype="<u2")
    parts = [(0, list(range(0, 40)), 3), (2, list(range(5, 9)), 2)]
    got = defaultdict(set)
    for number, rows, values, probe in similar.keys_of(prints, soft, parts):
        for r, v in zip(rows, values):
            got[number, int(r)].add((int(v), probe))
    for number, (word, bits, most) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        for r in range(50):
            own = [int(b) - 64 * word for b in soft[r] if int(b) - 64 * word in bits][:most]
            flips = [0]
            for b in own:
                flips += [f ^ 1 << b for f in flips]
            assert got[number, r] == {((int(prints[r, word]) ^ f) & mask, int(f > 0)) for f in flips}


def test_profile_counts_bits():
    hashes = similar.shingle_set(simhash.words_of(prose(1, 300)))
    prints, soft = similar.profile(hashes)
    first = [2 * sum(int(h) >> b & 1 for h in hashes) > len(hashes) for b in range(64)]
    assert [int(prints[0]) >> b & 1 for b in range(64)] == first
    assert len(set(soft.tolist())) == similar.SOFT
    assert similar.check_distance(0.8, 192) < similar.check_distance(0.5, 192) < 96


def test_one_per_group(spark):
    docs = frame(spark)
    kept = similar.one_per_group(spark, docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 3, 4, 5, 7, 8, 9]
    assert ids.count(None) == 1


def test_rows_that_share_an_id(spark):
    """Texts decide: different ones under one id both stay, copies under one id leave one row."""
    rows = [(1, prose(1)), (1, prose(2)), (1, prose(1)), (2, prose(2)), (3, prose(3))]
    kept = similar.one_per_group(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted({(1, prose(1)), (1, prose(2)), (3, prose(3))})


def test_clashing_columns_and_empty_table(spark):
    rows = [(1, prose(1), 7, 8, 9, "r"), (2, prose(1), 7, 8, 9, "r"), (3, prose(3), None, None, None, None)]
    schema = "doc_id long, text string, node long, root long, th long, `a.b` string"
    kept = similar.one_per_group(spark, spark.createDataFrame(rows, schema))
    assert sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]
    assert similar.one_per_group(spark, frame(spark, [])).count() == 0
    assert similar.similar_groups(spark, frame(spark, [])).count() == 0
