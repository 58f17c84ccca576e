import numpy as np
import pytest
import xxhash

from meritlens.llm import simhash
from tests.llm.samples import awkward, documents, frame, prose


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints: dict, tau=2):
    ids = list(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= tau:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "A b", "a  b\tC", prose(1), "É É é É a B", prose(2, 3000)])
def test_fingerprint_matches_plain_version(text):
    assert simhash.fingerprint(text or "") == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = prose(3, 500)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def near_prints(seed, n=250):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 12)
    out = {}
    for i in range(n):
        value = int(centres[rng.integers(len(centres))])
        for b in rng.integers(0, 64, rng.integers(0, 5)):
            value ^= 1 << int(b)
        out[i] = value
    return out


@pytest.mark.parametrize("crowd", [2, 48])
def test_links_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)  # 2: nearly every bucket goes through unit balls
    prints = near_prints(crowd)
    signed = {i: v - (1 << 64) if v >= 1 << 63 else v for i, v in prints.items()}
    nodes = {}
    for i, v in sorted(signed.items()):
        nodes.setdefault(v, i)
    frame_ = spark.createDataFrame(list(nodes.items()), "fp long, node long")
    edges = simhash.links(spark, frame_)
    assert all(((a.u != a.v) for a in edges.collect()))
    roots = {r.v: r.root for r in simhash.components(spark, edges).collect()}
    expected = plain_components({i: prints[i] for i in nodes.values()})
    assert {i: roots.get(i, i) for i in nodes.values()} == expected


def test_thresholds_cover_every_pair(spark):
    nodes = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v, i) for i, v in enumerate(near_prints(9).values())], "fp long, node long")
    chosen = simhash.plan(nodes)
    m = len({tuple(b) for b, _ in chosen})
    assert sum(t + 1 for _, t in chosen) == simhash.TAU + 1
    assert m >= 1 and all(len(set(b)) == len(b) for b, _ in chosen)


def test_allocation_is_the_cheapest():
    cost, chosen = simhash.allocate([[0, 5, 9, 50], [0, 1, 2, 3], [0, 4, 4, 4]], 0)
    assert sum(chosen) == 0 and cost == 3 and chosen == [-1, 2, -1]


def test_awkward_rows(spark):
    got = simhash.op6(spark, frame(spark)).collect()
    assert len(got) == len(awkward())
    assert {r.fingerprint for r in got if r.doc_id in (0, 1, 2)} == {"0" * 16}
    by = {r.doc_id: r for r in got}
    assert by[1].component_id == by[2].component_id == 0
    assert by[6].component_id == 5
    for doc_id, text, *_ in awkward():
        if doc_id is not None:
            assert int(by[doc_id].fingerprint, 16) == plain_fingerprint(text)


def test_empty_table(spark):
    assert simhash.op6(spark, frame(spark, [])).count() == 0


def test_large_group_of_copies(spark):
    texts = {i: prose(1) for i in range(300)} | {1000 + i: prose(100 + i) for i in range(20)}
    got = {r.doc_id: r.component_id for r in simhash.op6(spark, documents(spark, texts)).collect()}
    assert got == plain_components({i: plain_fingerprint(t) for i, t in texts.items()})


@pytest.mark.parametrize("chosen", [[(range(0, 64, 2), 1), (range(1, 64, 2), 0)], [(range(64), 2)], [(range(20), -1), (range(20, 40), 0), (range(40, 64), 1)]])
def test_unequal_thresholds_lose_no_link(spark, monkeypatch, chosen):
    """Probing within a threshold finds what exact partition values would miss."""
    parts = [(list(bits), t) for bits, t in chosen if t >= 0]
    monkeypatch.setattr(simhash, "plan", lambda nodes: parts)
    prints = near_prints(5, 80)
    distinct = {v: i for i, v in sorted(prints.items(), reverse=True)}
    signed = [(v - (1 << 64) if v >= 1 << 63 else v, i) for v, i in distinct.items()]
    got = {(r.u, r.v) for r in simhash.links(spark, spark.createDataFrame(signed, "fp long, node long")).collect()}
    ids = sorted(distinct.items(), key=lambda x: x[1])
    expected = {(a, b) for x, a in ids for y, b in ids if a < b and (x ^ y).bit_count() <= 2}
    assert expected and got == expected
