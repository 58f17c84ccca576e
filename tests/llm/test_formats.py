import hashlib
import random
import sys
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from meritlens.llm import chat, fingerprints, media, urls
from tests.llm.samples import awkward, frame, prose

CONTROLS = ["<", "[", "\\", "s>", "/s>", "n>", "INST]", "/INST]", "a", "\n", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(CONTROLS), max_size=10).map("".join))
def test_escaping_is_reversible(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in (chat.BEGIN, chat.END, chat.USER_BEGIN, chat.USER_END, chat.LINE))
    assert chat.unescape_role(chat.escape_role(text)) == text


def plain_digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_chat(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to\nol", "", None]), rng.choice([None, "", "".join(rng.choices(CONTROLS, k=12)), prose(c)]), 1)
            for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(5, 2, "user", "tie", 1), (5, 2, "user", "tie", 1), (None, 0, "assistant", "alone", 1), (40, None, "user", "x", 1)]
    rows += [(99, t, "assistant", prose(t, 3), 1) for t in range(3000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    got = {r.conv_id: r for r in chat.op2(spark, table).collect()}
    by = {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for c, t, r, x, _ in sorted(rows, key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        assert tuple(got[c])[1:5] == plain_digest(turns)
    whole = {r.conv_id: r.formatted for r in chat.format_conversations(table).collect()}
    assert all(len(whole[c]) == got[c].formatted_chars for c in whole)


def test_chat_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert [r.conv_id for r in chat.op2(spark, table).collect()] == [-7]


def test_media_round_trip():
    rng = np.random.default_rng(1)
    for size in (64, 128, 384, 448, 64 * 41):
        for payload in (bytes(size), bytes([255] * size), rng.integers(0, 256, size, dtype=np.uint8).tobytes()):
            stored = media.write(payload)
            image = media.read(stored)
            assert media.payload_of(image) == payload
            rgb = image.rgb()
            assert rgb.shape == (image.height, image.width, 3) and rgb.dtype == np.uint8


def test_long_runs_of_blocks(monkeypatch):
    monkeypatch.setattr(media, "RUN_MOST", 5)
    payload = bytes(range(256)) * 9
    assert media.payload_of(media.read(media.write(payload))) == payload


def test_wide_image(monkeypatch):
    monkeypatch.setattr(media, "MOST_ROWS", 2)
    payload = prose(1, 400).encode()[:2048]
    image = media.read(media.write(payload))
    assert image.width == 48 and media.payload_of(image) == payload


def progressive(coefficients: np.ndarray) -> bytes:
    """A one-component JPEG written plainly: general codes with zero runs, ends of block and a
    refinement that makes coefficients new."""
    blocks = len(coefficients)
    code = {s: i for i, s in enumerate(sorted({0, 0xF0} | {r << 4 | z for r in range(16) for z in range(1, 9)}))}
    counts = bytes([0] * 7 + [len(code)] + [0] * 8)
    table = media._segment(0xC4, bytes([0x10]) + counts + bytes(sorted(code)))
    dc = media._segment(0xC4, bytes([0, 0, 0, 0, 12, *[0] * 12, *range(12)]))

    def number(v, n):
        return format(v if v > 0 else v + (1 << n) - 1, f"0{n}b") if n else ""

    def scan(ss, se, ah, al, text):
        return media._scan([1], ss, se, ah, al, np.array([int(b) for b in text], dtype=np.uint8))

    text, last = "", 0
    for b in coefficients[:, 0]:
        size = abs(int(b) - last).bit_length()
        text, last = text + format(size, "04b") + number(int(b) - last, size), int(b)
    first = scan(0, 0, 0, 0, text)
    text = ""
    for b in coefficients:
        run = 0
        cut = [int(abs(v) >> 1) * (1 if v > 0 else -1) for v in b]
        end = max((k for k in range(1, 64) if cut[k]), default=0)
        for k in range(1, end + 1):
            if not cut[k]:
                run += 1
                continue
            while run > 15:
                text, run = text + format(code[0xF0], "08b"), run - 16
            size = abs(cut[k]).bit_length()
            text, run = text + format(code[run << 4 | size], "08b") + number(cut[k], size), 0
        if end < 63:
            text += format(code[0], "08b")
    coarse = scan(1, 63, 0, 1, text)
    text = ""
    for b in coefficients:
        old = [abs(int(v)) >> 1 for v in b]
        new = [k for k in range(1, 64) if abs(int(b[k])) == 1]
        k, pending = 1, ""
        run = 0
        for n in new:
            for k in range(k, n):
                if old[k]:
                    pending += str(abs(int(b[k])) & 1)
                else:
                    run += 1
                    if run == 16:
                        text, run, pending = text + format(code[0xF0], "08b") + pending, 0, ""
            text += format(code[run << 4 | 1], "08b") + ("1" if b[n] > 0 else "0") + pending
            k, run, pending = n + 1, 0, ""
        text += format(code[0], "08b") + "".join(str(abs(int(b[j])) & 1) for j in range(k, 64) if old[j]) if k < 64 else ""
    fine = scan(1, 63, 1, 0, text)
    size = media._segment(0xC2, bytes([8, 0, 8, *divmod(8 * blocks, 256), 1, 1, 0x11, 0]))
    return b"\xff\xd8" + media._segment(0xDB, bytes([0] + [2] * 64)) + size + dc + table + first + coarse + fine + b"\xff\xd9"


def test_general_scans():
    rng = np.random.default_rng(4)
    coefficients = np.where(rng.random((12, 64)) < 0.2, rng.integers(-40, 41, (12, 64)), 0)
    coefficients[:, 0] = rng.integers(-300, 300, 12)
    coefficients[3, 1:] = 0
    image = media.read(progressive(coefficients))
    assert (image.components[1].coefficients == coefficients).all()
    flat = np.zeros((8, 8))
    flat.ravel()[media.ZIGZAG] = 2 * coefficients[5]
    u = np.arange(8)
    basis = np.cos((2 * u[:, None] + 1) * u[None] * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 0.5)
    plain = np.clip(np.rint(basis @ flat @ basis.T + 128), 0, 255)
    assert np.abs(image.rgb()[:, 40:48, 0].astype(float) - plain).max() <= 1


def test_chroma_is_upsampled():
    image = media.Image(16, 16, b"", {0: np.ones(64)})
    for name, h in ((1, 2), (2, 1), (3, 1)):
        image.components[name] = media.Component(h, h, 0, h, h, h, h)
    image.components[3].coefficients[0, 0] = 8 * 50
    rgb = image.rgb()
    assert (rgb[:, :, 0] == round(128 + 1.402 * 50)).all() and (rgb[:, :, 2] == 128).all()


def test_media_awkward(spark):
    got = media.op4(frame(spark)).collect()
    texts = {i: (t or "").encode() for i, t, *_ in awkward()}
    assert len(got) == len(awkward())
    for r in got:
        raw = texts[r.doc_id]
        payload = raw + bytes(64 if not raw else -len(raw) % 64)
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
    by = {r.doc_id: r for r in got}
    assert by[5][1:] == by[6][1:] and by[0][1:] == by[1][1:]
    assert media.op4(frame(spark, [])).count() == 0
    tensors = media.decode(media.encode(frame(spark).limit(3))).collect()
    assert all(len(t.rgb) == 3 * t.width * t.height for t in tensors)
    assert all((t.width, t.height, t.rgb) == (by[t.doc_id].width, by[t.doc_id].height, by[t.doc_id].rgb) for t in tensors)


def test_media_image_of_usual_size_costs_few_steps():
    """Texts are short, so what an image costs beside its bytes is most of the work."""

    def calls(f, value):
        seen = []
        sys.setprofile(lambda frame, event, arg: seen.append(event) if event in ("call", "c_call") else None)
        try:
            out = f(value)
        finally:
            sys.setprofile(None)
        return out, len(seen)

    payload = bytes(range(256)) * 10 + bytes(128)
    media.read(media.write(payload))  # tables that all images share
    stored, writing = calls(media.write, payload)
    image, reading = calls(media.read, stored)
    assert media.payload_of(image) == payload
    assert writing < 600 and reading < 800


def test_media_refuses_other_files():
    with pytest.raises(ValueError):
        media.read(b"GIF89a")


def shingle_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_hashes(text):
    """All 31-bit shingle hashes: words, then five of their hashes, through XXH64 with the last hash as seed."""
    folded = (text or "").lower().translate({c: " " for c in range(9, 14)})
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in folded.split(" ") if w]
    out = set()
    for i in range(max(1, len(words) - 4)) if words else ():
        h = 42
        for w in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(w.to_bytes(8, "little"), seed=h)
        out.add(h >> 33)
    return out


def plain_low(hashes):
    return {h for h in hashes if h < (1 << 31) // fingerprints.SCALE}


def plain_sketch(hashes):
    return plain_low(hashes) or set(sorted(hashes)[:1])


def plain_written(hashes):
    return "".join(f"{h:08x}" for h in sorted(plain_sketch(hashes)))


def read_back(fingerprint):
    return {int(fingerprint[i : i + 8], 16) for i in range(0, len(fingerprint), 8)}


def plain_likeness(a, b, contained=False):
    """From two fingerprints as written, and nothing else."""
    a, b = read_back(a), read_back(b)
    whole = a if contained else a | b
    return len(a & b) / len(whole) if whole else 1.0


def test_fingerprints(spark):
    rows = [r for r in awkward() if r[0] is not None] + [(100 + i, prose(i, 300), None, None, None, None, None) for i in range(40)]
    got = fingerprints.op9(spark, frame(spark, rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(((i, t or "") for i, t, *_ in rows), reverse=True)
    following = {a: b for a, b in zip(ordered, ordered[1:] + ordered[:1])}
    ordered_ids = {}
    for (i, t), (_, n) in following.items():
        ordered_ids.setdefault(i, []).append((t, n))
    gaps = []
    for r in got:
        found = []
        for t, n in ordered_ids[r.doc_id]:
            k = len(t) // 3
            edited = t[: len(t) - k] + n[:k]
            found.append((hashlib.sha256(edited.encode()).hexdigest(), t, edited))
        match = [x for x in found if x[0] == r.edited_sha256]
        if r.doc_id != 7:  # repeated rows follow each other
            assert match and r.n_chars == len(match[0][1])
            a, b = shingle_set(match[0][1]), shingle_set(match[0][2])
            if len(a | b) > 200:
                gaps.append(r.near_edited - len(a & b) / len(a | b))
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert np.abs(np.mean(gaps)) < 0.03 and np.mean(np.abs(gaps)) < 0.05 and np.max(np.abs(gaps)) < 0.2
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[0].fingerprint == by[2].fingerprint == ""
    for r in got:
        for t, n in ordered_ids[r.doc_id]:
            assert r.fingerprint == plain_written(plain_hashes(t))
            edited = t[: len(t) - len(t) // 3] + n[: len(t) // 3]
            if r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest():
                assert r.edited_fingerprint == plain_written(plain_hashes(edited))
                assert r.near_next == plain_likeness(r.fingerprint, plain_written(plain_hashes(n)))
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.kept_in_edited == plain_likeness(r.fingerprint, r.edited_fingerprint, True)


def test_neighbours_wrap_and_null_ids(spark):
    one = fingerprints.op9(spark, frame(spark, [(5, "a b c", None, None, None, None, None)])).first()
    assert one.near_next == 1.0
    rows = fingerprints.op9(spark, frame(spark)).collect()
    assert len(rows) == len(awkward()) and sum(r.doc_id is None for r in rows) == 1
    assert fingerprints.op9(spark, frame(spark, [])).count() == 0


def test_sketches_merge_and_contain(spark):
    short, long = prose(1, 400), prose(1, 400) + " " + prose(2, 4000)
    row = spark.createDataFrame([(short, long, prose(3, 400))], "a string, b string, c string")
    for c in "abc":
        row = fingerprints.with_sketch(row, c, f"s{c}", 4)
    out = row.select(
        fingerprints.containment("sa", "sb").alias("inside"), fingerprints.containment("sb", "sa").alias("other"),
        fingerprints.likeness("sa", "sc").alias("apart"), fingerprints.merged("sa", "sb").alias("m"), "sa", "sb",
    ).first()
    assert out.inside == 1.0 and out.other < 0.3 and out.apart == 0.0
    assert out.m == sorted(set(out.sa) | set(out.sb))


URLS = [
    ("http://a.Example.NET/es/1", "a.example.net", "/es/1", "net/es/", "block"),
    ("https://www.example.com/en/2?x=1#y", "www.example.com", "/en/2", "www.example.com/en/", "allow"),
    ("https://m.example.com/en/2", "m.example.com", "/en/2", "example.com/en/", "block"),
    ("https://example.com/en/", "example.com", "/en/", "example.com/en/", "block"),
    ("https://example.com/en", "example.com", "/en", "com/", "allow"),
    ("https://notexample.com?q=/en/", "notexample.com", "", None, "allow"),
    ("http://x.org://y.net/fr/", "x.org:", "//y.net/fr/", None, "allow"),
    ("//x.net/fr/", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("", "", "", None, "allow"),
    ("ftp://planet/fr/", "planet", "/fr/", None, "allow"),
    ("http://NÉT.net/fr/x#?", "nÉt.net", "/fr/x", "net/fr/", "block"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "x") for i, u in enumerate(URLS)], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(0, 1, None), (None, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in urls.op3(pages, labels).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), URLS[i]
    assert urls.op3(pages.limit(0), labels).count() == 0
    assert urls.op3(pages, labels.limit(0)).count() == len(URLS)


def test_mined_rules_decide_pages_without_a_rule(spark):
    """From labels of such pages alone; without a telling label the default stands."""
    hosts = ["http://spam.shop.org/buy", "http://news.site.org/story"]
    pages = [(i, f"{hosts[i % 2]}/{i}" if i < 200 else f"http://x{i}.example.net/es/{i}") for i in range(400)]
    labels = [(i, int(i % 2), 0) for i in range(0, 150)] + [(i, 1, 0) for i in range(200, 400)]
    schema = "page_id long, url string", "doc_id long, quality int, toxic int"
    got = {r.page_id: r for r in urls.judge(
        spark.createDataFrame(pages, schema[0]),
        spark.createDataFrame(labels, schema[1]).selectExpr("doc_id page_id", "toxic = 1 or quality = 0 block"),
    ).collect()}
    assert all(got[i].verdict == ("allow" if i % 2 else "block") and got[i].confidence == 1.0 for i in range(200))
    assert all(got[i].verdict == "block" and got[i].rule == "net/es/" and got[i].confidence is None for i in range(200, 400))


def brute_rules(rows, support, confidence):
    from itertools import combinations

    counts, n = {}, len(rows)
    for tokens, verdict in rows:
        for size in range(1, len(tokens) + 1):
            for combo in combinations(sorted(tokens), size):
                own = counts.setdefault(combo, {})
                own[verdict] = own.get(verdict, 0) + 1
    kept = {
        (c, v): k / sum(own.values()) for c, own in counts.items() for v, k in own.items()
        if k / n >= support and k / sum(own.values()) >= confidence
    }
    return {
        (c, v) for (c, v), p in kept.items()
        if not any(w == v and len(s) < len(c) and set(s) <= set(c) and q >= p for (s, w), q in kept.items())
    }


def test_mined_rules_match_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        tokens = sorted(t for t in "abcdef" if rng.random() < 0.4)
        verdict = "block" if {"a", "b"} <= set(tokens) or "f" in tokens and rng.random() < 0.95 else "allow"
        rows.append((tokens, verdict))
    table = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    mined = urls.mine(table, 0.05, 0.9, 1)
    assert {(tuple(r.tokens), r.verdict) for r in mined.collect()} == brute_rules([r for r in rows if r[0]], 0.05, 0.9)
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "page_id long, tokens array<string>")
    best = {(tuple(r.tokens), r.verdict): (r.confidence, r.support, len(r.tokens), r.verdict == "block") for r in mined.collect()}
    for r in urls.by_mined(pages, mined).collect():
        fit = [(score, v) for (t, v), score in best.items() if set(t) <= set(r.tokens)]
        assert r.mined == (max(fit)[1] if fit else None)


def test_merged_is_the_sketch_of_both(spark):
    """Also where a short text has no low hash."""
    rows = [(prose(k, 5 + k % 12), prose(1000 + k, (400, 8, 6)[k % 3])) for k in range(60)]
    table = spark.createDataFrame(rows, "a string, b string")
    for c in "ab":
        table = fingerprints.with_sketch(table, c, f"s{c}")
    got = table.select("a", "b", "sa", fingerprints.merged("sa", "sb").alias("m")).collect()
    assert sum(not plain_low(plain_hashes(r.a)) for r in got) > 5
    for r in got:
        assert r.m == sorted(plain_sketch(plain_hashes(r.a) | plain_hashes(r.b)))


def test_likeness_follows_from_fingerprints_alone(spark):
    """Every row of a table of mostly short texts, recomputed from the returned strings; lone hashes among them."""
    texts = {k: prose(k % 50, 4 + k % 9) if k % 3 else "" if k % 2 else f"{prose(k % 50, 8)} {prose(900 + k, 80)}" for k in range(200)}
    rows = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in texts.items()], frame(spark).schema)
    got = {r.doc_id: r for r in fingerprints.op9(spark, rows).collect()}
    assert sum(1 for t in texts.values() if t and not plain_low(plain_hashes(t))) > 10
    for i, r in got.items():
        assert r.fingerprint == plain_written(plain_hashes(texts[i]))
        assert r.near_edited == plain_likeness(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == plain_likeness(r.fingerprint, got[i - 1 if i else 199].fingerprint)


def test_lone_hashes_are_right_on_average(spark):
    """Pairs of texts of six shingles, four in common of eight: without low hashes they are alike with a chance of one half."""
    pairs = []
    for k in range(3000):
        words = [f"w{k}x{i}" for i in range(10)]
        pairs.append((k, " ".join(words), " ".join([*words[:8], f"y{k}", f"z{k}"])))
    table = spark.createDataFrame(pairs, "k int, a string, b string")
    for c in "ab":
        table = fingerprints.with_sketch(table, c, f"s{c}")
    rows = [r for r in table.select("a", "b", fingerprints.likeness("sa", "sb").alias("x")).collect() if not plain_low(plain_hashes(r.a) | plain_hashes(r.b))]
    assert len(rows) > 200 and abs(np.mean([r.x for r in rows]) - 0.5) < 0.12
