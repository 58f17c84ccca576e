import random

import numpy as np
import pytest

from meritlens.llm import langid, quality, toxicity
from meritlens.llm.common import labelled_sample
from tests.llm.samples import awkward, frame, prose

LABELS = "doc_id long, quality int, toxic int, extra string"


def toxic_rows(n=400):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(n):
        words = prose(i, 50).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vilename", "rotword", "grimslur"]))
        rows.append((i, " ".join(words), None, None, None, None, None))
        labels.append((i, 1, int(bad), "e"))
    return rows, labels


def test_fold():
    assert toxicity.fold("1D10T").split() == ["idiot"]
    assert toxicity.fold("іdіоt").split() == ["idiot"]
    assert toxicity.fold("ｉｄｉｏｔ, Idi​ot!").split() == ["idiot", "idiot"]
    assert toxicity.fold("lame ıame").split() == ["iame", "iame"]
    assert toxicity.fold("été").split() == ["été"]


def test_toxicity_on_held_out(spark):
    rows, labels = toxic_rows()
    got = {r.doc_id: r for r in toxicity.op1(spark, frame(spark, rows), spark.createDataFrame(labels, LABELS)).collect()}
    wanted = {i: t for i, _, t, _ in labels}
    held = [i for i, r in got.items() if r.held_out]
    assert 60 < len(held) < 140
    assert all(got[i].predicted == wanted[i] for i in held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_substitutions_and_exceptions():
    rows, labels = toxic_rows()
    lexicon = toxicity.fit([(t, y) for (_, t, *_), (_, _, y, _) in zip(rows, labels)])
    automaton = lexicon.automaton()
    hits, _ = toxicity._weigh(automaton, [toxicity.fold(t) for t in ("v1l3name", "rotwords", "carrotword", "")])
    assert hits[0] > 0 and hits[1] > 0 and hits[2] == hits[3] == 0
    benign = [(f"{prose(900 + i, 30)} old rotword {prose(950 + i, 5)}", 0) for i in range(8)]
    taught = toxicity.fit([*((t, y) for (_, t, *_), (_, _, y, _) in zip(rows, labels)), *benign])
    hits, _ = toxicity._weigh(taught.automaton(), [toxicity.fold("an old rotword here"), toxicity.fold("such a rotword")])
    assert hits[0] == pytest.approx(0) and hits[1] > 0


def test_toxicity_awkward(spark):
    labels = spark.createDataFrame([(0, 1, 1, "a"), (3, None, None, "b"), (3, 1, 0, "b"), (None, 1, 1, "c")], LABELS)
    assert toxicity.op1(spark, frame(spark), labels).count() == len(awkward())
    assert {r.score for r in toxicity.op1(spark, frame(spark), labels.limit(0)).collect()} == {0.0}
    assert toxicity.op1(spark, frame(spark, []), labels).count() == 0
    docs = frame(spark)
    kept = toxicity.clean(spark, docs, labels)
    assert kept.columns == docs.columns and kept.count() == len(awkward())


def test_scores_equal_a_plain_scan(spark):
    """Hits by looking for each entry at each place, and the curve written out."""
    rows, labels = toxic_rows()
    rows += [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(["V1LENAME", "", "an old rotword, rotwords!", prose(3, 4000) + " rotword", "é"])]
    benign = [(2000 + i, f"{prose(900 + i, 30)} old rotword {prose(950 + i, 5)}", None, None, None, None, None) for i in range(12)]
    table = spark.createDataFrame([*labels, *((i, 1, 0, "e") for i, *_ in benign)], LABELS)
    docs = frame(spark, rows + benign)
    lexicon = toxicity.learn(spark, docs, table)
    assert any(w < 0 for w in lexicon.weights.values())
    bias, a, b = lexicon.coefficients
    got = {r.doc_id: r for r in toxicity.op1(spark, docs, table).collect()}
    for i, text, *_ in rows + benign:
        folded = toxicity.fold(text)
        hits = sum(w for e, w in lexicon.weights.items() for at in range(len(folded)) if folded.startswith(e, at))
        raw, words = max(hits, 0), max(folded.count(" "), 1)
        expected = 1 / (1 + np.exp(-(bias + a * np.log(1 + raw) + b * np.log(1 + 1000 * raw / words))))
        assert got[i].hits == pytest.approx(hits) and got[i].score == pytest.approx(expected, abs=1e-9)


def test_short_insults_are_entries_as_whole_words():
    examples = [(prose(i, 30) + (" zuk " if i % 3 == 0 else " zukari ") + prose(500 + i, 10), int(i % 3 == 0)) for i in range(240)]
    lexicon = toxicity.fit(examples)
    assert " zuk " in lexicon.weights
    hits, _ = toxicity._weigh(lexicon.automaton(), [toxicity.fold("Zuk, zuk!"), toxicity.fold("zukari")])
    assert hits[0] > 0 == hits[1]


def test_sample_is_bounded_by_rows_and_bytes(spark):
    rows = [(i, prose(i, 20), None, None, None, None, None) for i in range(300)] + [(300, prose(1, 5000), None, None, None, None, None)]
    docs, table = frame(spark, rows), spark.createDataFrame([(i, 1, i % 2, "e") for i in range(301)], LABELS)
    take = lambda n, size: labelled_sample(spark, docs, table, "toxic", 4, 2, n, size)
    every = take(10_000, 1 << 30)
    assert len(every) > 200 and every == take(10_000, 1 << 30)
    assert {i for i, *_ in take(30, 1 << 30)} < {i for i, *_ in every} and len(take(30, 1 << 30)) <= 60
    some = take(10_000, 5000)
    assert 30 < len(some) < 60 and sum(len(t.encode()) for _, t, _ in some) <= 5000
    assert take(10_000, 1) == []


def quality_rows(n=300):
    rows, labels = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(i, 60) if good else " ".join(w.upper() + "!!" for w in prose(i, 60).split())
        rows.append((i, text, None, None, None, None, None))
        labels.append((i, int(good), 0, "e"))
    return rows, labels


def test_quality_on_held_out(spark):
    rows, labels = quality_rows()
    table = spark.createDataFrame(labels, LABELS)
    got = {r.doc_id: r for r in quality.op7(spark, frame(spark, rows), table).collect()}
    wanted = {i: q for i, q, *_ in labels}
    held = [i for i, r in got.items() if r.held_out]
    assert len(held) > 30 and all(got[i].predicted == wanted[i] for i in held)
    kept = {r.doc_id for r in quality.clean(spark, frame(spark, rows), table).collect()}
    assert kept == {i for i, r in got.items() if r.score >= 0.3}


def test_quality_awkward(spark):
    labels = spark.createDataFrame([(4, 1, 1, "a"), (5, 0, 0, "b"), (8, 0, None, "c"), (9, 1, 1, "c"), (3, None, 1, "d")], LABELS)
    got = quality.op7(spark, frame(spark), labels).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.op7(spark, frame(spark), labels.limit(0)).collect()} == {0.0}
    assert quality.op7(spark, frame(spark, []), labels).count() == 0


def test_scores_equal_a_plain_network(spark):
    """Pooling word by word and the network written out."""
    rows, labels = quality_rows()
    rows += [(1000 + i, t, None, None, None, None, None) for i, t in enumerate(["", "same same same", "x" * 500 + "!", prose(3, 3000) + " 12ab!?"])]
    table = spark.createDataFrame(labels, LABELS)
    docs = frame(spark, rows)
    model = quality.learn(spark, docs, table)
    place = {w: i for i, w in enumerate([*model.words, *model.shapes])}
    shapes = {s: len(model.words) + i for i, s in enumerate(model.shapes)}
    got = {r.doc_id: r.score for r in quality.op7(spark, docs, table).collect()}
    for i, text, *_ in rows:
        words, total = text.split(), np.zeros(quality.DIM)
        for k, w in enumerate(words):
            total += model.vectors[place[w.lower()] if w.lower() in model.words else shapes[quality.UNKNOWN]]
            total += model.vectors[shapes.get(quality.shape_of(w), shapes[quality.UNKNOWN])]
            if k and w == words[k - 1]:
                total += model.vectors[shapes[quality.AGAIN]]
        pooled = total / max(1, 2 * len(words))
        hidden = np.tanh(pooled @ model.w1 + model.b1)
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(hidden @ model.w2 + model.b2) / model.temperature)), abs=1e-4)


def test_temperature_and_vectors():
    z, y = np.array([4.0, -4.0, 4.0, -4.0, 4.0]), np.array([1, 0, 1, 0, 0])
    assert quality._temperature(z, y) > 1
    assert quality._temperature(z[:4], y[:4]) == pytest.approx(0.25)
    assert (quality.index_vector("word") == quality.index_vector("word")).all()
    assert quality.shape_of("Abc!!9") == "<Aa!0>"


def brute_phrases(text: str, reference: str) -> int:
    count = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        count, at = count + 1, at + size
    return count


@pytest.mark.parametrize("seed", range(8))
def test_phrases_match_brute_force(seed):
    rng = random.Random(seed)
    train = ["".join(rng.choice("abc ") for _ in range(40)) for _ in range(3)]
    model = langid.fit([(t, "x") for t in train], 200)
    parser = langid.Parser(model)
    as_text = lambda f: "".join(chr(48 + int(v)) for v in f)
    reference = as_text(np.concatenate([np.append(parser.folder.fold(t), 0) for t in train]))
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 90))) for _ in range(20)]
    counts, _ = parser.phrases(texts)
    assert counts[:, 0].tolist() == [brute_phrases(as_text(parser.folder.fold(t)), reference) for t in texts]


def test_language_on_held_out(spark):
    rows = []
    for i in range(200):
        lang = ("xx", "yy")[i % 2]
        text = prose(i, 30) if i % 2 else " ".join("".join(c for c in w if c not in "bg") + "kz" for w in prose(i, 30).split())
        rows.append((i, text, lang, "s", None, 0.1, "h"))
    rows.append((1000, "1234 !!", "xx", "s", None, 0.1, "h"))
    got = {r.doc_id: r for r in langid.op10(spark, frame(spark, rows)).collect()}
    assert all(got[i].lang_pred == ("xx", "yy")[i % 2] for i in range(200))
    assert got[1000].lang_pred == "und" and got[1000].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_awkward(spark):
    got = {r.doc_id: r.lang_pred for r in langid.op10(spark, frame(spark)).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[9] in ("en", "de")
    assert langid.op10(spark, frame(spark, [])).count() == 0
    unlabelled = frame(spark, [(1, "some text", None, None, None, None, None)])
    assert langid.op10(spark, unlabelled).first().lang_pred == "und"


def test_every_letter_of_the_sample_counts():
    """Languages whose letters come after the most frequent ones are told apart, and parsed exactly."""
    rng = random.Random(4)
    text = lambda low, n, words=80: " ".join("".join(chr(low + rng.randrange(n)) for _ in range(4)) for _ in range(words))
    scripts = {"aa": (0x61, 26), "el": (0x3B1, 17), "ru": (0x430, 32), "th": (0x0E01, 40), "zh": (0x4E00, 300), "ja": (0x5E00, 300)}
    model = langid.fit([(text(low, n), lang) for lang, (low, n) in scripts.items() for _ in range(60 if lang == "aa" else 5)], 3000)
    parser = langid.Parser(model)
    new = [(lang, text(low, n)) for lang, (low, n) in scripts.items() for _ in range(4)]
    counts, sizes = parser.phrases([t for _, t in new])
    assert langid.predict(model, counts, sizes)[0] == [lang for lang, _ in new]

    train = [text(0x4E00, 90, 30) for _ in range(4)]
    parser = langid.Parser(langid.fit([(t, "x") for t in train], 800))
    as_text = lambda f: "".join(chr(48 + int(v)) for v in f)
    reference = as_text(np.concatenate([np.append(parser.folder.fold(t), 0) for t in train]))
    texts = [text(0x4E00, 95, 20) + train[k % 4][:40] for k in range(8)]
    counts, _ = parser.phrases(texts)
    assert counts[:, 0].tolist() == [brute_phrases(as_text(parser.folder.fold(t)), reference) for t in texts]


def test_long_texts_are_parsed_without_a_break(monkeypatch):
    """Counts do not depend on how many letters are laid out at a time, and equal brute force."""
    rng = random.Random(11)
    train = ["".join(rng.choice("abc ") for _ in range(60)) for _ in range(3)]
    texts = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (900, 1, 400, 37, 0, 900)]
    parser = langid.Parser(langid.fit([(t, "x") for t in train], 200))
    as_text = lambda f: "".join(chr(48 + int(v)) for v in f)
    reference = as_text(np.concatenate([np.append(parser.folder.fold(t), 0) for t in train]))
    for block, lanes in ((2048, 2048), (7, 2048), (64, 2)):
        monkeypatch.setattr(langid, "BLOCK", block)
        monkeypatch.setattr(langid, "LANES", lanes)
        counts, _ = parser.phrases(texts)
        assert counts[:, 0].tolist() == [brute_phrases(as_text(parser.folder.fold(t)), reference) for t in texts]


def test_little_labelled_text_is_no_loss():
    """A language with a fiftieth of the other's letters is still found."""
    other = lambda i: " ".join("".join(c for c in w if c not in "bg") + "e" for w in prose(i, 60).split())
    model = langid.fit([(prose(i, 60), "xx") for i in range(50)] + [(other(900), "yy")])
    parser = langid.Parser(model)
    texts = [other(i) for i in range(300, 340)]
    counts, sizes = parser.phrases(texts)
    assert counts.argmin(axis=1).mean() < 0.9  # by bare counts the larger sample wins some
    assert langid.predict(model, counts, sizes)[0].count("yy") >= 38


def test_sample_of_languages(spark, monkeypatch):
    """The most frequent ones, and one whose only text is over its share is learned from a part of it."""
    monkeypatch.setattr(langid, "LANGUAGES", 3)
    monkeypatch.setattr(langid, "EACH", 500)
    rows = [(i, prose(i, 40), ("aa", "bb", "bb", "cc", "cc")[i % 5], "s", None, 0.1, "h") for i in range(200)]
    rows += [(1000 + i, prose(i, 500), "long", "s", None, 0.1, "h") for i in range(60)]
    rows += [(2000 + i, prose(i, 40), "odd", "s", None, 0.1, "h") for i in range(3)]
    model = langid.learn(spark, frame(spark, rows))
    assert model.languages == ("bb", "cc", "long")
    assert (model.weights <= np.log(503)).all() and (model.weights > np.log(200)).all()
