import datetime as dtm
import math

import pytest
from pyspark.sql import functions as F

from meritlens.functions import dates, scalars, vectors
from meritlens.functions import text as tx


def one(spark, column, **values):
    """The value of a column expression over one row of strings."""
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double'}" for k, v in values.items()) or "x string"
    row = tuple(values.values()) or (None,)
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    ("text", "terms", "expected"),
    [
        ("i maintain the html and xml templates", ("ranking",), 0.0),
        ("strong python and sql", ("python",), 1.0),
        ("strong python and sql", ("python skills",), 0.4),
        ("python skills are strong", ("python skills",), 1.0),
        ("i streamline reports", ("ml",), 0.0),
        ("go and c#", ("go", "c#", "r"), 2 / 3),
        ("anything", ("of", "python"), 0.0),
        ("a b", (), 0.0),
        ("deep sea deep", ("deep deep dive trip",), 1.0),
    ],
)
def test_term_coverage(spark, text, terms, expected):
    rows = spark.createDataFrame([(text,)], "t string").withColumn("tokens", tx.token_set("t"))
    assert rows.select(tx.term_coverage("tokens", terms).alias("c")).first().c == pytest.approx(expected)


def test_tokens_and_substrings(spark):
    assert set(one(spark, tx.token_set("t"), t="C++ and .NET, c#!")) == {"c++", "and", "net", "c#"}
    assert set(one(spark, tx.token_set("t", tx.MATCH_TOKEN), t="a test. of x/y-z")) == {"test.", "x/y-z"}
    assert one(spark, tx.contains_any("t", ("ml", "ann", "zzz")), t="html planning") == ["ann", "ml"]
    assert one(spark, tx.contains_any("t", ("ml",)), t=None) == []


def test_keywords_agree_with_the_driver(spark):
    for sentence in ("Must have embeddings, sentence-transformers and C++ / Go in production", "-x- /a/ .NET R c# ML", "", "the and of"):
        assert tuple(one(spark, tx.keywords("t"), t=sentence)) == tx.keywords_of(sentence)


def test_overlap(spark):
    words = F.array(F.lit("ml"), F.lit("python"))
    tokens = F.array(F.lit("html"), F.lit("streamline"), F.lit("python"))
    assert one(spark, tx.lexical_overlap(words, tokens)) == 0.5
    assert one(spark, tx.matched_keywords(words, tokens)) == ["python"]
    assert one(spark, tx.lexical_overlap(tx.strings([]), tokens)) == 0.0


def test_best_span(spark):
    words = F.array(*map(F.lit, ("ranking", "ndcg", "embeddings")))
    text = "I like long walks in parks. Built ranking with embeddings and ndcg tests. Also ranking things elsewhere."
    assert one(spark, tx.best_span(words, "t"), t=text) == "Built ranking with embeddings and ndcg tests."
    assert one(spark, tx.best_span(words, "t"), t="nothing to see in here") == ""
    long = "ranking " + "word " * 60
    cut = one(spark, tx.best_span(words, "t"), t=long)
    assert len(cut) == 160 and cut.endswith("…")


@pytest.mark.parametrize(
    ("text", "low", "high"),
    [("5-9 years", 5.0, 9.0), ("9 to 5 yrs", 5.0, 9.0), ("7+ years of work", 7.0, None), ("none", None, None), ("3–4y", 3.0, 4.0)],
)
def test_year_band(spark, text, low, high):
    assert tuple(one(spark, tx.year_band("t"), t=text)) == (low, high)


def test_places_and_accounts(spark):
    assert one(spark, tx.places("t"), t="noida or Pune, not Puner") == ["Pune", "Noida"]
    assert one(spark, tx.account_name("t"), t="see https://github.com/some-one/x") == "some-one"
    assert one(spark, tx.account_name("t"), t="github.com/topics/x") is None


@pytest.mark.parametrize(
    ("day", "months"),
    [("2026-06-14", 0), ("2026-05-15", 0), ("2026-05-14", 1), ("2025-06-14", 12), ("2030-01-01", 0), ("2026-13-01", 999), ("x", 999), (None, 999), ("2026-2-3", 4)],
)
def test_months_since(spark, day, months):
    assert one(spark, dates.months_since("t"), t=day) == months


def test_dates(spark):
    assert one(spark, dates.is_future("t"), t="2026-07-01") and not one(spark, dates.is_future("t"), t="2026-06-30")
    assert one(spark, dates.date_before("a", "b"), a="2020-01-01", b="2022-01-01")
    assert not one(spark, dates.date_before("a", "b"), a="2020", b="2022-01-01")
    assert one(spark, dates.recency("t"), t="2026-03-01") == 0.5 and one(spark, dates.recency("t"), t="?") == 0.5
    assert one(spark, dates.duration_months("a", "b"), a="2024-01", b="2025-03") == 14
    assert one(spark, dates.duration_months("a", "b"), a="2026", b=None) == 5
    assert dates.AS_OF == dtm.date(2026, 6, 14)


def test_scalars(spark):
    lit = F.lit
    assert one(spark, scalars.seniority(lit(6.0), (5, 9), (6, 8))) == 1.0
    assert one(spark, scalars.seniority(lit(5.5), (5, 9), (6, 8))) == 0.88
    assert one(spark, scalars.seniority(lit(10.0), (5, 9), (6, 8))) == 0.62
    assert one(spark, scalars.seniority(lit(20.0), (5, 9), (6, 8))) == 0.25
    assert one(spark, scalars.gate(lit(1.0), lit(1.0))) == pytest.approx(1.0)
    assert one(spark, scalars.gate(lit(0.5), lit(0.0))) == pytest.approx(0.5**1.1 * 0.45)
    assert one(spark, scalars.gate(lit(0.9), lit(0.9), lit(1.0), lit(False))) == 0.0
    assert one(spark, scalars.notice("t"), t="45") == 0.7 and one(spark, scalars.notice("t"), t="soon") == 0.5
    flags = lambda *x: tx.strings(x)
    assert one(spark, scalars.risk_penalty(flags("stale_low_response", "odd"))) == pytest.approx(0.15)
    assert one(spark, scalars.risk_penalty(flags(*["non_tech_ai_keyword_stuffing"] * 4))) == 0.45


def test_open_flag_is_three_valued(spark):
    term = lambda flag: one(spark, scalars.open_term(F.lit(flag).cast("boolean"), F.lit(0)))
    assert term(False) < term(None) < term(True)


@pytest.mark.parametrize(
    ("months", "rate", "flag", "label", "score"),
    [(999, 0.0, None, "unknown", 0.5), (999, 0.0, True, "reachable", 0.6), (0, 0.85, False, "passive", None), (21, 0.05, True, "stale", None), (1, 0.5, None, "reachable", None), (4, 0.2, None, "passive", None)],
)
def test_reachability(spark, months, rate, flag, label, score):
    got = one(spark, scalars.reachability(F.lit(months), F.lit(rate), F.lit(flag).cast("boolean")))
    assert got.label == label and (score is None or got.score == score)


def test_vectors(spark):
    array = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.rescaled_cosine(array(1, 2), array(1, 2))) == 1.0
    assert one(spark, vectors.rescaled_cosine(array(1, 0), array(0, 1))) == 0.0
    assert one(spark, vectors.rescaled_cosine(array(0, 0), array(0, 1))) == 0.0
    angle = math.acos(0.385)
    assert one(spark, vectors.rescaled_cosine(array(1, 0), array(math.cos(angle), math.sin(angle)))) == pytest.approx(0.5)
    assert one(spark, vectors.hybrid(F.lit(1.0), F.lit(0.0))) == pytest.approx(0.6)
    assert one(spark, vectors.hybrid(F.lit(None).cast("double"), F.lit(0.3))) == 0.3
    assert one(spark, vectors.unit(array(3, 4))) == [0.6, 0.8] and one(spark, vectors.unit(array(0, 0))) == [0.0, 0.0]
