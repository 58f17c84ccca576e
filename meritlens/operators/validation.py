"""Checks of a ranking that is handed in: (candidate_id, rank, score, reasoning) as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meritlens.functions import text as tx
from meritlens.functions.text import as_column, strings

COLUMNS = ("candidate_id", "rank", "score", "reasoning")
ROWS = 100
#: Words that a reason may only use if the record has them; fixed values.
CHECKED_TERMS = (
    "bm25", "ranking", "retrieval", "recommendation", "search", "faiss", "qdrant", "milvus", "pinecone", "weaviate",
    "elasticsearch", "ndcg", "mrr", "embeddings", "embedding", "kubernetes", "kafka", "pytorch", "tensorflow",
)
#: Letters, digits and underscores, as in word boundaries of Unicode texts.
WORD = r"[\p{L}\p{M}\p{N}_]+"
#: Term columns that ground a reason beside the record's tokens.
EVIDENCE_TERMS = (
    "career_retrieval_terms", "career_production_terms", "skill_retrieval_terms", "skill_vector_terms", "skill_ml_terms", "vector_terms",
    "eval_terms", "production_terms",
)


def problems(submission: DataFrame, known: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """(problem, detail) of everything wrong with a submission; empty if it is valid.

    Scores are compared in the order of ranks over the first ``rows`` + 1 rows; a longer submission is
    invalid by its length."""
    spark = submission.sparkSession
    if tuple(submission.columns) != COLUMNS:
        return spark.createDataFrame([("header", ",".join(submission.columns))], "problem string, detail string")
    s = submission.withColumns({
        "r": F.when(F.regexp_like("rank", F.lit(r"^\s*[+-]?\d+\s*$")), F.col("rank").try_cast("int")), "v": F.col("score").try_cast("double"),
    })
    say = lambda df, problem, detail: df.select(F.lit(problem).alias("problem"), detail.cast("string").alias("detail"))
    found = [
        say(s.agg(F.count("*").alias("n")).where(F.col("n") != rows), "row_count", F.col("n")),
        say(s.groupBy("candidate_id").count().where("count > 1"), "duplicate_id", F.col("candidate_id")),
        say(s.where("r is null"), "rank_not_integer", F.col("rank")),
        say(s.where("v is null"), "score_not_number", F.col("score")),
        say(s.where(F.trim(F.coalesce("reasoning", F.lit(""))) == ""), "empty_reasoning", F.col("candidate_id")),
        say(
            spark.range(1, rows + 1).join(s.select(F.col("r").cast("long").alias("id")).distinct(), "id", "left_anti"),
            "missing_rank", F.col("id"),
        ),
        say(
            s.orderBy("r").limit(rows + 1).withColumn("before", F.lag("v").over(Window.orderBy("r"))).where("v > before"),
            "score_rises", F.col("rank"),
        ),
    ]
    if known is not None:
        found.append(say(s.join(known.select("candidate_id"), "candidate_id", "left_anti"), "unknown_id", F.col("candidate_id")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def named_terms(text: Column | str, terms: Sequence[str] = CHECKED_TERMS) -> Column:
    """The terms that the text names as whole words, in the order of ``terms``.

    The text is cut into words once; terms of n words are looked up among its runs of n words."""
    words = F.regexp_extract_all(F.lower(F.coalesce(as_column(text), F.lit(""))), F.lit(WORD), 0)

    def runs(n: int) -> Column:
        if n == 1:
            return words
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))

    lengths = sorted({len(t.split()) for t in terms})
    return F.array_intersect(strings([" ".join(t.lower().split()) for t in terms]), F.flatten(F.array(*map(runs, lengths))))


def evidence_tokens(rows: DataFrame) -> DataFrame:
    """Feature rows with ``evidence``: tokens of the record's texts and the terms found in them."""
    texts = F.concat_ws(" ", "all_text", "career_text", "skill_text", "title")
    found = F.flatten(F.array(*(F.col(c) for c in EVIDENCE_TERMS)))
    places_ = F.array(*(F.lower(c) for c in ("title", "location", "country")))
    return rows.withColumn("evidence", F.array_distinct(F.concat(tx.token_set(texts, tx.BASELINE_TOKEN), found, places_)))


def reason_problems(rows: DataFrame, tokens: str = "tokens", expected: int | None = None, terms: Sequence[str] = CHECKED_TERMS) -> DataFrame:
    """(candidate_id, problem) of reasons that are not grounded or not in form.

    Null reasons count as empty, null ranks as the last; a term of several words is grounded if the record has
    each of them.  With ``expected`` another number of rows is a problem without an id."""
    text = F.trim(F.coalesce("reasoning", F.lit("")))
    have = F.coalesce(tokens, F.array().cast("array<string>"))
    unknown = F.filter(named_terms(text, terms), lambda t: F.size(F.array_except(F.split(t, " "), have)) > 0)
    named = F.array_compact(F.array(
        F.when(F.col("_times") > 1, "duplicate"), F.when(text == "", "empty"), F.when(F.length(text) < 40, "short"),
        F.when(F.length(text) > 500, "long"),
        F.when((F.coalesce("rank", F.lit(999)) > 75) & F.contains(F.lower(text), F.lit("excellent")), "overstated"),
        F.when(F.size(unknown) > 0, F.concat(F.lit("not_in_record: "), F.array_join(unknown, ", "))),
    ))
    # only reasons that occur again meet the rows, so no task gathers the rows of one reason
    digest = F.sha2(text, 256)
    again = rows.groupBy(digest.alias("_reason")).agg(F.count("*").alias("_times")).where("_times > 1")
    counted = rows.withColumn("_reason", digest).join(again, "_reason", "left")
    found = counted.withColumn("problem", F.explode(named)).select("candidate_id", "problem")
    if expected is None:
        return found
    count = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected)
    return found.unionByName(count.select(F.lit(None).cast("string").alias("candidate_id"), F.concat(F.lit("row_count: "), F.col("n")).alias("problem")))
