"""BM25 over postings: one row for each document and term, statistics by term, and batches of queries.

The index is three tables, so adding documents appends postings and counts terms anew by one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators.sized import MOST_TERMS, is_small

K1, B, EPSILON = 1.5, 0.75, 0.25
WORD = r"[\p{L}\p{N}]+"


def tokens(c: Column | str) -> Column:
    """Runs of letters and digits, case kept; CJK characters one by one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_extract_all(c, F.lit(r"[\x{4E00}-\x{9FFF}]|[\p{L}\p{N}&&[^\x{4E00}-\x{9FFF}]]+"), F.lit(0))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, token, tf)."""
    return docs.select(id_col, F.explode(tokens(text_col)).alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))


def counted(found: str = "tokens") -> Column:
    """Of a column of sorted tokens that are not none: each token once with its times (array of token, tf), found row by row."""
    at = f"filter(sequence(0, size({found}) - 1), i -> i = 0 OR {found}[i] <> {found}[i - 1])"
    return F.expr(f"transform(array({at}), at -> transform(at, (p, j) -> struct({found}[p] AS token, CAST(coalesce(get(at, j + 1), size({found})) - p AS BIGINT) AS tf)))[0]")


def doc_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl), also for documents without a token; nothing is shuffled."""
    return docs.select(id_col, F.coalesce(F.size(tokens(text_col)), F.lit(0)).alias("dl"))


def term_stats(posted: DataFrame, n_docs: int) -> DataFrame:
    """(token, df, idf): ln((N - df + 0.5) / (df + 0.5)), where negative a quarter of the mean over all terms."""
    stats = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df")).withColumn("raw_idf", F.log((F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = stats.agg(F.avg("raw_idf").alias("mean"))
    return stats.join(F.broadcast(mean)).select("token", "df", F.when(F.col("raw_idf") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw_idf")).alias("idf"))


def bm25(posted: DataFrame, lengths: DataFrame, queries: DataFrame, k: int, allowed: DataFrame | None = None, id_col: str = "doc_id") -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query, ties by id.

    ``queries`` is (query_id, token, times). The documents are ``lengths``, so statistics count those without a token.
    ``allowed`` (id, or query_id and id) restricts results after scoring, so statistics stay those of all documents.
    Up to ``sized.MOST_TERMS`` terms of queries go to the postings, and only matching postings are shuffled; more terms are joined by shuffles.
    """
    n, avgdl = lengths.agg(F.count(F.lit(1)), F.avg("dl")).first()
    sent = F.broadcast if is_small(queries, MOST_TERMS) else lambda df: df
    asked = sent(queries.select("token").distinct())
    idf = term_stats(posted, n).join(asked, "token")
    part = F.col("times") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(float(avgdl or 1))))
    # the semi-join goes below the counting of postings, so other terms are never shuffled
    met = posted.join(asked, "token", "left_semi").join(sent(queries), "token").join(sent(idf), "token").join(lengths, id_col)
    scored = met.groupBy("query_id", id_col).agg(F.round(F.sum(part), 6).alias("score"))
    if allowed is not None:
        scored = scored.join(allowed, [c for c in ("query_id", id_col) if c in allowed.columns], "left_semi")
    return top(scored, "query_id", "score", id_col, k)


def top(scored: DataFrame, group: str, score: str, tie: str, k: int, descending: bool = True) -> DataFrame:
    """Rows of each group with their ``rank`` up to k; Spark cuts each partition to k before the shuffle."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, F.col(tie)))).where(F.col("rank") <= k)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokens(text_col)).alias("token")).groupBy("query_id", "token").agg(F.count(F.lit(1)).alias("times"))
