"""Reciprocal-rank fusion of result lists, context under a token budget, and query assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions.text import estimate_tokens, strip
from folioflow.operators.lexical import top

RRF_K = 60
BUDGET = 32_000
SEPARATOR = "\n\n---\n\n"


def rrf(dense: DataFrame, sparse: DataFrame, k: int = 0, id_col: str = "doc_id", rrf_k: int = RRF_K) -> DataFrame:
    """(query_id, id, score, dense_rank, sparse_rank, rank): sums of 1 / (rrf_k + rank); rank 0 stands for not in the list, k <= 0 for all."""
    d = dense.select("query_id", id_col, F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", id_col, F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    fused = d.join(s, ["query_id", id_col], "full_outer").select("query_id", id_col, F.round(part("dense_rank") + part("sparse_rank"), 9).alias("score"), F.coalesce("dense_rank", F.lit(0)).alias("dense_rank"), F.coalesce("sparse_rank", F.lit(0)).alias("sparse_rank"))
    return top(fused, "query_id", "score", id_col, k if k > 0 else 2**31 - 1)


def with_content(fused: DataFrame, contents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Fused rows with the content of their documents ("" where unknown) and where they came from; the fused rows, few, go to the scan."""
    found = contents.join(F.broadcast(fused.select(id_col).distinct()), id_col, "left_semi")
    origin = F.when(F.col("dense_rank") == 0, "bm25_only").when(F.col("sparse_rank") == 0, "dense_only").otherwise("both")
    return fused.join(found, id_col, "left").withColumns({"content": F.coalesce("content", F.lit("")), "origin": origin})


def pack_context(results: DataFrame, budget: int = BUDGET, group: str = "query_id") -> DataFrame:
    """(group, context, n_used, tokens): "[rank] content" of results in rank order up to the first that would pass the budget; blank ones are left out but numbered."""
    rows = results.where(strip("content") != "").withColumn("tokens", estimate_tokens("content"))
    total = F.sum("tokens").over(Window.partitionBy(group).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    kept = rows.withColumn("_total", total).where(F.col("_total") <= budget)
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.col("content"))
    packed = kept.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("_l"), F.count(F.lit(1)).alias("n_used"), F.sum("tokens").alias("tokens"))
    return packed.select(group, F.array_join(F.transform("_l", lambda x: x["line"]), SEPARATOR).alias("context"), "n_used", "tokens")


def context_metrics(used: Column, window: int) -> dict[str, Column]:
    return {"used_tokens": used, "remaining_tokens": F.greatest(F.lit(window) - used, F.lit(0)), "usage_ratio": F.round(used / F.lit(window), 4)}


def input_weights(prompt: Column, selection: Column, written: Column) -> Column:
    """Shares of prompt, selection and written text: .5/.3/.2 of three, .7/.3 of selection and written text, the whole of written text alone, else of the prompt."""
    has = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    p, s, w = has(prompt), has(selection), has(written)
    share = lambda a, b, c: F.struct(F.lit(a).alias("prompt"), F.lit(b).alias("selection"), F.lit(c).alias("written"))
    return F.when(p & s & w, share(0.5, 0.3, 0.2)).when(s & w, share(0.0, 0.7, 0.3)).when(w, share(0.0, 0.0, 1.0)).otherwise(share(1.0, 0.0, 0.0))


def assemble_query(prompt: Column, selection: Column, written: Column, weights: Column) -> Column:
    """The non-empty texts by falling weight, two lines apart; selected and written text with their marks."""
    part = lambda place, weight, mark, c: F.when(F.coalesce(c, F.lit("")) != "", F.struct(weight.alias("weight"), F.lit(place).alias("place"), F.concat(F.lit(mark), c).alias("text")))
    parts = F.array(part(0, weights["prompt"], "", prompt), part(1, weights["selection"], "用户圈选的文本：", selection), part(2, weights["written"], "用户已写内容：", written))
    ordered = F.array_sort(F.filter(parts, lambda x: x.isNotNull()), lambda a, b: F.when(a["weight"] > b["weight"], -1).when(a["weight"] < b["weight"], 1).otherwise(a["place"] - b["place"]))
    return F.array_join(F.transform(ordered, lambda x: x["text"]), "\n\n")


def should_retrieve(enabled: Column, n_papers: Column, selection: Column) -> Column:
    return enabled & ((n_papers > 0) | (strip(F.coalesce(selection, F.lit(""))) != ""))


def last_messages(messages: DataFrame, n: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest n messages of each session, in the order they came (``place`` from 1)."""
    newest = top(messages, session, turn, turn, n).withColumnRenamed("rank", "_rank")
    return newest.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy(turn))).drop("_rank")


SUMMARY_HEAD = "（压缩降级）最近对话：\n"


def fallback_summary(messages: DataFrame, budget: int, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(session, kept, summary): the last six messages where they keep under four fifths of the budget, else the last two; each cut to 200 characters."""
    six = last_messages(messages, 6, session, turn)
    who = F.when(F.col("role") == "user", "用户").otherwise("助手")
    cut = F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("…"))).otherwise(F.coalesce("text", F.lit("")))
    item = F.struct(F.col(turn).alias("t"), F.concat(who, F.lit(": "), cut).alias("line"), F.coalesce("text", F.lit("")).alias("text"))
    rows = six.groupBy(session).agg(F.array_sort(F.collect_list(item)).alias("_m"))
    fits = estimate_tokens(F.array_join(F.transform("_m", lambda x: x["text"]), "\n")) < 0.8 * budget
    rows = rows.withColumn("_k", F.when(fits, F.col("_m")).otherwise(F.slice("_m", F.greatest(F.size("_m") - 1, F.lit(1)), 2)))
    return rows.select(session, F.size("_k").alias("kept"), F.concat(F.lit(SUMMARY_HEAD), F.array_join(F.transform("_k", lambda x: x["line"]), "\n")).alias("summary"))


def window_size(context: int, output: int, system: int, average: int) -> int:
    return max(4, (context - output - system) // average)


def parse_verdict(c: Column | str) -> Column:
    """(verdict, reason, direction) of a judge's JSON, with or without a code fence.

    Unknown verdicts are unsupported, unknown directions refine; of an answer that is no JSON the words decide, and it is its own reason.
    """
    c = F.col(c) if isinstance(c, str) else c
    bare = strip(F.coalesce(c, F.lit("")))
    bare = F.when(bare.startswith("```"), F.regexp_replace(F.regexp_replace(bare, r"\A[^\n]*\n?", ""), r"\n?\s*```\s*\z", "")).otherwise(bare)
    v = F.from_json(bare, "verdict string, reason string, direction string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    bad = v.isNull() | v["_bad"].isNotNull() | ~bare.startswith("{")
    told = F.lower(F.coalesce(v["verdict"], F.lit("")))
    way = F.lower(F.coalesce(v["direction"], F.lit("")))
    words = F.when(F.lower(bare).contains("supported") & ~F.lower(bare).contains("unsupported"), "supported").otherwise("unsupported")
    return F.struct(
        F.when(bad, words).when(told.isin("supported", "unsupported"), told).otherwise("unsupported").alias("verdict"),
        F.when(bad, bare).otherwise(F.coalesce(v["reason"], F.lit(""))).alias("reason"),
        F.when(bad | ~way.isin("refine", "rephrase"), "refine").otherwise(way).alias("direction"),
    )


def evidence_loop(retrieve, judge, rewrite, query: str, k: int = 20, rounds: int = 3, switches: int = 2):
    """Retrieves, has the results judged, and goes on with twice as many (50 at most) or another query until they are ``supported``; (results, verdict, rounds used)."""
    used = switched = 0
    results, verdict = retrieve(query, k), "insufficient"
    while used < rounds:
        used += 1
        verdict = judge(query, results)
        if verdict == "supported" or used == rounds:
            break
        if verdict == "insufficient":
            k = min(2 * k, 50)
        elif switched < switches:
            switched += 1
            query = rewrite(query, verdict)
        else:
            break
        results = retrieve(query, k)
    return results, verdict, used


def without(metadata: Column | str, *keys: str) -> Column:
    """A map without these keys, as a search result's fields go beside its content."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(*keys))


def in_order(answers: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """(group, values): what came back for one request, by the index that each answer carries, since answers may come in any order. A request is one batch, so its list is short."""
    return answers.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda x: x[value]).alias("values"))
