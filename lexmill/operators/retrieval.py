"""Retrieval: inverted index, BM25, exact cosine, fusion of ranks, reranking, parents.

Queries are tables; one query is a table of one row. Every channel is a join and a ranking in the window of its query.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import tokens

#: Bytes that a block of query vectors may have when it is sent to all tasks; more queries are more blocks.
BLOCK_BYTES = 32 << 20


def postings(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, term, tf and dl (terms of the row), counted before anything is shuffled by term."""
    t = docs.select(key, tokens(text).alias("terms")).filter(F.size("terms") > 0)
    return t.select(key, F.size("terms").alias("dl"), F.explode("terms").alias("term")).groupBy(key, "dl", "term").agg(F.count("*").alias("tf"))


def bm25(index: DataFrame, key: str, queries: DataFrame, k: int, k1: float = 1.2, b: float = 0.75, scope: str | None = None) -> DataFrame:
    """query, rank (from 0), key and score of the k best rows for each query (query, term). Ties by key.

    Document frequencies are needed for the queries' terms only, and are counted for those. With `scope`, a column of the index, a query
    ranks only the rows whose scope is its name; statistics are those of all rows.
    """
    terms = queries.select("query", "term").distinct()
    wanted = terms.select("term").distinct()
    hits = index.join(wanted, "term", "left_semi")
    n, avgdl = index.select(key, "dl").distinct().agg(F.count("*"), F.avg("dl")).first()
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    idf = df.select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / (avgdl or 1.0)))
    asked = hits.join(terms, "term") if scope is None else hits.join(terms.withColumn(scope, F.col("query")), ["term", scope])
    scored = asked.join(idf, "term").groupBy("query", key).agg(F.round(F.sum(part), 4).alias("score"))
    return ranked(scored, key, k)


def first(scored: DataFrame, order, k: int) -> DataFrame:
    """The first k rows of each window with their rank from 0. The limit is on the row number itself, so that every task keeps k rows of a window before the shuffle."""
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def ranked(scored: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), key)
    return first(scored, order, k)


def cosine(vectors: DataFrame, key: str, column: str, queries: DataFrame, k: int, floor: float | None = None, exclude_self: bool = False) -> DataFrame:
    """query, rank, key and score of the k nearest rows for each query (query, vector), exactly.

    Query vectors go to the tasks in blocks of bounded size; a task scores its batch against a block as one matrix product and
    keeps k for each query, so k rows for each query and task are shuffled. A floor is applied to the k rows, not before.
    """
    spark = vectors.sparkSession
    width = len(queries.first().vector) if not queries.isEmpty() else 0
    if not width:
        return spark.createDataFrame([], f"query bigint, {key} bigint, score double, rank int")
    per_block = max(1, BLOCK_BYTES // (8 * width))
    n = queries.count()
    blocks = -(-n // per_block)
    parts = queries.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    found = None
    for block in range(blocks):
        rows = parts.filter(F.col("block") == block).orderBy("query").collect()  # at most about BLOCK_BYTES
        names, matrix = np.array([r.query for r in rows]), np.array([r.vector for r in rows], float).reshape(len(rows), width)
        matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((names, matrix))

        def score(frames, sent=sent):
            import pandas as pd

            names, matrix = sent.value
            for frame in frames:
                if not len(frame):
                    continue
                keys, given = frame[key].to_numpy(), np.array(frame[column].tolist(), float)
                length = np.linalg.norm(given, axis=1)
                s = matrix @ (given / np.maximum(length, 1e-300)[:, None]).T
                s[:, length == 0] = -np.inf
                if exclude_self:
                    s[names[:, None] == keys[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(keys, s.shape), -np.round(s, 10)), axis=1)[:, :k]
                q, d = np.repeat(np.arange(len(names)), order.shape[1]), order.ravel()
                good = np.isfinite(s[q, d])
                yield pd.DataFrame({"query": names[q[good]], key: keys[d[good]], "score": s[q, d][good]})

        one = vectors.select(key, column).filter(F.col(column).isNotNull()).mapInPandas(score, f"query bigint, {key} bigint, score double")
        found = one if found is None else found.unionAll(one)
    top = ranked(found.withColumn("score", F.round("score", 10)), key, k).withColumn("score", F.round("score", 4))
    return top if floor is None else top.filter(F.col("score") >= floor)


def fuse(vector: DataFrame, text: DataFrame, key: str, k: int, rrf_k: int = 60) -> DataFrame:
    """Reciprocal ranks summed over both channels (query, key, rank); ties go to what the vector channel has first."""
    both = vector.select("query", key, "rank", F.lit(0).alias("channel")).unionByName(text.select("query", key, "rank", F.lit(1).alias("channel")))
    score = both.groupBy("query", key).agg(F.round(F.sum(1 / (F.lit(rrf_k) + F.col("rank"))), 6).alias("score"), F.min(F.struct("channel", "rank")).alias("first"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "first", key)
    return first(score, order, k).select("query", "rank", key, "score")


def rerank(hits: DataFrame, key: str, docs: DataFrame, text: Column, queries: DataFrame, k: int) -> DataFrame:
    """Hits in the order of the share of the query's terms that a row has (a stand-in for a model's score), then of their rank."""
    wanted = queries.groupBy("query").agg(F.collect_set("term").alias("wanted"))
    few = docs.join(hits.select(key).distinct(), key, "left_semi")  # only the hits' texts are cut into terms
    own = few.select(key, F.array_distinct(tokens(text)).alias("own"))
    scored = hits.join(wanted, "query").join(own, key)
    scored = scored.select("query", key, "rank", F.round(F.size(F.array_intersect("own", "wanted")) / F.size("wanted"), 6).alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "was")
    return first(scored.withColumnRenamed("rank", "was"), order, k).select("query", "rank", key, "score")


def parents(chunks: DataFrame) -> DataFrame:
    """source, parent_ord and the parent's text: its chunks in order."""
    return chunks.filter("parent_ord is not null").groupBy("source", "config_id", "parent_ord").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("parent_text")
    )
