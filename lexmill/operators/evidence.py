"""Lines that have given terms, exactly, with a cap for each term that is reported; all evidence for questions in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X

GRAM = 2


def find_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """term, doc_id, line_no where `wanted` of `terms` (term, wanted) is in `norm` of `rows` (doc_id, line_no, norm); an empty `wanted` is nowhere.

    A term is looked for in the lines that have its first pair of characters (or its one character), so both sides are joined on equal keys, whatever
    their number; a side that is known to be small is sent to the tasks by the optimizer. A pair that very many lines and terms share is split by AQE.
    """
    terms = terms.filter("wanted != ''").distinct().withColumn("gram", F.substring("wanted", 1, GRAM))
    pairs = F.regexp_extract_all("norm", F.lit(r"(?s)(?=(.{2}))"), 1)
    single = terms.filter(F.length("gram") < GRAM)
    found = rows.select("doc_id", "line_no", "norm", F.explode(F.array_distinct(pairs)).alias("gram")).join(terms, "gram").filter(F.contains("norm", "wanted"))
    ones = rows.select("doc_id", "line_no", F.explode(F.array_distinct(F.split("norm", ""))).alias("gram")).join(single, "gram")
    return found.select("term", "doc_id", "line_no").unionByName(ones.select("term", "doc_id", "line_no"))


def capped(hits: DataFrame, most: int = 20) -> DataFrame:
    """The first `most` hits of each term, by document and line, and whether there are more."""
    found = hits.withColumn("k", F.row_number().over(Window.partitionBy("term").orderBy("doc_id", "line_no"))).filter(F.col("k") <= most + 1)
    more = found.filter(F.col("k") == most + 1).select("term", F.lit(True).alias("truncated"))
    return found.filter(F.col("k") <= most).join(more, "term", "left").select("term", "doc_id", "line_no", F.coalesce("truncated", F.lit(False)).alias("truncated"))


def bundle(hits: DataFrame, asked: DataFrame, grep: DataFrame, docs: DataFrame, heads: DataFrame) -> DataFrame:
    """All evidence for each query, in rows of four kinds.

    `hit`: what retrieval found (query, rank, doc_id, score), with its whole text as one line in the anchor. `grep`: the lines (term, doc_id, line_no,
    truncated) that have the exact terms asked for (query, term), anchored as well. `not_found`: terms asked for that no line has. `outline`: every
    heading of the documents searched; these rows hold for all queries and stand once, with a null query.
    """
    quoted = lambda text, quote: X.anchor(F.concat(F.lit("_md/"), "doc_id", F.lit(".md")), X.snippet(quote), F.coalesce(X.frontmatter_field(text, "quality") == "suspect", F.lit(False)))
    text = F.col("text")
    docs = docs.filter("text is not null").select("doc_id", "text")
    # Only the texts that were hit are shuffled; a hit without a text stays.
    whole = docs.join(hits.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", quoted(text, X.body(text)).alias("anchor"))
    counts = heads.groupBy("doc_id").agg(F.count("*").alias("n_headings"), F.min_by("title", "idx").alias("first_heading"))
    first = hits.join(whole, "doc_id", "left").join(counts, "doc_id", "left").select(F.lit("hit").alias("kind"), "query", "rank", "doc_id", "score", "anchor", F.coalesce("n_headings", F.lit(0)).alias("n_headings"), "first_heading")
    asked = asked.distinct()
    lines = docs.join(grep, "doc_id").select("term", "doc_id", "line_no", "truncated", quoted(text, F.get(F.split(text, "\r?\n", -1), F.col("line_no"))).alias("anchor"))
    second = asked.join(lines, "term").withColumn("kind", F.lit("grep"))
    third = asked.join(grep.select("term").distinct(), "term", "left_anti").withColumn("kind", F.lit("not_found"))
    fourth = heads.withColumn("kind", F.lit("outline"))
    out = first
    for rows in (second, third, fourth):
        out = out.unionByName(rows, allowMissingColumns=True)
    return out
