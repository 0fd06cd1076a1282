"""Reading files into tables, and an index of chunks in which sources are replaced and deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages
from lexmill.functions.text import body, frontmatter_field, strip
from lexmill.operators.conversion import extension, route

# Files that aren't documents, types that are indexed.
IGNORED = ["Thumbs.db", "desktop.ini", ".DS_Store"]
INDEXED = ["pdf", "docx", "doc", "pptx", "ppt", "xlsx", "xls", "html", "htm", "md", "markdown", "txt", "csv", "json", "epub"]
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, indexed_only: bool = False) -> DataFrame:
    """path (relative), length, changed_at, head (8 bytes), sha and route of every file under root. Without `sha` and `head` in a
    later projection the content isn't read. `exclude`: globs on the file's name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString().rstrip("/") + "/"
    plain = lambda c: F.regexp_replace(c, r"\A[a-z0-9]+:/+", "/")  # noqa: E731  # schemes are written with one slash or three
    name = F.element_at(F.split("path", "/"), -1)
    files = files.filter(~name.isin(IGNORED))
    for glob in exclude or []:
        files = files.filter(~name.rlike(r"\A" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in glob) + r"\z"))
    head = F.hex(F.substring("content", 1, 8))
    legacy = head.startswith("D0CF11E0") & extension(F.col("path")).isin("docx", "xlsx", "pptx")  # the old container under a new name
    relative = F.substring(plain(F.col("path")), F.length(plain(F.lit(full))) + 1, F.lit(1 << 30))
    out = files.select(relative.alias("path"), "length", F.col("modificationTime").alias("changed_at"), head.alias("head"), F.sha2("content", 256).alias("sha"), F.when(legacy, "legacy").otherwise(route(F.col("path"))).alias("route"))
    return out.filter(extension(F.col("path")).isin(INDEXED)) if indexed_only else out


def texts(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, text, and of Markdown with a block of fields its source, quality and body."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    whole = F.col("value")
    return files.select(F.col("_metadata.file_path").alias("path"), whole.alias("text"), frontmatter_field(whole, "source").alias("source"), frontmatter_field(whole, "quality").alias("quality"), body(whole).alias("body"))


def html_to_text(html):
    """Text of an HTML column: scripts and styles gone, headings marked, blocks on lines of their own."""
    c = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", "")
    for n in range(1, 7):
        c = F.regexp_replace(c, rf"(?i)<h{n}[^>]*>", "\n\n" + "#" * n + " ")
    c = F.regexp_replace(c, r"(?i)<li[^>]*>", "\n- ")
    c = F.regexp_replace(c, r"(?i)<br[^>]*>|</?(?:p|div|tr|ul|ol|table|section|article|h[1-6])(?: [^>]*)?>", "\n")
    c = F.regexp_replace(c, r"<[^>]*>", "")
    for entity, to in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(to))
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n[ \t]*", "\n"), r"\n{3,}", "\n\n"))


BUCKETS = 64


def write_index(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Writes chunks (source and others) to the index at `path`: sources in `chunks` replace their older rows, all others stay."""
    _replace(chunks.sparkSession, chunks, chunks.select("source").distinct(), path, buckets)


def delete_sources(sources: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Takes the rows of `sources` (source) out of the index at `path`; an unknown source is no error."""
    _replace(sources.sparkSession, None, sources.select("source").distinct(), path, buckets)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """source and n_chunks of an index."""
    return spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("n_chunks"))


def _replace(spark: SparkSession, chunks: DataFrame | None, sources: DataFrame, path: str, buckets: int) -> None:
    """An index has a fixed number of folders, by the hash of the source. Folders that a change touches are merged in a table beside it, and then overwritten
    at once; those that come out empty are deleted."""
    bucket = F.pmod(F.xxhash64("source"), F.lit(buckets)).cast("int")
    stages = Stages(spark, "index")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = stages.write("sources", sources)
    touched = [r.bucket for r in gone.select(bucket.alias("bucket")).distinct().collect()]  # at most as many as folders
    rows = chunks.withColumn("bucket", bucket) if chunks is not None else None
    if fs.exists(where):
        kept = spark.read.parquet(path).filter(F.col("bucket").isin(touched)).join(gone, "source", "left_anti")
        rows = kept if rows is None else rows.unionByName(kept, allowMissingColumns=True)
    if rows is not None and touched:
        merged = stages.write("merged", rows.repartition("bucket"))
        merged.repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(path)
        left = {r.bucket for r in merged.select("bucket").distinct().collect()}
        for b in touched:
            if b not in left:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}"), True)
    stages.clear()
