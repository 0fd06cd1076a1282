import shutil

from pyspark.sql import functions as F

from lexmill.sources import files
from lexmill.streaming import ingest


def test_scan_and_texts(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "a.md").write_text("---\nsource: x.pdf\nquality: suspect\n---\n\nbody", encoding="utf-8")
    (tmp_path / "d" / "e" / "b.docx").write_bytes(bytes.fromhex("D0CF11E0A1B11AE1") + b"x")
    (tmp_path / "d" / "Thumbs.db").write_bytes(b"x")
    (tmp_path / "d" / "skip_me.txt").write_text("y")
    (tmp_path / "d" / "z.bin").write_bytes(b"y")
    got = {r.path: r.route for r in files.scan(spark, str(tmp_path / "d"), exclude=["skip*.txt"]).collect()}
    assert got == {"a.md": "native", "e/b.docx": "legacy", "z.bin": "unsupported"}
    assert files.scan(spark, str(tmp_path / "d"), indexed_only=True).count() == 3
    row = files.texts(spark, str(tmp_path / "d")).collect()[0]
    assert (row.source, row.quality, row.body) == ("x.pdf", "suspect", "body")
    html = spark.createDataFrame([("<h1>T</h1><p>a &amp; b<br>c</p><script>x</script><ul><li>i</li></ul>",)], "h string")
    assert html.select(files.html_to_text(F.col("h")).alias("t")).first().t == "# T\n\na & b\nc\n\n- i"


def test_continuous_index(spark, small, tmp_path):
    shutil.copy(f"{small}/documents.parquet", tmp_path / "documents.parquet")
    (tmp_path / "in").mkdir()
    documents = spark.read.parquet(f"{small}/documents.parquet")
    documents.filter("doc_id % 2 = 0").write.parquet(str(tmp_path / "in" / "one"))
    stream = ingest.arrivals(spark, str(tmp_path / "in" / "*"), documents.schema)
    for _ in range(2):
        ingest.index_continuously(stream, str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
        documents.filter("doc_id % 2 = 1").write.mode("overwrite").parquet(str(tmp_path / "in" / "two"))
    index = spark.read.parquet(str(tmp_path / "index"))
    want = documents.filter("length(trim(text)) > 0").select("doc_id").distinct().count()
    assert abs(index.select("source").distinct().count() - want) <= 5 and index.count() >= want - 5
    counts = ingest.deliveries_by_case(ingest.arrivals(spark, str(tmp_path / "in" / "*"), documents.schema))
    q = counts.writeStream.format("memory").queryName("deliveries").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deliveries").agg(F.sum("n")).first()[0] > 0


def test_index_replaces_and_deletes_sources(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = lambda *given: spark.createDataFrame(list(given), "source string, ord int, text string")
    files.write_index(rows(("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")), path, buckets=2)
    files.write_index(rows(("a", 0, "new"), ("c", 0, "w")), path, buckets=2)
    assert sorted((r.source, r.ord, r.text) for r in spark.read.parquet(path).collect()) == [("a", 0, "new"), ("b", 0, "z"), ("c", 0, "w")]
    files.delete_sources(spark.createDataFrame([("a",), ("nothing",), ("c",)], "source string"), path, buckets=2)
    assert {r.source: r.n_chunks for r in files.manifest(spark, path).collect()} == {"b": 1}
    files.write_index(rows(("b", 0, "z2")).limit(0), path, buckets=2)
    assert spark.read.parquet(path).count() == 1
