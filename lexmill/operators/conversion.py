"""Decisions around conversion: routes, names, quality, agreement of two readings, what is to do, and the gate."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.functions.text import WS, norm_reading

# Which file types go which way.
ROUTES = {
    "native": ["docx", "pptx", "xlsx", "html", "htm", "md", "txt", "csv", "json", "xml", "epub"],
    "image": ["png", "jpg", "jpeg", "tif", "tiff", "bmp", "gif", "webp"],
    "legacy": ["doc", "wps"],
    "anydoc": ["ppt", "xls", "xlsb"],
}
#: Punctuation that isn't garbage besides letters, digits and blanks.
PLAIN = r"\s\p{L}\p{N}.,;:!?'\"()\[\]{}<>/\\|@#$%&*+=~`^_\-。，、；：！？“”‘’（）《》〈〉【】「」『』〔〕—–…·￥¥€£°§¶«»№×÷±%‰→←"
LEAST_CHARS, LEAST_PER_PAGE, MOST_GARBLED, MOST_REPEATED, LEAST_CONFIDENCE = 20, 50, 0.02, 30, 0.6


def extension(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(F.locate(".", name) > 1, F.lower(F.substring_index(name, ".", -1))).otherwise("")


def route(path: Column, chars_per_page: Column | None = None) -> Column:
    """native, ocr, legacy, anydoc or unsupported; a pdf goes by the characters of its pages."""
    ext = extension(path)
    out = F.when(ext.isin(ROUTES["native"]), "native").when(ext.isin(ROUTES["image"]), "ocr").when(ext.isin(ROUTES["legacy"]), "legacy").when(ext.isin(ROUTES["anydoc"]), "anydoc")
    if chars_per_page is not None:
        out = out.when((ext == "pdf") & (chars_per_page >= LEAST_PER_PAGE), "native")
    return out.when(ext == "pdf", "ocr").otherwise("unsupported")


def output_names(files: DataFrame, path: str) -> DataFrame:
    """Adds out_path: the path with `.md` for its extension, or after it where another file of the folder has the same stem."""
    ext = F.concat(F.lit("."), extension(F.col(path)))
    stem = F.when(ext != ".", F.substring(F.col(path), F.lit(1), F.length(F.col(path)) - F.length(ext))).otherwise(F.col(path))
    named = files.withColumn("stem", stem)
    many = named.groupBy("stem").agg(F.count("*").alias("n_same"))  # counted before the shuffle, so a stem of very many files is no hot group
    both = named.join(many, "stem")
    return both.withColumn("out_path", F.concat(F.when(F.col("n_same") > 1, F.col(path)).otherwise(F.col("stem")), F.lit(".md"))).drop("stem", "n_same")


def quality(results: DataFrame) -> DataFrame:
    """Adds n_chars (not blank), garbled (share), most_repeated (the most that a line of over 10 characters comes), low (lines of low confidence) and suspect."""
    text = F.coalesce("text", F.lit(""))
    solid = F.length(F.regexp_replace(text, WS, ""))
    bad = F.length(text) - F.length(F.regexp_replace(text, f"[^{PLAIN}]", ""))
    each = results.withColumn("n_chars", solid).withColumn("garbled", F.round(F.when(solid > 0, bad / solid).otherwise(0.0), 4))
    long = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 10)
    each = each.withColumn("most_repeated", _longest_run(F.array_sort(long)))
    each = each.withColumn("low", F.when(F.col("confidences").isNotNull(), F.size(F.filter("confidences", lambda c: c < LEAST_CONFIDENCE))).otherwise(0))
    thin = (F.col("pages") >= 2) & (F.floor(F.col("n_chars") / F.col("pages")) < LEAST_PER_PAGE)
    suspect = (F.col("n_chars") < LEAST_CHARS) | F.coalesce(thin, F.lit(False)) | (F.col("garbled") > MOST_GARBLED) | (F.col("most_repeated") > MOST_REPEATED) | (F.col("low") > 0)
    return each.withColumn("suspect", suspect)


def reasons(assessed: DataFrame) -> Column:
    """The signs of `quality` in words, in a fixed order (fixed texts)."""
    per_page = F.floor(F.col("n_chars") / F.col("pages"))
    return F.array_compact(
        F.array(
            F.when(F.col("n_chars") < LEAST_CHARS, F.format_string("near-empty output (%d chars)", F.col("n_chars"))),
            F.when((F.col("pages") >= 2) & (per_page < LEAST_PER_PAGE), F.format_string("avg %d chars/page over %d pages", per_page, F.col("pages"))),
            F.when(F.col("garbled") > MOST_GARBLED, F.format_string("garbled-char ratio %.1f%%", F.col("garbled") * 100)),
            F.when(F.col("most_repeated") > MOST_REPEATED, F.format_string("line repeated %dx (possible OCR loop)", F.col("most_repeated"))),
            F.when(F.col("low") > 0, F.format_string("%d low-confidence OCR region(s), min %.2f", F.col("low"), F.array_min("confidences"))),
        )
    )


def _longest_run(ordered: Column) -> Column:
    """How often the most frequent item of a sorted array comes, in one pass."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"].eqNullSafe(x), acc["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(ordered, start, step, lambda acc: acc["best"])


def digit_mismatches(a: Column, b: Column) -> Column:
    """Numbers (with a unit of a date) of two readings that differ position by position, plus how many one has more."""
    x, y = (F.regexp_extract_all(norm_reading(c), F.lit(r"\d+[年月日]?"), 0) for c in (a, b))
    n = F.least(F.size(x), F.size(y))
    pairs = F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: (p != q).cast("int"))
    return F.abs(F.size(x) - F.size(y)) + F.aggregate(pairs, F.lit(0), lambda s, v: s + v)


@F.pandas_udf(T.DoubleType())
def disagreement(a, b):
    """1 - the ratio of matching blocks of two readings, line by line where both have as many lines (their lengths are weights)."""
    import pandas as pd

    def one(x, y):
        x, y = (x or "").split("\n"), (y or "").split("\n")
        if len(x) != len(y):
            x, y = ["\n".join(x)], ["\n".join(y)]
        same = sum(len(p) + len(q) if p == q else difflib.SequenceMatcher(None, p, q, autojunk=False).ratio() * (len(p) + len(q)) for p, q in zip(x, y))
        total = sum(map(len, x)) + sum(map(len, y))
        return 1 - same / total if total else 0.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def to_do(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Sources without an up-to-date output: none there, older than the source, or made from other content. `sources`: key, changed_at, sha; `done`: key, made_at, made_from."""
    same = (sources[key] == done[key]) & (done["made_at"] >= sources["changed_at"]) & (done["made_from"].isNull() | (done["made_from"] == sources["sha"]))
    return sources.join(done, same, "left_anti")


def gate(cases: DataFrame) -> DataFrame:
    """Adds exit_code from failed, indexed, expected, unresolved: 1 failures, 3 incomplete or unresolved, 0 passed."""
    return cases.withColumn("exit_code", F.when(F.col("failed") > 0, 1).when((F.col("indexed") < F.col("expected")) | (F.col("unresolved") > 0), 3).otherwise(0))
