"""Verification of citations, links, dates and sums in texts, and the ledgers of what is covered."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import body, fragments, frontmatter_field, norm_quote, strip
from lexmill.operators.sections import lines

# The forms that pages are written in.
ANCHOR = r"〔来源:[ \t]*([^\n：]+?)：「([^\n]+?)」〕"
WIKILINK = r"\[\[([^\[\]\n]+)\]\]"
NOT_FOUND = "未在本案材料中找到"
SECTION_NAMES = (
    "回答 结论 本案结论 摘要 案件摘要 概览 案件概况 事实 案件事实 事实依据 证据 证据依据 依据 说明 分析 法律分析 检索结果 材料情况 付款情况 争议焦点 时间线 案件主体 法律关系 风险 风险提示 建议 待核实事项 案件索引".split() + ["案件 wiki 索引"]
)
NAVIGATION = ["", "见", "参见", "另见", "主体", "相关主体", "相关页面", "相关法律事实", "关系"]
DATE = r"(\d{4})[ ]*年(?:[ ]*(\d{1,2})[ ]*月)?(?:[ ]*(\d{1,2})[ ]*日)?"


def anchors(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, anchor_no, source, quote and whether `（未核验）` follows, of every citation."""
    whole = F.regexp_extract_all(F.col(text), F.lit(ANCHOR + r"(?:[ \t]*（未核验）)?"), 0)
    return pages.select(key, F.posexplode(whole).alias("anchor_no", "a")).select(
        key, "anchor_no", F.regexp_extract("a", ANCHOR, 1).alias("source"), F.regexp_extract("a", ANCHOR, 2).alias("quote"), F.col("a").endswith("（未核验）").alias("marked")
    )


def verify_anchors(found: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds verdict to citations: missing (no such source), mismatch (a part isn't there, or not in order), unmarked (its source is
    suspect and the citation isn't marked) or ok. `sources`: source, body, suspect."""
    parts = F.transform(fragments(F.col("quote")), norm_quote)
    joined = found.join(sources, "source", "left")
    fits = with_fits(joined.withColumn("parts", parts).withColumn("where", norm_quote(F.col("body"))))
    verdict = F.when(F.col("body").isNull(), "missing").when(~F.col("fits"), "mismatch").when(F.col("suspect") & ~F.col("marked"), "unmarked").otherwise("ok")
    return fits.withColumn("verdict", verdict).drop("parts", "where", "fits", "body", "suspect")


def with_fits(rows: DataFrame) -> DataFrame:
    """rows (parts, where) with `fits`."""
    return rows.withColumn("fits", F.expr("aggregate(parts, 1, (at, p) -> CASE WHEN at = 0 OR locate(p, where, at) = 0 THEN 0 ELSE locate(p, where, at) + length(p) END) > 0"))


def closed_world(path: Column, root: str = "_md") -> Column:
    """Whether a relative path stays inside a folder once `.` and `..` are resolved."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    resolved = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p))))
    return ~path.startswith("/") & (F.size(resolved) > 1) & (F.get(resolved, F.lit(0)) == root)


def links(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, target of every wiki link that leads to another page: what is before `|` and `#`."""
    raw = pages.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(WIKILINK), 1)).alias("raw"))
    return raw.select(key, F.trim(F.substring_index(F.substring_index("raw", "|", 1), "#", 1)).alias("target")).filter("target != ''")


def dead_links(found: DataFrame, names: DataFrame) -> DataFrame:
    """Links to no page's name. `names`: name (titles and aliases)."""
    return found.join(names.select(F.col("name").alias("target")).distinct(), "target", "left_anti")


def date_parts(line: Column) -> Column:
    """The first date of a line as [year, month, day], as far as it is given; null without one."""
    whole = F.regexp_extract(line, DATE, 0)
    parts = F.filter(F.array(*(F.regexp_extract(line, DATE, i) for i in (1, 2, 3))), lambda p: p != "")
    return F.when(whole != "", F.transform(parts, lambda p: p.cast("int")))


def out_of_order(entries: DataFrame, page: str, order: str, line: str, width: int = 50_000) -> DataFrame:
    """Dated entries that are earlier than the dated one before them on their page, compared as far as both dates go.

    A page is worked on in stretches of `width` of its (integer) order, and only the last entry of each stretch goes to the next one,
    so a page with a large share of all entries is spread over tasks.
    """
    dated = entries.withColumn("date", date_parts(F.col(line))).filter("date is not null").withColumn("stretch", F.floor(F.col(order) / width))
    last = dated.groupBy(page, "stretch").agg(F.max_by("date", order).alias("final"))
    last = last.withColumn("carried", F.lag("final").over(Window.partitionBy(page).orderBy("stretch"))).drop("final")
    own = F.lag("date").over(Window.partitionBy(page, "stretch").orderBy(order))
    both = dated.withColumn("own", own).join(last, [page, "stretch"]).withColumn("before", F.coalesce("own", "carried"))
    common = F.least(F.size("date"), F.size("before"))
    return both.filter(F.col("before").isNotNull() & (F.slice("date", F.lit(1), common) < F.slice("before", F.lit(1), common)))


def closures(checks: DataFrame, column: str) -> DataFrame:
    """Adds verdict to lines `> [!check] left == right`: ok, wrong (by more than 1e-6) or unreadable.

    Each side is numbers with `+`, `-`, `*`, signs and brackets; anything else is unreadable. Full-width marks and commas between digits are read as they are meant.
    """

    @F.pandas_udf("string")
    def verdict(claims):
        import pandas as pd

        return pd.Series([_verdict(c) for c in claims], dtype=object)

    claim = F.translate(F.regexp_extract(column, r"\A>[ ]*\[!check\][ ]*([^\n]+)\z", 1), "，（）＋－＊＝０１２３４５６７８９", ",()+-*=0123456789")
    return checks.withColumn("verdict", verdict(F.regexp_replace(claim, r"[\s,]", "")))


def _verdict(claim: str) -> str:
    sides = (claim or "").split("==")
    if len(sides) != 2:
        return "unreadable"
    values = [_value(x) for x in sides]
    if None in values:
        return "unreadable"
    return "ok" if abs(values[0] - values[1]) <= 1e-6 else "wrong"


def _value(text: str) -> float | None:
    """Value of a sum of products; brackets are worked out from the innermost outwards, null where something is left over."""
    number = r"(?:\d+\.?\d*|\.\d+)"
    while True:
        inner = re.search(r"\(([^()]*)\)", text)
        part = inner.group(1) if inner else text
        if not re.fullmatch(rf"[+-]*{number}(?:[+*-][+-]*{number})*", part):
            return None
        total = 0.0
        for sign, product in re.findall(rf"((?:\A|(?<=[\d.]))[+-]*)({number}(?:\*[+-]*{number})*)", part):
            value = -1.0 if sign.count("-") % 2 else 1.0
            for factor in product.split("*"):
                value *= float(factor.lstrip("+-")) * (-1 if factor.count("-") % 2 else 1)
            total += value
        if not inner:
            return total
        text = f"{text[: inner.start()]}{'-' if total < 0 else ''}{abs(total):.10f}{text[inner.end() :]}"


def provenance(pages: DataFrame, originals: DataFrame, text: str = "text") -> DataFrame:
    """pages with `findings`, for those that have any, in a fixed order: legacy (no version), unsupported (another version than 1), incomplete (a source or hash is
    missing), then no original or original changed, then body changed (fixed terms). `originals`: source, sha (of the file as it is now)."""
    own = ("provenance_version", "source", "source_sha256", "content_sha256")
    read = pages.select("*", *(frontmatter_field(F.col(text), k).alias(f"_{k}") for k in own), F.sha2(body(F.col(text)), 256).alias("_now"))
    joined = read.join(originals.select(F.col("source").alias("_source"), F.col("sha").alias("_sha")), "_source", "left")
    version, missing = F.col("_provenance_version"), F.col("_source").isNull() | F.col("_source_sha256").isNull() | F.col("_content_sha256").isNull()
    head = F.when(version.isNull(), "legacy").when(version != "1", "unsupported").when(missing, "incomplete")
    original = F.when(F.col("_source_sha256").isNotNull(), F.when(F.col("_sha").isNull(), "no original").when(F.col("_sha") != F.col("_source_sha256"), "original changed"))
    changed = F.when(F.col("_now") != F.col("_content_sha256"), "body changed")
    found = joined.withColumn("findings", F.array_join(F.array_compact(F.array(head, original, changed)), ", "))
    return found.filter("findings != ''").drop(*(f"_{k}" for k in own), "_now", "_sha")


def gate(drafts: DataFrame, key: str, sources: DataFrame, text: str = "text", root: str = "_md") -> DataFrame:
    """key, n_failed (citations that don't hold), n_outside (of sources outside of `root`), n_checks (sums that are wrong or unreadable), n_bare (lines without a citation) and exit_code
    (1 if there is any) of every draft."""
    found = anchors(drafts, key, text)
    failed = verify_anchors(found, sources).groupBy(key).agg(F.count_if(F.col("verdict") != "ok").alias("n_failed"), F.count_if(~closed_world(F.col("source"), root)).alias("n_outside"))
    sums = lines(drafts, key, text).filter(F.col("line").rlike(r">\s*\[!check\]"))
    wrong = closures(sums, "line").filter("verdict != 'ok'").groupBy(key).agg(F.count("*").alias("n_checks"))
    bare = unanchored(drafts, key, text).groupBy(key).agg(F.count("*").alias("n_bare"))
    joined = drafts.select(key).join(failed, key, "left").join(wrong, key, "left").join(bare, key, "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_failed", "n_outside", "n_checks", "n_bare")]
    return joined.select(key, *counts).withColumn("exit_code", F.when(F.expr("n_failed + n_outside + n_checks + n_bare > 0"), 1).otherwise(0))


def skip_ledger(logs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """path, has_reason from log texts: `## [date] skip | path`, and `- 原因：...` below it before any other heading; a path with a reason once has one."""
    rows = lines(logs, key, text)
    entry, reason = r"\A##[ ]*\[\d{4}-\d{2}-\d{2}\][ ]*skip[ ]*\|[ ]*([^\n]*[^ \n])[ ]*\z", r"\A[ ]*-[ ]*原因[:：]([^\n]*)\z"
    so_far = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("line").rlike(entry), F.replace(F.regexp_extract("line", entry, 1), F.lit("\\"), F.lit("/"))).when(F.col("line").startswith("#"), "")
    rows = rows.withColumn("path", F.last(mark, ignorenulls=True).over(so_far)).filter("path != ''")
    has = F.col("line").rlike(reason) & (F.trim(F.regexp_extract("line", reason, 1)) != "")
    return rows.groupBy("path").agg(F.bool_or(has).alias("has_reason"))


def coverage(sources: DataFrame, cited: DataFrame, skips: DataFrame) -> DataFrame:
    """path, state of every source: cited (a citation wins), skipped (with a reason), unresolved."""
    joined = sources.select("path").join(cited.select("path").distinct().withColumn("cited", F.lit(True)), "path", "left").join(skips, "path", "left")
    return joined.select("path", F.when(F.col("cited"), "cited").when(F.col("has_reason"), "skipped").otherwise("unresolved").alias("state"))


def unanchored(pages: DataFrame, key: str, text: str = "text", title: str | None = None, navigation: bool = False) -> DataFrame:
    """key, line_no, line of factual lines without a citation that ends them.

    Exempt are blank lines, rules, marks of fences (not what is in them), lines of analysis (a note callout that says so, with what continues it), sums to
    check, heads of callouts, headings that only name a section, the first heading where it is the column `title`, a table's rule and the row above it, the phrase for what wasn't
    found, and with `navigation` rows of links. A line with a citation must end with it, but for punctuation and the mark of suspect sources.
    """
    order = Window.partitionBy(key).orderBy("line_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines(pages.withColumn("_body", body(F.col(text))), key, "_body")
    if title:
        rows = rows.join(pages.select(key, F.col(title).alias("_title")), key)
    given = strip(F.col("line"))
    rows = rows.withColumn("s", given).withColumn("quoted", given.startswith(">"))
    skip = (F.col("s") == "") | F.col("s").rlike(r"\A[-*_]{3,}\z") | F.col("s").startswith("```")
    state = F.when(skip, None).when(F.col("s").rlike(r"\A>\s*\[!note\]\s*分析(?:（非本案证据）)?\s*\z"), 1).when(F.col("quoted"), None).otherwise(0)
    rows = rows.withColumn("skip", skip).withColumn("analysis", F.coalesce(F.last(state, ignorenulls=True).over(so_far), F.lit(0)) == 1)
    rows = rows.withColumn("t", F.when(F.col("quoted"), F.regexp_replace("s", r"\A[> ]+", "")).otherwise(F.col("s")))
    rule = F.col("s").rlike(r"\A\|?[\s:|-]+\|?\z")
    rows = rows.withColumn("head_row", F.col("t").rlike(r"(?s)\A\|.*\|\z") & F.coalesce(F.lead(rule).over(order), F.lit(False)))
    name = F.when(F.col("t").startswith("#"), F.regexp_replace("t", r"\A[# ]+", ""))
    rows = rows.withColumn("heading", F.when(~F.col("skip") & ~F.col("analysis"), name))
    rows = rows.withColumn("n_heading", F.count("heading").over(so_far))
    label = F.coalesce(F.col("heading").isin(SECTION_NAMES), F.lit(False))
    if title:
        label |= F.coalesce((F.col("heading") == F.col("_title")) & (F.col("n_heading") == 1), F.lit(False))
    mark = F.col("t").startswith("[!check]") | F.col("t").rlike(r"\A(?:\[!warning\]\s*⚠?\s*冲突|\[!caution\]\s*含未核验来源)\z")
    after = F.element_at(F.split("t", ANCHOR, -1), -1)
    cited = F.col("t").rlike(ANCHOR) & after.rlike(r"\A(?:[ \t]*（未核验）)?[ \t，,。；;：:|]*\z")
    exempt = F.col("skip") | F.col("analysis") | (F.col("t") == "") | F.col("t").rlike(r"\A\|?[\s:|-]+\|?\z") | mark | label | F.col("head_row") | cited | F.col("t").rlike(rf"\A{NOT_FOUND}[。！？]?\z")
    if navigation:
        rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("t", r"\[\[[^\[\]\n|]+\]\]", ""), r"\A[-*+]\s*", ""), r"\A[ \t，,。；;：:]+|[ \t，,。；;：:]+\z", "")
        exempt |= F.col("t").rlike(r"\[\[") & rest.isin(NAVIGATION)
    return rows.filter(~exempt).select(key, "line_no", F.col("t").alias("line"))


def claims(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, line_no, claim_no, claim (what stands before a citation, from the one before it on), source, quote; headings have none."""
    rows = lines(pages, key, text).filter(~F.col("line").startswith("#") & F.col("line").contains("〔来源:"))
    before = F.split("line", ANCHOR + r"(?:[ \t]*（未核验）)?", -1)
    each = F.arrays_zip(F.slice(before, F.lit(1), F.size(before) - 1).alias("claim"), F.regexp_extract_all("line", F.lit(ANCHOR), 1).alias("source"), F.regexp_extract_all("line", F.lit(ANCHOR), 2).alias("quote"))
    return rows.select(key, "line_no", F.posexplode(each).alias("claim_no", "c")).select(key, "line_no", "claim_no", F.trim("c.claim").alias("claim"), "c.source", "c.quote")
