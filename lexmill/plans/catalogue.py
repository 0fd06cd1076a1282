"""The registered queries and the SQL that each is compared with.

Every query reads the given tables whole. A row delivered twice counts once. SQL is omitted where an operator has none of the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages
from lexmill.functions import text as X
from lexmill.operators import conversion, evidence, graph, retrieval, sections, verify
from lexmill.operators.components import components
from lexmill.session import ship, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def register(run):
        def shipped(spark: SparkSession, folder: str) -> DataFrame:
            ship(spark)
            return run(spark, folder)

        shipped.__doc__ = run.__doc__
        _QUERIES[run.__name__] = shipped
        if sql:
            _SQL[run.__name__] = sql
        return run

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _chunks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "chunks").select("chunk_id", *columns).dropDuplicates(["chunk_id"])


def _results(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return table(spark, folder, "conversion_results").select("result_id", *columns).dropDuplicates(["result_id"])


_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_R = "r AS (SELECT DISTINCT ON (result_id) * FROM conversion_results)"
_WS = r"[ \t\r\n\x{3000}\x{A0}]"


def _strip_sql(c: str) -> str:
    return rf"regexp_replace({c}, '\A{_WS}+|{_WS}+\z', '', 'g')"


# --- scans, sources, statistics


@query("SELECT source, count(*) AS n_docs, count(text) AS n_texts, coalesce(sum(n_chars), 0)::BIGINT AS n_chars FROM documents GROUP BY source")
def list_sources(spark, folder):
    """Sources with their rows and characters."""
    return table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("text").alias("n_texts"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("n_chars"))


@query(f"WITH {_C} SELECT config_id, count(*) AS n_chunks, count(DISTINCT source) AS n_sources, count(DISTINCT case_id) AS n_cases, coalesce(max(length(text)), 0) AS longest FROM c GROUP BY config_id")
def index_stats(spark, folder):
    """Chunks, sources and cases of each configuration of the index."""
    c = _chunks(spark, folder, "config_id", "source", "case_id", "text")
    return c.groupBy("config_id").agg(F.count("*").alias("n_chunks"), F.countDistinct("source").alias("n_sources"), F.countDistinct("case_id").alias("n_cases"), F.coalesce(F.max(F.length("text")), F.lit(0)).alias("longest"))


@query(f"WITH {_C} SELECT chunk_id, source, ord, length(text) AS n_chars FROM c WHERE starts_with(source, 'CF-00') AND text IS NOT NULL ORDER BY n_chars DESC, chunk_id LIMIT 50")
def prefix_filter_topk(spark, folder):
    """The longest chunks of the sources with a prefix; the prefix reaches the scan."""
    c = table(spark, folder, "chunks").filter(F.col("source").startswith("CF-00") & F.col("text").isNotNull()).select("chunk_id", "source", "ord", F.length("text").alias("n_chars"))
    return c.dropDuplicates(["chunk_id"]).orderBy(F.desc("n_chars"), "chunk_id").limit(50)


@query(
    f"""WITH {_R}, e AS (SELECT result_id, lower(string_split(string_split(source, '/')[-1], '.')[-1]) AS ext, engine, pages, length(text) AS n FROM r),
    k AS (SELECT *, CASE WHEN ext IN ('docx','pptx','xlsx','html','htm','md','txt','csv','json','xml','epub') THEN 'native' WHEN ext IN ('png','jpg','jpeg','tif','tiff','bmp','gif','webp') THEN 'ocr'
    WHEN ext IN ('doc','wps') THEN 'legacy' WHEN ext IN ('ppt','xls','xlsb') THEN 'anydoc' WHEN ext = 'pdf' AND n / greatest(coalesce(pages, 1), 1) >= 50 THEN 'native' WHEN ext = 'pdf' THEN 'ocr' ELSE 'unsupported' END AS route FROM e)
    SELECT ext, route, engine, count(*) AS n FROM k GROUP BY ALL"""
)
def route_classify(spark, folder):
    """Files by type, route and the engine that they went through."""
    r = _results(spark, folder, "source", "engine", "pages", "text")
    per_page = F.length("text") / F.greatest(F.coalesce("pages", F.lit(1)), F.lit(1))
    return r.select(conversion.extension(F.col("source")).alias("ext"), conversion.route(F.col("source"), per_page).alias("route"), "engine").groupBy("ext", "route", "engine").agg(F.count("*").alias("n"))


@query(
    f"""WITH {_R}, s AS (SELECT result_id, source, regexp_replace(source, '\\.[A-Za-z0-9]+\\z', '') AS stem FROM (SELECT result_id, concat(case_id, '/', source_type, '.', source_type) AS source FROM r))
    SELECT result_id, source, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN source ELSE stem END || '.md' AS out_path FROM s"""
)
def output_names(spark, folder):
    """Names of outputs, with the file type kept where two files of a folder share a stem."""
    r = _results(spark, folder, "case_id", "source_type")
    return conversion.output_names(r.select("result_id", F.concat("case_id", F.lit("/"), "source_type", F.lit("."), "source_type").alias("source")), "source")


@query(
    f"""WITH {_R} SELECT case_id, count(*) AS n_files, count(*) FILTER (WHERE coalesce(text, '') = '') AS n_empty, count(*) FILTER (WHERE notices IS NOT NULL) AS n_noticed,
    count(*) FILTER (WHERE cross_check_reasons IS NOT NULL) AS n_checked, coalesce(sum(pages), 0)::BIGINT AS n_pages FROM r GROUP BY case_id"""
)
def conversion_report(spark, folder):
    """Counters of the conversion of each case."""
    r = _results(spark, folder, "case_id", "text", "notices", "cross_check_reasons", "pages")
    return r.groupBy("case_id").agg(
        F.count("*").alias("n_files"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("n_empty"), F.count_if(F.col("notices").isNotNull()).alias("n_noticed"),
        F.count_if(F.col("cross_check_reasons").isNotNull()).alias("n_checked"), F.coalesce(F.sum("pages"), F.lit(0)).alias("n_pages"),
    )


@query(
    f"""WITH {_R}, d AS (SELECT source, max(loaded_at) AS made_at, max_by(sha256(text), loaded_at) AS made_from FROM r WHERE loaded_at <= converted_at + INTERVAL 12 HOUR GROUP BY source)
    SELECT result_id, source FROM r WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.source = r.source AND d.made_at >= r.converted_at AND (d.made_from IS NULL OR d.made_from = sha256(r.text)))"""
)
def incremental_todo(spark, folder):
    """Files without an up-to-date output, where those loaded half a day after their conversion or later have none."""
    r = _results(spark, folder, "source", "text", "converted_at", "loaded_at").withColumn("sha", F.sha2("text", 256))
    in_time = r.filter(F.col("loaded_at") <= F.col("converted_at") + F.expr("INTERVAL 12 HOURS"))
    done = in_time.groupBy("source").agg(F.max("loaded_at").alias("made_at"), F.max_by("sha", "loaded_at").alias("made_from"))
    return conversion.to_do(r.withColumnRenamed("converted_at", "changed_at"), done, "source").select("result_id", "source")


# --- text


_NORM_SQL = "translate(translate(regexp_replace({0}, '<[^>]*>', '', 'g'), '，（）：；“”‘’－—–', ',():;\"\"''''---'), ' \t\r\n,|*#>`~_　', '')"


@query(f"WITH {_C} SELECT chunk_id, md5({_NORM_SQL.format('text')}) AS digest FROM c WHERE text IS NOT NULL")
def norm_text(spark, folder):
    """Digests of the form in which quotes are looked for."""
    return _chunks(spark, folder, "text").filter("text is not null").select("chunk_id", F.md5(X.norm_quote(F.col("text")).cast("binary")).alias("digest"))


def _ocr_sql(c: str) -> str:
    """RE2 has no look-around: commas between thousands become a mark in two passes (the second takes what the first had to leave), and the marks go."""
    forms = f"translate({c}, '{X.OCR_FROM}', '{X.OCR_TO}')"
    for _ in range(2):
        forms = r"regexp_replace(" + forms + r", '(\d),(\d\d\d)([^\d\p{L}\p{N}_]|\z)', '\1'||chr(1)||'\2\3', 'g')"
    return "regexp_replace(replace(" + forms + r", chr(1), ''), '[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B\x1C-\x1F]+', '', 'g')"


@query(f"WITH {_R} SELECT result_id, md5({_ocr_sql('text')}) AS digest, length({_ocr_sql('text')}) AS n FROM r WHERE text IS NOT NULL")
def ocr_normalize(spark, folder):
    """Digests of the form in which readings are compared."""
    n = X.norm_reading(F.col("text"))
    return _results(spark, folder, "text").filter("text is not null").select("result_id", F.md5(n.cast("binary")).alias("digest"), F.length(n).alias("n"))


def _clean_sql(c: str) -> str:
    for pattern, to in [
        (r"\r\n?", "\n"), (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"</?[A-Za-z][A-Za-z0-9]*(?:[ \t/][ !-;=?-~]*)?>", ""), (X.URL.replace("'", "''"), ""), (r"(?m)^#{1,6} ", ""),
        (r"\*\*|__", ""), (r"(?m)^[ \t]*`{3,}[^\n]*$", ""), (r"(?m)^[ \t|:\-]*[|:\-][ \t|:\-]*$", ""), (r"\n{3,}", "\n\n"),
    ]:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


@query(f"SELECT doc_id, md5({_clean_sql('text')}) AS digest FROM documents WHERE text IS NOT NULL")
def clean_passage(spark, folder):
    """Digests of passages as a reranker gets them."""
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.md5(X.clean_passage(F.col("text")).cast("binary")).alias("digest"))


@query(
    rf"""WITH {_C}, t AS (SELECT chunk_id, CASE WHEN coalesce(heading_path, '') <> '' THEN heading_path || chr(10) || chr(10) || text ELSE text END AS x FROM c WHERE text IS NOT NULL)
    SELECT chunk_id, md5({_strip_sql(f"regexp_replace(x, '{_WS}+', ' ', 'g')")}) AS digest FROM t"""
)
def composed_snippets(spark, folder):
    """Digests of one-line snippets of chunks under their headings."""
    c = _chunks(spark, folder, "heading_path", "text").filter("text is not null")
    return c.select("chunk_id", F.md5(X.snippet(X.composed(F.col("heading_path"), F.col("text"))).cast("binary")).alias("digest"))


@query(
    f"""WITH {_R} SELECT result_id, source AS source_back, engine AS engine_back, CASE WHEN text IS NULL OR text = '' THEN NULL ELSE sha256(text) END AS sha_back, coalesce(length(text), 0) AS n_body FROM r"""
)
def frontmatter_roundtrip(spark, folder):
    """Fields and bodies read back from texts under a block of their provenance."""
    r = _results(spark, folder, "source", "engine", "text")
    sha = F.when(F.col("text") != "", F.sha2("text", 256))
    whole = F.concat(X.frontmatter({"provenance_version": F.lit("1"), "source": F.col("source"), "engine": F.col("engine"), "content_sha256": sha}), F.coalesce("text", F.lit("")))
    f = r.select("result_id", whole.alias("f"))
    return f.select("result_id", X.frontmatter_field(F.col("f"), "source").alias("source_back"), X.frontmatter_field(F.col("f"), "engine").alias("engine_back"), X.frontmatter_field(F.col("f"), "content_sha256").alias("sha_back"), F.length(X.body(F.col("f"))).alias("n_body"))


@query(
    f"""WITH {_C}, p AS (SELECT source, config_id, ('0x' || substring(md5('<!-- page: ' || (ord + 1) || ' -->' || chr(10) || text), 1, 8))::BIGINT AS h, length(text) AS n FROM c WHERE text IS NOT NULL)
    SELECT source, config_id, count(*) AS n_pages, sum(h)::BIGINT AS digest, sum(n)::BIGINT AS n_chars FROM p GROUP BY source, config_id"""
)
def page_marks(spark, folder):
    """Chunks of each source marked as numbered pages, and a digest that doesn't need them in one place."""
    c = _chunks(spark, folder, "source", "config_id", "ord", "text").filter("text is not null")
    marked = F.concat(F.lit("<!-- page: "), (F.col("ord") + 1).cast("string"), F.lit(" -->\n"), F.col("text"))
    pages = c.select("source", "config_id", F.conv(F.substring(F.md5(marked.cast("binary")), 1, 8), 16, 10).cast("bigint").alias("h"), F.length("text").alias("n"))
    return pages.groupBy("source", "config_id").agg(F.count("*").alias("n_pages"), F.sum("h").alias("digest"), F.sum("n").alias("n_chars"))


@query(
    """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, count(*) AS n_candidates, max(length(trim(line, ' '))) AS longest FROM l WHERE trim(line, ' ') <> '' AND length(trim(line, ' ')) <= 80 AND NOT starts_with(trim(line, ' '), '|') GROUP BY doc_id"""
)
def heading_candidates(spark, folder):
    """Lines of each document that could be headings."""
    rows = sections.lines(table(spark, folder, "documents"), "doc_id").withColumn("t", F.trim("line"))
    rows = rows.filter((F.col("t") != "") & (F.length("t") <= 80) & ~F.col("t").startswith("|"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_candidates"), F.max(F.length("t")).alias("longest"))


# --- quality and readings


@query(
    rf"""WITH {_R}, q AS (SELECT result_id, pages, coalesce(length(regexp_replace(text, '{_WS}', '', 'g')), 0) AS n_chars, coalesce(list_max(list_transform(map_values(list_histogram(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, ' ')), lambda x: length(x) > 10))), lambda v: v::INTEGER)), 0) AS most_repeated,
    CASE WHEN confidences IS NULL THEN 0 ELSE len(list_filter(confidences, lambda c: c < 0.6)) END AS low FROM r)
    SELECT result_id, n_chars, most_repeated, low, (n_chars < 20 OR coalesce(pages >= 2 AND floor(n_chars / pages) < 50, false) OR most_repeated > 30 OR low > 0) AS thin_or_low FROM q"""
)
def quality_assess(spark, folder):
    """Signs of a bad conversion: hardly any text, thin pages, a line again and again, low confidence."""
    q = conversion.quality(_results(spark, folder, "text", "pages", "confidences"))
    thin = F.coalesce((F.col("pages") >= 2) & (F.floor(F.col("n_chars") / F.col("pages")) < conversion.LEAST_PER_PAGE), F.lit(False))
    return q.select("result_id", "n_chars", "most_repeated", "low", ((F.col("n_chars") < conversion.LEAST_CHARS) | thin | (F.col("most_repeated") > conversion.MOST_REPEATED) | (F.col("low") > 0)).alias("thin_or_low"))


@query()
def quality_reasons(spark, folder):
    """The same with the share of characters that no text has."""
    return conversion.quality(_results(spark, folder, "text", "pages", "confidences")).select("result_id", "n_chars", "garbled", "most_repeated", "low", "suspect")


_TOK = r"regexp_extract_all({0}, '\d+[年月日]?')"


@query(
    rf"""WITH {_R}, x AS (SELECT result_id, min(second_text) AS second_text, max(digit_mismatches) AS reported FROM cross_checks GROUP BY result_id),
    t AS (SELECT result_id, reported, {_TOK.format(_ocr_sql('text'))} AS a, {_TOK.format(_ocr_sql('second_text'))} AS b FROM r JOIN x USING (result_id) WHERE text IS NOT NULL AND second_text IS NOT NULL)
    SELECT result_id, reported, (abs(len(a) - len(b)) + len(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])))::INTEGER AS mismatches FROM t"""
)
def crosscheck_digits(spark, folder):
    """Numbers that two readings of a file don't share, position by position."""
    second = table(spark, folder, "cross_checks").groupBy("result_id").agg(F.min("second_text").alias("second_text"), F.max("digit_mismatches").alias("reported"))
    both = _results(spark, folder, "text").join(second, "result_id").filter("text is not null and second_text is not null")
    return both.select("result_id", "reported", conversion.digit_mismatches(F.col("text"), F.col("second_text")).alias("mismatches"))


@query()
def crosscheck_ratio(spark, folder):
    """How much two readings of a file disagree."""
    second = table(spark, folder, "cross_checks").groupBy("result_id").agg(F.min("second_text").alias("second_text"), F.max("disagreement_ratio").alias("reported"))
    both = _results(spark, folder, "text").join(second, "result_id")
    return both.select("result_id", "reported", F.round(conversion.disagreement("text", "second_text"), 4).alias("ratio"))


@query(
    """WITH a AS (SELECT user_id, date_trunc('hour', ts) AS hour, (event_id % 4) * 90 AS angle, avg(value) AS confidence FROM events GROUP BY ALL)
    SELECT user_id, hour, max_by(angle, round(confidence, 6) * 1000 - angle / 1000.0)::BIGINT AS angle, count(*) AS n_angles FROM a GROUP BY user_id, hour"""
)
def rotation_argmax(spark, folder):
    """The angle with the best mean confidence of each group of probes; ties go to the smallest."""
    a = table(spark, folder, "events").groupBy("user_id", F.date_trunc("hour", "ts").alias("hour"), ((F.col("event_id") % 4) * 90).alias("angle")).agg(F.avg("value").alias("confidence"))
    return a.groupBy("user_id", "hour").agg(F.max_by("angle", F.round("confidence", 6) * 1000 - F.col("angle") / 1000.0).alias("angle"), F.count("*").alias("n_angles"))


# --- sections, outlines, chunks

_LINES = "l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL))"
_HEAD = r"'\A(#{1,6})[ \t]+([^\n]*[^ \t\n#])[ \t]*#*[ \t]*\z'"
_PATH = ", ".join(f"CASE WHEN r{n} IS NULL OR t{n}.line_no > r{n} THEN t{n}.title END" for n in range(1, 7))
_STACK = ", ".join(
    f"last_value(CASE WHEN level = {n} THEN {{'line_no': line_no, 'title': title}} END IGNORE NULLS) OVER w AS t{n}, max(CASE WHEN level < {n} THEN line_no END) OVER w AS r{n}" for n in range(1, 7)
)


@query(
    f"""WITH {_LINES}, h AS (SELECT *, CASE WHEN regexp_matches(line, {_HEAD}) THEN length(regexp_extract(line, {_HEAD}, 1)) END AS level, regexp_extract(line, {_HEAD}, 2) AS title FROM l),
    s AS (SELECT *, count(level) OVER w AS sec, {_STACK} FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
    g AS (SELECT doc_id, sec, min(concat_ws(' > ', {_PATH})) AS heading_path, count(*) AS n_lines, {_strip_sql("coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE level IS NULL), '')")} AS body FROM s GROUP BY doc_id, sec)
    SELECT doc_id, sec, heading_path, n_lines, md5(body) AS digest FROM g WHERE body <> '' OR sec > 0"""
)
def parse_sections(spark, folder):
    """Sections of documents with their breadcrumbs."""
    s = sections.sections(table(spark, folder, "documents"), "doc_id")
    return s.select("doc_id", "sec", "heading_path", "n_lines", F.md5(F.col("body").cast("binary")).alias("digest"))


@query(
    rf"""WITH {_LINES}, f AS (SELECT *, regexp_matches(line, '\A[ \t]*(```|~~~)') AS fence FROM l), g AS (SELECT *, sum(fence::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) % 2 AS fenced FROM f),
    h AS (SELECT doc_id, line_no, length(regexp_extract(line, {_HEAD}, 1)) AS level, regexp_extract(line, {_HEAD}, 2) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS idx FROM g WHERE fenced = 0 AND NOT fence AND regexp_matches(line, {_HEAD})),
    m AS (SELECT doc_id, max(line_no) AS last_line FROM l GROUP BY doc_id)
    SELECT h.doc_id, h.idx, h.level, h.title, h.line_no AS line_start, coalesce((SELECT min(b.line_no) FROM h b WHERE b.doc_id = h.doc_id AND b.line_no > h.line_no AND b.level <= h.level) - 1, m.last_line) AS line_end,
    (SELECT max(b.idx) FROM h b WHERE b.doc_id = h.doc_id AND b.idx < h.idx AND b.level < h.level) AS parent_idx FROM h JOIN m ON m.doc_id = h.doc_id"""
)
def outline_tree(spark, folder):
    """Headings of documents with the lines that they span and their parents."""
    return sections.outline(table(spark, folder, "documents"), "doc_id")


@query(
    f"""WITH {_LINES}, t AS (SELECT *, starts_with({_strip_sql('line')}, '|') AS is_table FROM l), i AS (SELECT *, line_no - sum(is_table::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS island FROM t)
    SELECT doc_id, min(line_no) AS first_line, count(*) AS n_rows, max(len(string_split(line, '|')) - 2) AS n_columns FROM i WHERE is_table GROUP BY doc_id, island"""
)
def table_blocks(spark, folder):
    """Tables of documents as runs of lines."""
    return sections.tables(table(spark, folder, "documents"), "doc_id")


@query(
    rf"""WITH p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: {_strip_sql('x')}), lambda x: x <> '') AS a FROM documents WHERE text IS NOT NULL), u AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS par_no, unnest(a) AS par FROM p)
    SELECT doc_id, par_no, length(par) AS n_chars, length(regexp_replace(par, '[^。！？.!?]', '', 'g')) AS n_stops FROM u"""
)
def split_units(spark, folder):
    """Paragraphs of documents with their ends of sentences."""
    p = sections.paragraphs(table(spark, folder, "documents"), "doc_id")
    return p.select("doc_id", "par_no", F.length("par").alias("n_chars"), F.length(F.regexp_replace("par", "[^。！？.!?]", "")).alias("n_stops"))


@query()
def chunk_document(spark, folder):
    """Documents in chunks of up to 384 tokens that overlap by up to 100 and don't cross sections."""
    s = sections.sections(table(spark, folder, "documents"), "doc_id")
    return sections.chunked(s, ["doc_id", "sec", "heading_path"], 384, 100, "body").select("doc_id", "sec", "chunk", "heading_path", "n_tokens", "text")


@query()
def chunk_hierarchical(spark, folder):
    """Children of up to 192 tokens within parents of up to 1600, with the parent's number."""
    s = sections.sections(table(spark, folder, "documents"), "doc_id").withColumn("key", F.concat_ws("/", "doc_id", "sec"))
    parents = sections.chunked(s, ["key"], 1600, text="body").withColumnRenamed("chunk", "parent_ord").drop("n_tokens")
    return sections.chunked(parents, ["key", "parent_ord"], 192, 32).select("key", "parent_ord", "chunk", "n_tokens", "text")


@query()
def table_split(spark, folder):
    """Tables of documents in pieces of up to 96 tokens, each under the table's head."""
    return sections.table_pieces(table(spark, folder, "documents"), ["doc_id"], 96)


# --- retrieval

_TOKENS = r"list_concat(list_filter(regexp_extract_all(lower({0}), '[a-z0-9à-öø-ÿ]+'), lambda w: length(w) <= 40), flatten(list_transform(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]+'), lambda h: list_transform(range(1, greatest(length(h) - 1, 1) + 1), lambda i: substring(h, i, 2)))))"
_POST = "tk AS (SELECT doc_id, " + _TOKENS.format("text") + " AS terms FROM documents WHERE text IS NOT NULL), po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS dl, unnest(terms) AS term FROM tk) GROUP BY ALL)"
_QT = "qt AS (SELECT DISTINCT query, term FROM (SELECT doc_id AS query, unnest(" + _TOKENS.format("title") + ") AS term FROM documents WHERE doc_id % 50 = 0 AND title IS NOT NULL))"
_BM = """bs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT doc_id, dl FROM po)), bd AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    sc AS (SELECT query, po.doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 4) AS score FROM po JOIN qt USING (term) JOIN bd USING (term), bs GROUP BY query, po.doc_id)"""
_BT = "bt AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) - 1 AS rank FROM sc)"
_VT = """vs AS (SELECT q.vec_id AS query, v.vec_id AS doc_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 10) AS s FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0),
    vt AS (SELECT query, doc_id, round(s, 4) AS score, row_number() OVER (PARTITION BY query ORDER BY s DESC, doc_id) - 1 AS rank FROM vs)"""


def _doc_index(spark, folder) -> DataFrame:
    """The inverted index, written once: a query reads it for its statistics and for its terms' rows."""
    return Stages(spark, "index").write("postings", _postings(spark, folder))


def _postings(spark, folder) -> DataFrame:
    return retrieval.postings(table(spark, folder, "documents").filter("text is not null"), "doc_id", F.col("text"))


def _title_terms(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").filter("doc_id % 50 = 0 and title is not null")
    return d.select(F.col("doc_id").alias("query"), F.explode(X.tokens(F.col("title"))).alias("term")).distinct()


def _vector_queries(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _vectors(spark, folder) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")


@query(f"WITH {_POST} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM po GROUP BY term")
def corpus_terms(spark, folder):
    """Terms of documents with the rows and places that have them."""
    return _postings(spark, folder).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(f"WITH {_POST}, {_QT}, {_BM}, {_BT} SELECT query, rank, doc_id, score FROM bt WHERE rank < 5")
def bm25_batch(spark, folder):
    """The best documents for the titles of every fiftieth document, by BM25."""
    return retrieval.bm25(_doc_index(spark, folder), "doc_id", _title_terms(spark, folder), 5).select("query", "rank", "doc_id", "score")


@query(f"WITH {_VT} SELECT query, rank, doc_id, score FROM vt WHERE rank < 5")
def vector_batch_topk(spark, folder):
    """The nearest vectors of every fiftieth vector, exactly."""
    return retrieval.cosine(_vectors(spark, folder), "doc_id", "embedding", _vector_queries(spark, folder), 5).select("query", "rank", "doc_id", "score")


@query(f"WITH {_VT} SELECT query, rank, doc_id, score FROM vt WHERE rank < 5 AND score >= 0.35")
def vector_floor(spark, folder):
    """The same with a floor after the ranking."""
    return retrieval.cosine(_vectors(spark, folder), "doc_id", "embedding", _vector_queries(spark, folder), 5, floor=0.35).select("query", "rank", "doc_id", "score")


def _hybrid(spark, folder, k: int, candidates: int = 50) -> DataFrame:
    vector = retrieval.cosine(_vectors(spark, folder), "doc_id", "embedding", _vector_queries(spark, folder), candidates)
    text = retrieval.bm25(_doc_index(spark, folder), "doc_id", _title_terms(spark, folder), candidates)
    return retrieval.fuse(vector, text, "doc_id", k)


_FUSED = """fu AS (SELECT query, doc_id, round(sum(1 / (60 + rank)), 6) AS score, min(channel * 1000000 + rank) AS first FROM (SELECT query, doc_id, rank, 0 AS channel FROM vt WHERE rank < 50 UNION ALL SELECT query, doc_id, rank, 1 FROM bt WHERE rank < 50) GROUP BY query, doc_id),
    fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, first, doc_id) - 1 AS rank FROM fu)"""


@query(f"WITH {_POST}, {_QT}, {_BM}, {_BT}, {_VT}, {_FUSED} SELECT query, rank, doc_id, score FROM fr WHERE rank < 5")
def hybrid_search(spark, folder):
    """Both channels fused by reciprocal ranks."""
    return _hybrid(spark, folder, 5)


@query(
    f"""WITH {_POST}, {_QT}, {_BM}, {_BT}, {_VT}, {_FUSED}, w AS (SELECT query, list_distinct(list(term)) AS wanted FROM qt GROUP BY query), o AS (SELECT doc_id, list_distinct(terms) AS own FROM tk),
    rs AS (SELECT query, fr.doc_id, rank, round(len(list_intersect(own, wanted)) / len(wanted), 6) AS score FROM fr JOIN w USING (query) JOIN o USING (doc_id) WHERE rank < 50), rr AS (SELECT query, doc_id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) - 1 AS rank FROM rs)
    SELECT query, rank, doc_id, score FROM rr WHERE rank < 5"""
)
def rerank(spark, folder):
    """Fused candidates in the order of a second scorer."""
    return retrieval.rerank(_hybrid(spark, folder, 50), "doc_id", table(spark, folder, "documents").filter("text is not null"), F.col("text"), _title_terms(spark, folder), 5)


@query(
    rf"""WITH w AS (SELECT doc_id, title, regexp_extract_all(title, '[\p{{L}}\p{{N}}]+') AS words FROM documents WHERE title IS NOT NULL),
    c AS (SELECT *, list_filter(words, lambda x: NOT contains('{X.FUNCTION_WORDS}', x) AND NOT regexp_full_match(x, '[\x{{4e00}}-\x{{9fff}}]')) AS content FROM w),
    r AS (SELECT *, list_sort(list_transform(range(1, len(content) + 1), lambda i: {{'n': -length(content[i]), 'i': i}})) AS best FROM c),
    v AS (SELECT doc_id, title, array_to_string(words, ' ') AS whole, [array_to_string(content, ' '), CASE WHEN len(content) >= 3 THEN content[best[1].i] || ' ' || content[best[2].i] END] AS made FROM r),
    k AS (SELECT doc_id, list_filter(made, lambda x: x IS NOT NULL AND x <> '' AND x <> whole AND x <> {_strip_sql('title')}) AS kept FROM v)
    SELECT doc_id, kept[1] AS first, CASE WHEN kept[2] <> kept[1] THEN kept[2] END AS second FROM k"""
)
def query_expand(spark, folder):
    """Shorter forms of each title that are searched as well as it; null where there is none."""
    v = table(spark, folder, "documents").filter("title is not null").select("doc_id", X.query_variants(F.col("title")).alias("v"))
    return v.select("doc_id", F.get("v", F.lit(0)).alias("first"), F.get("v", F.lit(1)).alias("second"))


@query(
    f"""WITH {_C}, p AS (SELECT source, config_id, parent_ord, string_agg(text, chr(10) ORDER BY ord, text) AS parent_text FROM c WHERE parent_ord IS NOT NULL AND text IS NOT NULL GROUP BY ALL)
    SELECT chunk_id, c.source, c.parent_ord, md5(parent_text) AS parent_digest FROM c LEFT JOIN p ON p.source = c.source AND p.config_id = c.config_id AND p.parent_ord = c.parent_ord"""
)
def attach_parents(spark, folder):
    """Every chunk with the text of its parent; null without one."""
    c = _chunks(spark, folder, "source", "config_id", "parent_ord", "ord", "text")
    return c.drop("text", "ord").join(retrieval.parents(c.filter("text is not null")), ["source", "config_id", "parent_ord"], "left").select("chunk_id", "source", "parent_ord", F.md5(F.col("parent_text").cast("binary")).alias("parent_digest"))


@query(
    f"""WITH {_C}, m AS (SELECT source, count(*) AS listed FROM chunks GROUP BY source), t AS (SELECT source, count(*) AS there FROM c WHERE coalesce(text, '') <> '' GROUP BY source)
    SELECT source, listed, there FROM m FULL JOIN t USING (source) WHERE listed IS DISTINCT FROM there"""
)
def doctor_drift(spark, folder):
    """Sources whose delivered rows aren't as many as their chunks with text."""
    listed = table(spark, folder, "chunks").groupBy("source").agg(F.count("*").alias("listed"))
    there = _chunks(spark, folder, "source", "text").filter(F.coalesce("text", F.lit("")) != "").groupBy("source").agg(F.count("*").alias("there"))
    return listed.join(there, "source", "full").filter(~F.col("listed").eqNullSafe(F.col("there")))


@query(
    f"""WITH {_C} SELECT k.config_id, embed_model, count(c.chunk_id) AS n_chunks, count(*) FILTER (WHERE length(c.text) > 4 * k.chunk_tokens) AS n_long, count(*) FILTER (WHERE c.parent_ord IS NOT NULL AND k.parent_tokens IS NULL) AS n_orphans,
    coalesce(k.parent_tokens < 2 * k.chunk_tokens, false) AS parents_too_small FROM configs k LEFT JOIN c ON c.config_id = k.config_id GROUP BY k.config_id, embed_model, k.parent_tokens, k.chunk_tokens"""
)
def model_gate(spark, folder):
    """Configurations against the chunks made with them."""
    c = _chunks(spark, folder, "config_id", "text", "parent_ord")
    k = table(spark, folder, "configs")
    return k.join(c, "config_id", "left").groupBy("config_id", "embed_model", "parent_tokens", "chunk_tokens").agg(
        F.count("chunk_id").alias("n_chunks"), F.count_if(F.length("text") > 4 * F.col("chunk_tokens")).alias("n_long"), F.count_if(F.col("parent_ord").isNotNull() & F.col("parent_tokens").isNull()).alias("n_orphans")
    ).select("config_id", "embed_model", "n_chunks", "n_long", "n_orphans", F.coalesce(F.col("parent_tokens") < 2 * F.col("chunk_tokens"), F.lit(False)).alias("parents_too_small"))


# --- verification: pages are derived from documents, each citing the document before it


_PAGES = """pg AS (SELECT doc_id, '# ' || coalesce(title, 'x') || chr(10) || 'claim ' || doc_id || ' 〔来源: _md/' || (CASE WHEN doc_id % 11 = 0 THEN doc_id + 100000000 ELSE doc_id END) || '.md：「' || replace(substring(text, 20, 12), chr(10), ' ') || (CASE WHEN doc_id % 7 = 0 THEN '…@@' ELSE '…' || replace(substring(text, 40, 8), chr(10), ' ') END) || '」〕' || (CASE WHEN doc_id % 2 = 0 THEN '（未核验）' ELSE '' END) || chr(10) || 'see [[' || coalesce(title, 'x') || '|t]] and [[missing ' || doc_id || ']]' AS text
    FROM documents WHERE text IS NOT NULL AND length(text) > 60)"""


def _pages(spark, folder) -> DataFrame:
    d = table(spark, folder, "documents").filter("length(text) > 60")
    piece = lambda a, n: F.replace(F.substring("text", a, n), F.lit("\n"), F.lit(" "))
    second = F.when(F.col("doc_id") % 7 == 0, "…@@").otherwise(F.concat(F.lit("…"), piece(40, 8)))
    cited = F.concat(F.lit("_md/"), F.when(F.col("doc_id") % 11 == 0, F.col("doc_id") + 100000000).otherwise(F.col("doc_id")).cast("string"), F.lit(".md"))
    title, key = F.coalesce("title", F.lit("x")), F.col("doc_id").cast("string")
    page = F.concat(F.lit("# "), title, F.lit("\nclaim "), key, F.lit(" "), X.anchor(cited, F.concat(piece(20, 12), second), F.col("doc_id") % 2 == 0), F.lit("\nsee [["), title, F.lit("|t]] and [[missing "), key, F.lit("]]"))
    return d.select("doc_id", page.alias("text"))


_ANCHOR = r"'〔来源:[ \t]*([^\n：]+?)：「([^\n]+?)」〕'"


@query(
    rf"""WITH {_PAGES}, a AS (SELECT doc_id, text, regexp_extract(text, {_ANCHOR}, 1) AS source, regexp_extract(text, {_ANCHOR}, 2) AS quote FROM pg WHERE regexp_matches(text, {_ANCHOR})),
    s AS (SELECT '_md/' || doc_id || '.md' AS source, {_NORM_SQL.format('text')} AS body, doc_id % 3 = 0 AS suspect FROM documents WHERE text IS NOT NULL),
    p AS (SELECT a.*, body, suspect, list_transform(list_filter(list_transform(regexp_split_to_array(quote, '…+|\.\.\.+'), lambda x: {_strip_sql('x')}), lambda x: x <> ''), lambda x: {_NORM_SQL.format('x')}) AS f FROM a LEFT JOIN s ON s.source = a.source),
    q AS (SELECT *, CASE WHEN len(f) = 0 THEN 1 ELSE instr(body, f[1]) END AS p1 FROM p)
    SELECT doc_id, source, CASE WHEN body IS NULL THEN 'missing' WHEN NOT (p1 > 0 AND (len(f) < 2 OR instr(substring(body, p1 + length(f[1])), f[2]) > 0)) THEN 'mismatch' WHEN suspect AND doc_id % 2 = 1 THEN 'unmarked' ELSE 'ok' END AS verdict FROM q"""
)
def anchor_verify(spark, folder):
    """Citations of pages held against the texts that they cite."""
    sources = table(spark, folder, "documents").filter("text is not null").select(F.concat(F.lit("_md/"), "doc_id", F.lit(".md")).alias("source"), F.col("text").alias("body"), (F.col("doc_id") % 3 == 0).alias("suspect"))
    return verify.verify_anchors(verify.anchors(_pages(spark, folder), "doc_id"), sources).select("doc_id", "source", "verdict")


@query(
    rf"""WITH {_PAGES}, ln AS (SELECT doc_id, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS a FROM pg), ll AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM ln)
    SELECT doc_id, line_no, 0 AS claim_no, trim(split_part(line, '〔来源:', 1), ' ') AS claim, regexp_extract(line, {_ANCHOR}, 1) AS source FROM ll WHERE NOT starts_with(line, '#') AND regexp_matches(line, {_ANCHOR})"""
)
def claim_pairs(spark, folder):
    """Claims of pages with the source that each cites."""
    return verify.claims(_pages(spark, folder), "doc_id").select("doc_id", "line_no", "claim_no", "claim", "source")


@query(
    f"""WITH {_PAGES}, names AS (SELECT title AS name FROM documents WHERE title IS NOT NULL UNION SELECT title FROM case_files),
    k AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[\\[([^\\[\\]\\n]+)\\]\\]', 1)) AS raw FROM (SELECT doc_id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT doc_id, text FROM pg)),
    t AS (SELECT doc_id, trim(string_split(string_split(raw, '|')[1], '#')[1], ' ') AS target FROM k) SELECT doc_id, target FROM t WHERE target <> '' AND target NOT IN (SELECT name FROM names)"""
)
def dead_links(spark, folder):
    """Links of documents and pages that lead to no title."""
    d = table(spark, folder, "documents")
    names = d.select(F.col("title").alias("name")).unionAll(table(spark, folder, "case_files").select("title")).filter("name is not null").distinct()
    found = verify.links(d.select("doc_id", "text").unionAll(_pages(spark, folder)), "doc_id")
    return verify.dead_links(found, names).select("doc_id", "target")


@query(
    r"""WITH p AS (SELECT result_id, CASE result_id % 4 WHEN 0 THEN '_md/' || case_id || '/a.md' WHEN 1 THEN '_md/../wiki/' || case_id || '.md' WHEN 2 THEN './_md//' || case_id || '/../b.md' ELSE case_id || '.md' END AS path FROM (SELECT DISTINCT result_id, case_id FROM conversion_results))
    , q AS (SELECT result_id, path, list_reduce(list_prepend([]::VARCHAR[], list_transform(list_filter(string_split(replace(path, '\\', '/'), '/'), lambda x: x <> '' AND x <> '.'), lambda x: [x])),
    lambda done, x: CASE WHEN x[1] = '..' AND len(done) > 0 THEN done[:len(done) - 1] ELSE list_concat(done, x) END) AS parts FROM p)
    SELECT result_id, path, NOT starts_with(path, '/') AND len(parts) > 1 AND parts[1] = '_md' AS inside FROM q"""
)
def closed_world(spark, folder):
    """Whether cited paths stay inside the folder of sources."""
    case = F.col("case_id")
    path = F.when(F.col("result_id") % 4 == 0, F.concat(F.lit("_md/"), case, F.lit("/a.md"))).when(F.col("result_id") % 4 == 1, F.concat(F.lit("_md/../wiki/"), case, F.lit(".md")))
    path = path.when(F.col("result_id") % 4 == 2, F.concat(F.lit("./_md//"), case, F.lit("/../b.md"))).otherwise(F.concat(case, F.lit(".md")))
    r = _results(spark, folder, "case_id").withColumn("path", path)
    return r.select("result_id", "path", verify.closed_world(F.col("path")).alias("inside"))


_SOURCES = """pv AS (SELECT result_id, source, text, CASE WHEN result_id % 17 = 0 THEN '' ELSE 'provenance_version: ' || CASE WHEN result_id % 19 = 0 THEN '2' ELSE '1' END || chr(10) END || CASE WHEN result_id % 23 = 0 THEN '' ELSE 'source: ' || source || chr(10) END
    || 'source_sha256: ' || sha256(source || CASE WHEN result_id % 13 = 0 THEN 'x' ELSE '' END) || chr(10) || 'content_sha256: ' || sha256(text) || chr(10) AS head, text || CASE WHEN result_id % 11 = 0 THEN 'y' ELSE '' END AS body FROM r WHERE coalesce(text, '') <> '' AND source IS NOT NULL),
    og AS (SELECT source, sha256(source) AS sha FROM r WHERE result_id % 7 > 0 AND source IS NOT NULL GROUP BY source)"""


@query(
    rf"""WITH {_R}, {_SOURCES}, f AS (SELECT result_id, nullif(regexp_extract(head, 'provenance_version: ([^\n]*)', 1), '') AS version, nullif(regexp_extract(head, '(?:\A|\n)source: ([^\n]*)', 1), '') AS src, regexp_extract(head, 'source_sha256: ([^\n]*)', 1) AS ssha, regexp_extract(head, 'content_sha256: ([^\n]*)', 1) AS csha, body FROM pv),
    j AS (SELECT f.*, og.sha FROM f LEFT JOIN og ON og.source = f.src), a AS (SELECT result_id, list_filter([CASE WHEN version IS NULL THEN 'legacy' WHEN version <> '1' THEN 'unsupported' WHEN src IS NULL OR ssha = '' OR csha = '' THEN 'incomplete' END,
    CASE WHEN sha IS NULL THEN 'no original' WHEN sha <> ssha THEN 'original changed' END, CASE WHEN sha256(body) <> csha THEN 'body changed' END], lambda x: x IS NOT NULL) AS findings FROM j)
    SELECT result_id, array_to_string(findings, ', ') AS findings FROM a WHERE len(findings) > 0"""
)
def provenance_check(spark, folder):
    """Converted texts held against the hashes in their leading block and against their originals: what doesn't fit. Some blocks, bodies and originals are
    altered by the number of the result, so that each finding occurs."""
    r = _results(spark, folder, "source", "text").filter("coalesce(text, '') <> '' and source is not null")
    n, on = F.col("result_id"), lambda k: F.col("result_id") % k == 0
    fields = {
        "provenance_version": F.when(~on(17), F.when(on(19), "2").otherwise("1")), "source": F.when(~on(23), F.col("source")),
        "source_sha256": F.sha2(F.concat("source", F.when(on(13), "x").otherwise("")), 256), "content_sha256": F.sha2("text", 256),
    }
    pages = r.select(n, F.concat(X.frontmatter(fields), "text", F.when(on(11), "y").otherwise("")).alias("text"))
    originals = _results(spark, folder, "source").filter("result_id % 7 > 0 and source is not null").groupBy("source").agg(F.sha2(F.min("source"), 256).alias("sha"))
    return verify.provenance(pages, originals).select("result_id", "findings")


@query(
    """WITH e AS (SELECT case_id, doc_id, CASE WHEN doc_id % 5 = 0 THEN [year(added_at)] WHEN doc_id % 5 = 1 THEN [year(added_at), month(added_at)] ELSE [year(added_at), month(added_at), day(added_at)] END AS d FROM documents WHERE added_at IS NOT NULL AND case_id IS NOT NULL),
    p AS (SELECT *, lag(d) OVER (PARTITION BY case_id ORDER BY doc_id) AS b FROM e) SELECT case_id, doc_id FROM p WHERE b IS NOT NULL AND d[:least(len(d), len(b))] < b[:least(len(d), len(b))]"""
)
def timeline_order(spark, folder):
    """Entries of the cases' timelines that come after a later one; their dates are read from the lines."""
    d = table(spark, folder, "documents").filter("added_at is not null and case_id is not null")
    line = F.concat(F.lit("- "), F.year("added_at"), F.lit("年"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(F.concat(F.month("added_at"), F.lit("月"), F.when(F.col("doc_id") % 5 == 1, "").otherwise(F.concat(F.dayofmonth("added_at"), F.lit("日"))))), F.lit("：filed"))
    return verify.out_of_order(d.select("case_id", "doc_id", line.alias("line")), "case_id", "doc_id", "line").select("case_id", "doc_id")


@query(
    r"""WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT || '+' || l_partkey || '==' || (l_quantity::BIGINT + l_partkey + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) || CASE WHEN l_linenumber % 5 = 0 AND l_linenumber % 3 <> 0 THEN ' or so' ELSE '' END AS claim FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN NOT regexp_full_match(claim, '[0-9.]+(\+[0-9.]+)*==[0-9.]+') THEN 'unreadable' WHEN abs(list_sum(list_transform(string_split(split_part(claim, '==', 1), '+'), lambda x: x::DOUBLE)) - split_part(claim, '==', 2)::DOUBLE) <= 1e-6 THEN 'ok' ELSE 'wrong' END AS verdict FROM t"""
)
def closure_check(spark, folder):
    """Sums written as text, evaluated and compared."""
    q, p = F.col("l_quantity").cast("bigint"), F.col("l_partkey")
    total = q + p + F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    tail = F.when((F.col("l_linenumber") % 5 == 0) & (F.col("l_linenumber") % 3 != 0), " or so").otherwise("")
    line = F.concat(F.lit("> [!check] "), F.format_number(q, 0), F.lit(" ＋ "), F.format_number(p, 0), F.lit(" == "), F.format_number(total, 0), tail)
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", line.alias("line"))
    return verify.closures(rows, "line").select("l_orderkey", "l_linenumber", "verdict")


_LOG = "lg AS (SELECT DISTINCT ON (result_id) result_id, source, notices FROM conversion_results)"
_SKIPS = "sk AS (SELECT source AS path, bool_or(notices IS NOT NULL) AS has_reason FROM (SELECT DISTINCT ON (result_id) * FROM conversion_results) WHERE length(coalesce(text, '')) < 600 OR notices IS NOT NULL GROUP BY source)"


@query(f"WITH {_SKIPS} SELECT path, has_reason FROM sk")
def skip_ledger(spark, folder):
    """Skipped sources read from log texts, and whether a reason is given."""
    return verify.skip_ledger(_logs(spark, folder), "result_id")


def _logs(spark, folder) -> DataFrame:
    """A log of what was left out: files with hardly any text or with notices, which are the reason."""
    r = _results(spark, folder, "source", "text", "notices").filter((F.length(F.coalesce("text", F.lit(""))) < 600) | F.col("notices").isNotNull())
    reason = F.when(F.col("notices").isNotNull(), F.concat(F.lit("- 原因："), F.coalesce(F.get("notices", F.lit(0)), F.lit("noticed")), F.lit("\n"))).otherwise("- 原因： \n")
    return r.select("result_id", F.concat(F.lit("# log\n\n## [2030-01-02] skip | "), "source", F.lit("\n"), reason, F.lit("## [2030-01-03] note\n- 原因：not a skip\n")).alias("text"))


@query(
    f"""WITH {_LOG}, {_SKIPS}, ci AS (SELECT DISTINCT regexp_replace(source, '/([0-9]+-[0-9]+)_[^/]*\\z', '/originals/\\1') AS stem FROM chunks), p AS (SELECT DISTINCT source AS path FROM lg),
    st AS (SELECT path, CASE WHEN regexp_replace(path, '\\.[a-z0-9]+\\z', '') IN (SELECT stem FROM ci) THEN 'cited' WHEN has_reason THEN 'skipped' ELSE 'unresolved' END AS state FROM p LEFT JOIN sk USING (path))
    SELECT state, count(*) AS n FROM st GROUP BY state"""
)
def coverage_ledger(spark, folder):
    """Sources by state: cited by a chunk, skipped with a reason, or neither."""
    sources = _results(spark, folder, "source").select(F.col("source").alias("path")).distinct()
    stems = table(spark, folder, "chunks").select(F.regexp_replace("source", r"/([0-9]+-[0-9]+)_[^/]*\z", "/originals/$1").alias("stem")).distinct()
    cited = sources.withColumn("stem", F.regexp_replace("path", r"\.[a-z0-9]+\z", "")).join(stems, "stem", "left_semi").select("path")
    states = verify.coverage(sources, cited, verify.skip_ledger(_logs(spark, folder), "result_id"))
    return states.groupBy("state").agg(F.count("*").alias("n"))


_NAMES_SQL = ", ".join(f"'{n}'" for n in verify.SECTION_NAMES)


@query(
    rf"""WITH b AS (SELECT doc_id, string_split(replace(regexp_replace(text, '\A---\r?\n[\s\S]*?\r?\n---\r?\n\r?\n', ''), chr(13) || chr(10), chr(10)), chr(10)) AS a FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, line_no, {_strip_sql('line')} AS s FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS line_no, unnest(a) AS line FROM b)),
    k AS (SELECT *, s = '' OR regexp_matches(s, '\A[-*_]{{3,}}\z') OR starts_with(s, '```') AS skip, starts_with(s, '>') AS quoted, regexp_matches(s, '\A\|?[\s:|-]+\|?\z') AS is_rule FROM s),
    n AS (SELECT *, CASE WHEN skip THEN NULL WHEN regexp_matches(s, '\A>\s*\[!note\]\s*分析(?:（非本案证据）)?\s*\z') THEN 1 WHEN quoted THEN NULL ELSE 0 END AS state, CASE WHEN quoted THEN regexp_replace(s, '\A[> ]+', '') ELSE s END AS t FROM k),
    w AS (SELECT *, coalesce(last_value(state IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING), 0) = 1 AS analysis, coalesce(lead(is_rule) OVER (PARTITION BY doc_id ORDER BY line_no), false) AS next_rule FROM n)
    SELECT doc_id, count(*) AS n_lines, min(line_no) AS first_line FROM w WHERE NOT (skip OR analysis OR t = '' OR regexp_matches(t, '\A\|?[\s:|-]+\|?\z') OR starts_with(t, '[!check]') OR regexp_matches(t, '\A(?:\[!warning\]\s*⚠?\s*冲突|\[!caution\]\s*含未核验来源)\z')
    OR (starts_with(t, '#') AND regexp_replace(t, '\A[# ]+', '') IN ({_NAMES_SQL})) OR (regexp_matches(t, '(?s)\A\|.*\|\z') AND next_rule) OR (regexp_matches(t, {_ANCHOR}) AND regexp_matches(regexp_split_to_array(t, {_ANCHOR})[-1], '\A(?:[ \t]*（未核验）)?[ \t，,。；;：:|]*\z'))
    OR regexp_matches(t, '\A{verify.NOT_FOUND}[。！？]?\z')) GROUP BY doc_id"""
)
def unanchored_lines(spark, folder):
    """Lines of documents that state something without a citation."""
    u = verify.unanchored(table(spark, folder, "documents"), "doc_id")
    return u.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.min("line_no").alias("first_line"))


@query("SELECT user_id, max_by(event_type, event_id) AS last_type, max(ts) AS last_ts, count(*) AS n FROM events GROUP BY user_id")
def last_entry(spark, folder):
    """The last entry of every actor's transcript."""
    return table(spark, folder, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))


# --- graph and evidence

_GRAPH = "ge AS (SELECT DISTINCT case_id AS a, source AS b FROM documents WHERE case_id IS NOT NULL AND source IS NOT NULL), gs AS (SELECT a, b FROM ge UNION SELECT b, a FROM ge)"


def _graph(spark, folder) -> DataFrame:
    """Cases and the feeds of their documents, each linked with the other."""
    d = table(spark, folder, "documents").filter("case_id is not null and source is not null")
    names = d.select(F.col("source").alias("name"), F.col("source").alias("node")).distinct()
    return graph.edges(d.select(F.col("case_id").alias("node"), F.col("source").alias("target")).distinct(), names)


def _first_case(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").filter("case_id is not null and source is not null").agg(F.min("case_id").alias("node"))


@query(f"WITH {_GRAPH} SELECT a AS node, count(*) AS degree, string_agg(b, ', ' ORDER BY b) AS neighbours FROM gs GROUP BY a")
def graph_neighbors(spark, folder):
    """Nodes of the graph with their neighbours in order."""
    g = _graph(spark, folder)
    found = graph.neighbours(g, g.select(F.col("a").alias("node")).distinct())
    return found.withColumn("neighbours", F.array_join("neighbours", ", "))


@query(
    f"""WITH RECURSIVE {_GRAPH}, st AS (SELECT min(a) AS node FROM ge), bfs AS (SELECT node, 0 AS distance FROM st UNION SELECT gs.b, distance + 1 FROM bfs JOIN gs ON gs.a = bfs.node WHERE distance < 40)
    SELECT node, min(distance) AS distance FROM bfs GROUP BY node"""
)
def graph_distances(spark, folder):
    """Steps from the first case to every node that it leads to (the SQL needs some end; no shortest path of these tables comes near it)."""
    return graph.distances(_graph(spark, folder), _first_case(spark, folder)).select("node", "distance")


@query()
def graph_path(spark, folder):
    """The shortest path from the first case to every node, however long; null where none leads to it."""
    return graph.paths(_graph(spark, folder), _first_case(spark, folder))


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT s_suppkey + 1000 AS a, s_nationkey::BIGINT AS b FROM supplier), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT DISTINCT a AS node, a AS reach FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.reach)
    SELECT node, min(reach) AS component FROM r GROUP BY node"""
)
def graph_components(spark, folder):
    """Connected components of the graph of suppliers and nations."""
    return components(table(spark, folder, "supplier").select((F.col("s_suppkey") + 1000).alias("a"), F.col("s_nationkey").cast("bigint").alias("b")))


_TERMS = "tm AS (SELECT DISTINCT substring(title, 1, 4) AS term FROM case_files WHERE title IS NOT NULL)"


@query(
    f"""WITH {_TERMS}, {_LINES}, n AS (SELECT doc_id, line_no, {_NORM_SQL.format('line')} AS norm FROM l), h AS (SELECT term, doc_id, line_no, row_number() OVER (PARTITION BY term ORDER BY doc_id, line_no) AS k, count(*) OVER (PARTITION BY term) AS n_hits FROM n JOIN tm ON contains(norm, {_NORM_SQL.format('term')}))
    SELECT term, doc_id, line_no, n_hits > 20 AS truncated FROM h WHERE k <= 20"""
)
def grep_terms(spark, folder):
    """The first twenty lines that have each term (the names that case titles start with), and whether there are more."""
    return _grep(spark, folder)


def _terms(spark, folder) -> DataFrame:
    return table(spark, folder, "case_files").filter("title is not null").select(F.substring("title", 1, 4).alias("term")).distinct()


def _grep(spark, folder) -> DataFrame:
    terms = _terms(spark, folder).withColumn("wanted", X.norm_quote(F.col("term")))
    rows = sections.lines(table(spark, folder, "documents"), "doc_id").select("doc_id", "line_no", X.norm_quote(F.col("line")).alias("norm")).filter("norm != ''")
    return evidence.capped(evidence.find_terms(rows, terms))


@query(f"WITH {_TERMS}, {_LINES}, n AS (SELECT {_NORM_SQL.format('line')} AS norm FROM l) SELECT term FROM tm WHERE NOT EXISTS (SELECT 1 FROM n WHERE contains(norm, {_NORM_SQL.format('term')}))")
def grep_not_found(spark, folder):
    """Terms that no line has."""
    return _terms(spark, folder).join(_grep(spark, folder).select("term").distinct(), "term", "left_anti")


@query(
    f"""WITH {_R}, k AS (SELECT case_id, count(*) AS total, count(*) FILTER (WHERE coalesce(text, '') = '') AS failed, count(*) FILTER (WHERE notices IS NOT NULL) AS warned FROM r GROUP BY case_id), i AS (SELECT case_id, count(DISTINCT regexp_extract(source, '/([0-9]+-[0-9]+)_', 1)) AS indexed FROM chunks GROUP BY case_id),
    j AS (SELECT case_id, total, failed, warned, coalesce(indexed, 0) AS indexed, total - failed AS expected, greatest(total - failed - coalesce(indexed, 0), 0) AS unresolved FROM k LEFT JOIN i USING (case_id))
    SELECT case_id, total, failed, warned, indexed, unresolved, CASE WHEN failed > 0 THEN 1 WHEN indexed < expected OR unresolved > 0 THEN 3 ELSE 0 END AS exit_code FROM j"""
)
def ingest_gate(spark, folder):
    """Reconciliation of each case: files, failures, what is indexed, and the code that a run ends with."""
    r = _results(spark, folder, "case_id", "text", "notices").groupBy("case_id").agg(F.count("*").alias("total"), F.count_if(F.coalesce("text", F.lit("")) == "").alias("failed"), F.count_if(F.col("notices").isNotNull()).alias("warned"))
    i = table(spark, folder, "chunks").groupBy("case_id").agg(F.countDistinct(F.regexp_extract("source", r"/([0-9]+-[0-9]+)_", 1)).alias("indexed"))
    j = r.join(i, "case_id", "left").withColumn("indexed", F.coalesce("indexed", F.lit(0))).withColumn("expected", F.col("total") - F.col("failed"))
    j = j.withColumn("unresolved", F.greatest(F.col("expected") - F.col("indexed"), F.lit(0)))
    return conversion.gate(j).select("case_id", "total", "failed", "warned", "indexed", "unresolved", "exit_code")


@query()
def evidence_bundle(spark, folder):
    """For each query: its best documents whole, the lines that have the name of its case, that name where no line has it, and the outline of all documents."""
    stages = Stages(spark, "evidence")
    d = table(spark, folder, "documents")
    names = table(spark, folder, "case_files").filter("title is not null").select("case_id", F.substring("title", 1, 4).alias("term"))
    asked = d.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "case_id").join(names, "case_id").select("query", "term")
    hits, grep = stages.write("hits", _hybrid(spark, folder, 8)), stages.write("grep", _grep(spark, folder))
    heads = stages.write("heads", sections.outline(d.filter("text is not null"), "doc_id"))
    return evidence.bundle(hits, asked, grep, d, heads)


# --- further text and file rules


@query(
    f"""WITH {_R}, q AS (SELECT result_id, pages, confidences, length(regexp_replace(coalesce(text, ''), '{_WS}', '', 'g')) AS n FROM r), m AS (SELECT result_id, CASE WHEN n < 20 THEN 'near-empty output (' || n || ' chars)' END AS a,
    CASE WHEN pages >= 2 AND floor(n / pages) < 50 THEN 'avg ' || floor(n / pages)::BIGINT || ' chars/page over ' || pages || ' pages' END AS b,
    CASE WHEN len(list_filter(confidences, lambda c: c < 0.6)) > 0 THEN len(list_filter(confidences, lambda c: c < 0.6)) || ' low-confidence OCR region(s), min ' || printf('%.2f', round(list_min(confidences), 2)) END AS c FROM q)
    SELECT result_id, concat_ws('; ', a, b, c) AS reasons FROM m WHERE coalesce(a, b, c) IS NOT NULL"""
)
def quality_messages(spark, folder):
    """What speaks against a conversion, in words (without the signs that SQL counts otherwise)."""
    q = conversion.quality(_results(spark, folder, "text", "pages", "confidences"))
    said = F.filter(conversion.reasons(q), lambda x: ~x.startswith("garbled") & ~x.startswith("line repeated"))
    return q.select("result_id", F.array_join(said, "; ").alias("reasons")).filter("reasons != ''")


@query(
    """WITH p AS (SELECT doc_id, '![' || CASE WHEN doc_id % 3 = 0 THEN '' ELSE coalesce(source, 'x') END || '](' || CASE WHEN doc_id % 2 = 0 THEN 'img/' || doc_id || '.png' ELSE '' END || ') <div> </div>' AS text FROM documents)
    SELECT doc_id, '〔图像：' || CASE WHEN doc_id % 2 = 0 THEN doc_id || '.png' WHEN doc_id % 3 = 0 THEN '未命名' ELSE (SELECT coalesce(source, 'x') FROM documents d WHERE d.doc_id = p.doc_id) END || ' —— 已省略未保留，请查原件〕 ' AS marked FROM p"""
)
def image_marks(spark, folder):
    """Marks in place of images, named after their file, their text or nothing."""
    alt = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.coalesce("source", F.lit("x")))
    target = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("img/"), F.col("doc_id"), F.lit(".png"))).otherwise("")
    page = F.concat(F.lit("!["), alt, F.lit("]("), target, F.lit(") <div> </div>"))
    return table(spark, folder, "documents").select("doc_id", X.mark_images(page).alias("marked"))


@query(r"""WITH j AS (SELECT doc_id, regexp_extract(text, '\{[\s\S]*\}') AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(x) AS n_chars, md5(x) AS digest FROM j WHERE x <> ''""")
def json_slices(spark, folder):
    """What looks like an object in texts, as it is cut out of a model's answer."""
    d = table(spark, folder, "documents").select("doc_id", X.json_slice(F.col("text")).alias("x")).filter("x is not null")
    return d.select("doc_id", F.length("x").alias("n_chars"), F.md5(F.col("x").cast("binary")).alias("digest"))


@query(
    r"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, 'https?://([A-Za-z0-9.-]+|\[[0-9a-fA-F:]+\])', 1)) AS host FROM documents WHERE text IS NOT NULL)
    SELECT host, count(*) AS n, (host IN ('localhost', '[::1]') OR starts_with(host, '127.')) AS loopback FROM u GROUP BY host"""
)
def url_hosts(spark, folder):
    """Hosts that texts link to, and whether they are this machine."""
    found = F.regexp_extract_all(F.col("text"), F.lit(r"https?://([A-Za-z0-9.-]+|\[[0-9a-fA-F:]+\])"), 1)
    hosts = table(spark, folder, "documents").select(F.explode(found).alias("host")).groupBy("host").agg(F.count("*").alias("n"))
    return hosts.withColumn("loopback", F.col("host").isin("localhost", "[::1]") | F.col("host").startswith("127."))


@query(f"WITH {_R} SELECT result_id, source NOT LIKE '%..%' AND source NOT LIKE '/%' AS safe, ('../' || source) LIKE '/%' AS up_is_safe FROM r")
def asset_safety(spark, folder):
    """Whether the paths of files, and the same paths one level up, may be written below a folder."""
    r = _results(spark, folder, "source")
    return r.select("result_id", X.safe_asset(F.col("source")).alias("safe"), X.safe_asset(F.concat(F.lit("../"), "source")).alias("up_is_safe"))


@query(
    """WITH h AS (SELECT doc_id, regexp_replace(text, '(?m)^#{3,6}([ \t])', '##\\1', 'g') AS x FROM documents WHERE text IS NOT NULL) SELECT doc_id, md5(x) AS digest FROM h"""
)
def heading_levels(spark, folder):
    """Texts whose headings go down to the second level at most."""
    d = table(spark, folder, "documents").filter("text is not null")
    return d.select("doc_id", F.md5(F.regexp_replace("text", r"(?m)^#{3,6}([ \t])", "##$1").cast("binary")).alias("digest"))


@query(
    """WITH q AS (SELECT doc_id, text, substring(text, 200, 15) AS quote FROM documents WHERE length(text) > 260), p AS (SELECT *, instr(text, quote) AS pos FROM q)
    SELECT doc_id, md5(substring(text, greatest(pos - 120, 1), least(pos - 1, 120) + length(quote) + 120)) AS digest FROM p"""
)
def claim_context(spark, folder):
    """Quotes of texts in their surroundings."""
    d = table(spark, folder, "documents").filter(F.length("text") > 260).withColumn("quote", F.substring("text", 200, 15))
    return d.select("doc_id", F.md5(X.context(F.col("text"), F.col("quote")).cast("binary")).alias("digest"))


@query(
    f"""WITH {_R}, {_C}, d AS (SELECT case_id, count(*) AS n_documents FROM documents GROUP BY case_id), f AS (SELECT case_id, count(*) AS n_results FROM r GROUP BY case_id), g AS (SELECT case_id, count(*) AS n_chunks FROM c GROUP BY case_id)
    SELECT k.case_id, coalesce(n_documents, 0) AS n_documents, coalesce(n_results, 0) AS n_results, coalesce(n_chunks, 0) AS n_chunks, (court IS NULL OR status IS NULL) AS incomplete FROM case_files k LEFT JOIN d ON d.case_id = k.case_id LEFT JOIN f ON f.case_id = k.case_id LEFT JOIN g ON g.case_id = k.case_id"""
)
def case_check(spark, folder):
    """What each case has of everything that it should have."""
    k = table(spark, folder, "case_files")
    d = table(spark, folder, "documents").groupBy("case_id").agg(F.count("*").alias("n_documents"))
    f = _results(spark, folder, "case_id").groupBy("case_id").agg(F.count("*").alias("n_results"))
    g = _chunks(spark, folder, "case_id").groupBy("case_id").agg(F.count("*").alias("n_chunks"))
    j = k.join(d, "case_id", "left").join(f, "case_id", "left").join(g, "case_id", "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_results", "n_chunks")]
    return j.select("case_id", *counts, (F.col("court").isNull() | F.col("status").isNull()).alias("incomplete"))


@query()
def answer_gate(spark, folder):
    """Pages as drafts of answers: citations that fail, lines without one, and the code that the gate ends with."""
    total = F.length("text") + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    check = F.concat(F.lit("\n> [!check] ("), F.length("text").cast("string"), F.lit(" - 7) * 1 + 7 == "), total.cast("string"), F.when(F.col("doc_id") % 8 == 0, " about").otherwise(""))
    pages = _pages(spark, folder).withColumn("text", F.concat("text", check))
    sources = table(spark, folder, "documents").filter("text is not null").select(F.concat(F.lit("_md/"), "doc_id", F.lit(".md")).alias("source"), F.col("text").alias("body"), (F.col("doc_id") % 3 == 0).alias("suspect"))
    return verify.gate(pages, "doc_id", sources)


@query(
    f"""WITH {_C}, tk AS (SELECT chunk_id, case_id, {_TOKENS.format('text')} AS terms FROM c WHERE text IS NOT NULL), po AS (SELECT chunk_id, case_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, case_id, len(terms) AS dl, unnest(terms) AS term FROM tk) GROUP BY ALL),
    qt AS (SELECT DISTINCT case_id, term FROM (SELECT case_id, unnest({_TOKENS.format('title')}) AS term FROM case_files WHERE title IS NOT NULL)), bs AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT chunk_id, dl FROM po)), bd AS (SELECT term, count(*) AS df FROM po GROUP BY term),
    sc AS (SELECT po.case_id AS query, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 4) AS score FROM po JOIN qt ON qt.case_id = po.case_id AND qt.term = po.term JOIN bd ON bd.term = po.term, bs GROUP BY po.case_id, chunk_id),
    rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) - 1 AS rank FROM sc) SELECT query, rank, chunk_id, score FROM rk WHERE rank < 3"""
)
def case_search(spark, folder):
    """The best chunks of each case for its title, where the case is a filter before the ranking."""
    c = _chunks(spark, folder, "case_id", "text").filter("text is not null")
    index = Stages(spark, "cases").write("postings", retrieval.postings(c, "chunk_id", F.col("text")).join(c.select("chunk_id", F.col("case_id").alias("scope")), "chunk_id"))
    asked = table(spark, folder, "case_files").filter("title is not null").select(F.col("case_id").alias("query"), F.explode(X.tokens(F.col("title"))).alias("term")).distinct()
    return retrieval.bm25(index, "chunk_id", asked, 3, scope="scope").select("query", "rank", "chunk_id", "score")
