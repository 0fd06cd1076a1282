"""Text expressions: pure Catalyst columns, the same for batch and streaming."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks that texts of the domain have at their edges and inside.
WS = r"[ \t\r\n\x{3000}\x{A0}]"
# Punctuation that counts as its half-width form, and characters without weight, when quotes are compared.
QUOTE_FROM, QUOTE_TO = "，（）：；“”‘’－—–", ",():;\"\"''---"
QUOTE_DROP = " \t\r\n,|*#>`~_　"
# Forms that two readings of a page may differ in.
_WIDE = [*range(0xFF10, 0xFF1A), *range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]  # full-width digits and letters lie 0xFEE0 above the others
OCR_FROM = "".join(map(chr, _WIDE)) + "，。、；：（）％～－"
OCR_TO = "".join(chr(c - 0xFEE0) for c in _WIDE) + ",.,;:()%~-"
# Characters of an address on the net, and words that carry no content in a question.
URL = r"https?://[A-Za-z0-9._~:/?#\[\]@!$&'()*+,;=%-]+"
FUNCTION_WORDS = "的了是在与及或和其被把将对从为以而也都就"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"\A{WS}+|{WS}+\z", "")


def norm_quote(c: Column) -> Column:
    """Form in which a quote is looked for in its source: tags gone, punctuation half-width, marks and blanks gone."""
    bare = F.regexp_replace(c, r"<[^>]*>", "")
    forms = F.translate(bare, QUOTE_FROM, QUOTE_TO)
    return F.translate(forms, QUOTE_DROP, "")


def norm_reading(c: Column) -> Column:
    """Form in which two readings of a page are compared: half-width, no commas between thousands, no blanks."""
    forms = F.translate(c, OCR_FROM, OCR_TO)
    return F.regexp_replace(F.regexp_replace(forms, r"(?<=\d),(?=\d{3}(?![\p{L}\p{N}_]))", ""), r"(?U)\s+", "")


def clean_passage(c: Column) -> Column:
    """Passage for reranking: images, links, tags, addresses, marks and rules gone, three line ends or more made two; blanks at the edges stay."""
    # What marks a passage up.
    steps = [
        (r"\r\n?", "\n"),
        (r"!\[[^\]]*\]\([^)]*\)", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"</?[A-Za-z][A-Za-z0-9]*(?:[ \t/][ !-;=?-~]*)?>", ""),
        (URL, ""),
        (r"(?m)^#{1,6} ", ""),
        (r"\*\*|__", ""),
        (r"(?m)^[ \t]*`{3,}[^\n]*$", ""),
        (r"(?m)^[ \t|:\-]*[|:\-][ \t|:\-]*$", ""),
        (r"\n{3,}", "\n\n"),
    ]
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def query_variants(question: Column) -> Column:
    """Up to two shorter forms of a question: its content words in order, and the two longest of three or more (of equal ones the earlier).

    Words are runs of letters and digits; function words and lone ideographs carry no content. No variant equals the question.
    """
    words = F.regexp_extract_all(question, F.lit(r"[\p{L}\p{N}]+"), 0)
    content = F.filter(words, lambda w: ~F.contains(F.lit(FUNCTION_WORDS), w) & ~w.rlike(r"\A[\x{4e00}-\x{9fff}]\z"))
    ranked = F.sort_array(F.transform(content, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    two = F.when(F.size(content) >= 3, F.array_join(F.transform(F.slice(ranked, 1, 2), lambda x: x["w"]), " "))
    whole, asked = F.array_join(content, " "), F.array(F.array_join(words, " "), strip(question))
    return F.array_distinct(F.filter(F.array_compact(F.array(whole, two)), lambda v: (v != "") & ~F.array_contains(asked, v)))


def snippet(c: Column) -> Column:
    """One line: blanks collapsed, edges clean."""
    return strip(F.regexp_replace(c, rf"{WS}+", " "))


def composed(heading: Column, text: Column) -> Column:
    """Text as it is indexed: under its headings where it has some."""
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n\n"), text)).otherwise(text)


def fragments(quote: Column) -> Column:
    """Parts of a quote around its ellipses."""
    return F.filter(F.transform(F.split(quote, r"…+|\.\.\.+"), strip), lambda x: x != "")


def anchor(source: Column, quote: Column, suspect: Column) -> Column:
    """A citation of a quote, marked where its source is suspect."""
    return F.concat(F.lit("〔来源: "), source, F.lit("：「"), quote, F.lit("」〕"), F.when(suspect, "（未核验）").otherwise(""))


def yaml_value(c: Column) -> Column:
    """A scalar quoted where it must be."""
    must = c.rlike(r": |:\z|#|\"|\n|\A | \z")
    return F.when(must, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(c)


def frontmatter(fields: dict[str, Column]) -> Column:
    """A block of `key: value` lines in the order given; null fields are left out."""
    lines = [F.concat(F.lit(f"{key}: "), yaml_value(value)) for key, value in fields.items()]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"))


def frontmatter_field(text: Column, key: str) -> Column:
    """A field of a text's leading block, unquoted; null where there is none."""
    block = F.regexp_extract(text, r"\A---\r?\n([\s\S]*?)\r?\n---\r?\n", 1)
    value = F.regexp_extract(F.concat(F.lit("\n"), block), rf"\n{key}: ([^\n]*)", 1)
    plain = F.when(value.startswith('"') & value.endswith('"') & (F.length(value) > 1), F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit('\\"'), F.lit('"'))).otherwise(value)
    return F.when(plain != "", plain)


def body(text: Column) -> Column:
    """A text without its leading block."""
    return F.regexp_replace(text, r"\A---\r?\n[\s\S]*?\r?\n---\r?\n\r?\n", "")


def tokens(text: Column) -> Column:
    """Terms of a text: runs of Latin letters and digits in lower case, ideographs in pairs (a lone one for itself)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9à-öø-ÿ]+"), 0)
    pairs = F.regexp_extract_all(text, F.lit(r"(?=([\x{4e00}-\x{9fff}]{2}))"), 1)
    alone = F.regexp_extract_all(text, F.lit(r"(?<![\x{4e00}-\x{9fff}])[\x{4e00}-\x{9fff}](?![\x{4e00}-\x{9fff}])"), 0)
    return F.concat(F.filter(words, lambda w: F.length(w) <= 40), pairs, alone)


def mark_images(c: Column) -> Column:
    """Image references as marks with the file's name, else the alternative text, else `未命名`."""
    mark = lambda name: f"〔图像：{name} —— 已省略未保留，请查原件〕"
    named = F.regexp_replace(c, r"!\[[^\]\n]*\]\((?:[^()\n]*/)?([^()/\n]+)\)", mark("$1"))
    alt = F.regexp_replace(named, r"!\[([^\]\n]+)\]\([^)\n]*\)", mark("$1"))
    bare = F.regexp_replace(alt, r"!\[\]\([^)\n]*\)", mark("未命名"))
    tagged = F.regexp_replace(bare, r"<img [^>]*src=\"(?:[^\"\n]*/)?([^\"/\n]+)\"[^>]*>", mark("$1"))
    return F.regexp_replace(F.regexp_replace(tagged, r"<img[^>]*>", mark("未命名")), r"<div[^>]*>\s*</div>", "")


def json_slice(c: Column) -> Column:
    """The outermost braces of a text and what is between them; null without any."""
    found = F.regexp_extract(c, r"\{[\s\S]*\}", 0)
    return F.when(found != "", found)


def safe_asset(path: Column) -> Column:
    """Whether a path is relative and never leads upwards."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    return ~path.rlike(r"\A([/\\]|[A-Za-z]:)") & ~F.array_contains(parts, "..")


def context(text: Column, quote: Column, width: int = 120) -> Column:
    """A quote in its text with `width` characters on either side; null where it isn't there."""
    at = F.position(quote, text)
    return F.when(at > 0, F.substring(text, F.greatest(at - width, F.lit(1)), F.least(at - 1, F.lit(width)) + F.length(quote) + width))
