"""Problem 3: one consistent form for texts that a reader cannot tell apart.

Method: compatibility normalisation of what has the same look (full- and half-width forms, radical and compatibility forms
of ideographs, ligatures, composed accents, blanks, hyphens), deletion of characters without ink, and then a lattice for every word with
letters of more than one script: each letter may be any of its look-alikes, and Viterbi takes the path with the fewest changes of
script, Latin where a word can be all Latin, and the best score of a model of letter pairs for each script beyond that.
The model's counts come from all words of one script in the tables. A word's lattice depends only on the classes of look-alikes
that its letters belong to, so two words get the same form if and only if they look the same.

Kept apart: letter case, accents, superscripts, fractions and signs, ideographs that differ in a stroke, punctuation marks of different
shape, line breaks, tabs and the number of blanks.

Defined cases: a null text has a null form, an empty one an empty form, and texts whose form is blank are in no pair; rows delivered
twice count once; invisible joiners inside emoji stay.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages
from lexmill.llm.codepoints import blocks, flatten

#: Letters drawn like a Latin one, by the Latin letter (fixed values: Cyrillic, Greek and others).
LATIN_LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "D": "Ꭰ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜϺ", "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "ЅՏ", "T": "ТΤ", "U": "Ս", "V": "ѴᏙ", "W": "Ԝ",
    "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "р", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
}
#: Radicals without a compatibility mapping, and the ideographs that they are forms of (fixed values).
RADICALS = dict(zip("⺃⺅⺉⺋⺌⺍⺎⺏⺐⺒⺓⺔⺖⺘⺙⺚⺛⺝⺞⺟⺠⺡⺢⺣⺤⺥⺦⺨⺩⺫⺬⺭⺮⺯⺱⺲⺴⺵⺶⺷⺹⺺⺼⺽⺾⺿⻀⻁⻂⻃⻄⻅⻆⻇⻈⻉⻋⻌⻍⻎⻏⻐⻑⻒⻓⻔⻕⻖⻗⻘⻙⻚⻛⻜⻝⻟⻠⻡⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "乚亻刂㔾小小兀尣尢巳幺彑忄扌攵旡无月歺母民氵氺灬爫爫丬犭王目示礻竹糹罓罒网网羊羊耂肀月臼艹艹艹虎衤西西见角角讠贝车辶辶辶邑钅長镸长门阜阝雨青韦页风飞食飠飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龟亀"))
BLANKS = [0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000]
INKLESS = [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF, 0x3164, 0xFFA0, *range(0xE0100, 0xE01F0)]
HYPHENS = [0x2D, 0x2010, 0x2011, 0xFE63, 0xFF0D]
#: Blocks whose compatibility mapping keeps the look: ligatures, half and full width, radicals, compatibility ideographs.
SAME_LOOK = [*range(0x2E80, 0x2FD6), *range(0xF900, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x2F800, 0x2FA20)]
DELETE, SPECIAL = 0xFFFFFFFF, 0xFFFFFFFE
#: Parts into which the rows with one string are split.
SLOTS = 1024
_WORD = re.compile(r"[A-Za-zÀ-ɏͰ-ϿЀ-ԯ԰-֏Ꭰ-ᏽɐ-ʯᴀ-ỿ]+")


def _table() -> tuple[dict[int, str], np.ndarray]:
    """What each code point becomes, as strings, and as an array where it is one code point; SPECIAL needs its context."""
    to: dict[int, str] = {}
    for code in SAME_LOOK:
        form = unicodedata.normalize("NFKC", chr(code))
        if form != chr(code):
            to[code] = form
    to |= {ord(c): f for c, f in RADICALS.items()}
    to |= {code: " " for code in BLANKS} | {code: "-" for code in HYPHENS}
    array = np.arange(0x110000, dtype=np.uint32)
    for code, form in to.items():
        array[code] = ord(form) if len(form) == 1 else SPECIAL
    for code in range(0x110000):
        if unicodedata.combining(chr(code)):
            array[code] = SPECIAL
    for code in [c for c in range(0x370, 0x590)] + [ord(c) for letters in LATIN_LOOKALIKES.values() for c in letters]:
        if unicodedata.category(chr(code))[0] == "L":
            array[code] = SPECIAL
    array[INKLESS] = DELETE
    array[0x200D] = SPECIAL
    # canonical singletons and other characters that composition changes
    for code in range(0x80, 0x110000):
        if array[code] == code and not 0xAC00 <= code < 0xD7A4 and not 0xD800 <= code < 0xE000 and unicodedata.normalize("NFC", chr(code)) != chr(code):
            array[code] = SPECIAL
    array[0x1100:0x1200] = SPECIAL  # Korean letters that compose
    return to, array


class Forms:
    """The tables of a process, and the consistent form of texts."""

    _one: Forms | None = None

    def __init__(self, pairs: dict[str, float] | None = None):
        to, self.array = _table()
        self.after = self.array.copy()  # for texts that have been through `slow`
        self.after[self.array == SPECIAL] = np.arange(0x110000, dtype=np.uint32)[self.array == SPECIAL]
        self.translate = to | {code: None for code in INKLESS if code != 0x200D}
        self.pairs = pairs or {}
        self.options: dict[str, str] = {}
        for latin, others in LATIN_LOOKALIKES.items():
            for c in latin + others:
                self.options[c] = latin + others
        self.script: dict[str, str] = {}
        self.known: dict[str, str] = {}

    @classmethod
    def of(cls, pairs: dict[str, float] | None = None) -> Forms:
        if cls._one is None or cls._one.pairs != (pairs or {}):
            cls._one = cls(pairs)
        return cls._one

    def script_of(self, letter: str) -> str:
        if letter not in self.script:
            self.script[letter] = unicodedata.name(letter, "?").split()[0]
        return self.script[letter]

    def word(self, word: str) -> str:
        """The best path through a word's lattice of look-alikes."""
        if word in self.known:
            return self.known[word]
        paths: dict[str, tuple[float, str]] = {"": (0.0, "")}
        for letter in word:
            base = unicodedata.normalize("NFD", letter)
            step: dict[str, tuple[float, str]] = {}
            for option in self.options.get(base[0], base[0]) if len(base) == 1 or base[0] in self.options else base[0]:
                made = unicodedata.normalize("NFC", option + base[1:])
                script = self.script_of(option)
                best = None
                for last, (cost, path) in paths.items():
                    c = cost + (1000.0 if last and self.script_of(last) != script else 0.0) + (20.0 if script != "LATIN" else 0.0) - self.pairs.get(last + option, -12.0)
                    if best is None or (c, path) < best:
                        best = (c, path)
                step[option] = (best[0], best[1] + made)
            paths = step
        best = min(paths.values())[1]
        if len(self.known) < 200_000:
            self.known[word] = best
        return best

    def slow(self, text: str) -> str:
        """The form of one text, with all that needs context."""
        if "‍" in text:
            text = re.sub(r"(?<![🀀-\U0010ffff️])‍", "", text)
        text = unicodedata.normalize("NFC", text.translate(self.translate))
        text = _WORD.sub(lambda m: m.group() if m.group().isascii() else self.word(m.group()), text)
        return unicodedata.normalize("NFC", text)  # accents after letters that have become Latin

    def codes(self, texts: list, blanks: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Code points and offsets of the forms of texts; without white space if blanks is false. None counts as empty."""
        codes, offsets = flatten(texts)
        form = self.array[codes]
        special = np.flatnonzero(form == SPECIAL)
        if len(special):
            texts = list(texts)
            for i in np.unique(np.searchsorted(offsets, special, "right") - 1).tolist():
                texts[i] = self.slow(texts[i])
            codes, offsets = flatten(texts)
            form = self.after[codes]
        keep = form != DELETE
        if not blanks:
            keep &= ~((form == 0x20) | ((form >= 9) & (form <= 13)) | ((form >= 0x1C) & (form <= 0x1F)) | (form == 0x85) | (form == 0x2028) | (form == 0x2029))
        kept = np.concatenate(([0], np.cumsum(keep)))[offsets]
        return form[keep], kept

    def strings(self, texts: list) -> list:
        codes, offsets = self.codes(texts)
        whole = codes.tobytes().decode("utf-32-le")
        return [None if t is None else whole[a:b] for t, a, b in zip(texts, offsets[:-1].tolist(), offsets[1:].tolist())]


def texts_of(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """tbl, id, text of both tables."""
    return chunks.select(F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), "text").unionByName(results.select(F.lit("conversion_results").alias("tbl"), F.col("result_id").alias("id"), "text"))


def letter_pairs(texts: DataFrame) -> dict[str, float]:
    """Logarithms of the shares of letter pairs in words of one script other than Latin, over all rows.

    As many entries as alphabets have pairs, whatever the number of rows; the pairs are counted in the tasks.
    """

    def run(batches):
        for batch in batches:
            counts: dict[str, int] = {}
            for text in batch.column(0).to_pylist():
                for word in re.findall(r"[Ͱ-Ͽἀ-῿]+|[Ѐ-ԯ]+|[԰-֏]+", text):
                    for a, b in zip(word, word[1:]):
                        counts[a + b] = counts.get(a + b, 0) + 1
            yield pa.RecordBatch.from_pydict({"pair": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    other = texts.filter(F.col("text").rlike(r"[Ͱ-Ͽἀ-῿Ѐ-ԯ԰-֏]{2}")).select("text")
    rows = other.mapInArrow(run, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).orderBy("pair").collect()
    total = sum(r.n for r in rows)
    return {r.pair: float(np.log(r.n / total)) for r in rows}


def consistent(df: DataFrame, text_col: str = "text", out: str = "form", pairs: dict[str, float] | None = None) -> DataFrame:
    """df with the consistent form of a text column."""

    @F.pandas_udf("string")
    def form(texts):
        import pandas as pd

        given = [t if isinstance(t, str) else None for t in texts]
        forms, made = Forms.of(pairs), []
        for a, b in blocks(given):
            made += forms.strings(given[a:b])
        return pd.Series(made, dtype=object)

    return df.withColumn(out, form(F.col(text_col)))


def digests(texts: DataFrame, pairs: dict[str, float]) -> DataFrame:
    """tbl, id, form and raw (digests of the consistent form and of the text) of texts that aren't blank, each row once."""

    def run(batches):
        forms = Forms.of(pairs)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in blocks(texts):
                codes, offsets = forms.codes(texts[a:b])
                data, at = codes.tobytes(), (offsets * 4).tolist()
                form = [hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(at[:-1], at[1:])]
                raw = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts[a:b]]
                ink = np.add.reduceat(np.append((codes != 0x20) & ~((codes >= 9) & (codes <= 13)), False), np.minimum(offsets[:-1], len(codes))) > 0
                ink &= np.diff(offsets) > 0
                one = pa.array(ink)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).filter(one), batch.column(1).slice(a, b - a).filter(one), pa.array(form, pa.binary()).filter(one), pa.array(raw, pa.binary()).filter(one)],
                    names=["tbl", "id", "form", "raw"],
                )

    return texts.filter("text is not null").mapInArrow(run, "tbl string, id bigint, form binary, raw binary").dropDuplicates(["tbl", "id"])


def _members(chunks: DataFrame, results: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Rows (tbl, form, raw, slot, id) of the forms that more than one string has, and how many have each (tbl, form, raw, slot).

    A slot is a part of the rows with one string: SLOTS of them, by the hash of the id, so that a string which a third of all rows have is
    never one key. Forms of a single string, however often it recurs, go no further than the counts.
    """
    texts = texts_of(chunks, results)
    stages = Stages(texts.sparkSession, label)
    found = stages.write("digests", digests(texts, letter_pairs(texts)).withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS))))
    parts = found.groupBy("tbl", "form", "raw", "slot").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    several = parts.groupBy("tbl", "form").agg((F.min("raw") != F.max("raw")).alias("several")).filter("several").select("tbl", "form")
    parts = stages.write("parts", parts.join(several, ["tbl", "form"], "left_semi"))
    members = found.join(parts.select("tbl", "form", "raw", "slot"), ["tbl", "form", "raw", "slot"], "left_semi")
    return members, parts


def alike_pairs(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Pairs of rows of one table whose texts look the same but are different strings.

    The slots of one string are paired with those of another string of the same form, and only then expanded into rows: no two equal strings
    ever meet, and the pairs of slots are never more than the pairs of rows.
    """
    members, parts = _members(chunks, results, "alike")
    one, two = (parts.select("tbl", "form", F.col("raw").alias(f"raw_{k}"), F.col("slot").alias(f"slot_{k}")) for k in "ab")
    pairs = one.join(two, ["tbl", "form"]).filter("raw_a < raw_b")
    for k in "ab":
        own = members.select("tbl", "form", F.col("raw").alias(f"raw_{k}"), F.col("slot").alias(f"slot_{k}"), F.col("id").alias(f"id_{k}"))
        pairs = pairs.join(own, ["tbl", "form", f"raw_{k}", f"slot_{k}"])
    return pairs.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def alike_groups(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """tbl, id, group (the smallest id with this form), variant (the smallest id with this string), n_variants and n_rows of the group, for every row
    that looks like a different string. As many rows as members, however many copies there are."""
    members, parts = _members(chunks, results, "looks")
    strings = parts.groupBy("tbl", "form", "raw").agg(F.sum("n").alias("n"), F.min("least").alias("variant"))
    forms = strings.groupBy("tbl", "form").agg(F.min("variant").alias("group"), F.count("*").alias("n_variants"), F.sum("n").alias("n_rows"))
    each = parts.select("tbl", "form", "raw", "slot").join(strings.drop("n"), ["tbl", "form", "raw"]).join(forms, ["tbl", "form"])
    return members.join(each, ["tbl", "form", "raw", "slot"]).select("tbl", "id", "group", "variant", "n_variants", "n_rows")
