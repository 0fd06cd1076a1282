"""Problem 1: oversized chunks cut into pieces within the limit of their config, at natural boundaries, with an overlap.

Method: pointer doubling. Each oversized text gives its boundaries with the number of tokens before each. Every boundary is
joined to the farthest one that a piece from it can reach, and to the start of the piece after that one, which lies up
to the overlap before (its successor). Squaring the table of successors (1, 2, 4, ... pieces ahead) while adding what the
starts known so far lead to gives all starts of pieces in as many rounds as the logarithm of the pieces of the longest text.

Boundaries are where paragraphs, lines, table rows, sentences and articles end. Only in a stretch between two of them that is
itself above the limit, words are boundaries too, and tokens in a word that is. All boundaries lie where words of the
tokenizer start (or tokens of one word), so the tokens of a piece never exceed the difference of the counts at its ends.

Defined cases: null and empty texts, and texts within the limit, give no pieces (they stay as they are); a chunk delivered
twice counts once; a chunk whose config is unknown has no limit; an overlap of the limit or more counts as the limit less 1;
a token of which several make up one character is never cut from the others, so a limit below 4 can be exceeded by such a character.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages
from lexmill.llm.bpe import Encoder, tokenizer_file
from lexmill.llm.codepoints import blocks

#: The end of a sentence with its closing marks, line ends, and the places before articles and numbered clauses.
NATURAL = re.compile(
    r"[。！？；…]+[”’」』）)\]】》]*\s*|[.!?]+[”’\"'»)\]]*(?=\s)\s*|\n\s*|(?<=[\s。；：:])(?=第[一二三四五六七八九十百千零〇\d]{1,8}[条章节款])|(?<=[。；：:\n])(?=[（(][一二三四五六七八九十]{1,3}[）)])"
)


def natural_cuts(text: str) -> list[int]:
    """Offsets at which a piece may start so that the one before it ends naturally."""
    return [m.end() for m in NATURAL.finditer(text)]


def boundaries(texts: list[str], limits: list[int], encoder: Encoder) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each text above its limit: the offsets of its boundaries, from 0 to its length, and the tokens before each."""
    words = encoder.encode_words(texts)
    cut = np.searchsorted(words.text, np.arange(len(texts) + 1))
    out: list = []
    for i, text in enumerate(texts):
        a, b = cut[i], cut[i + 1]
        tokens = words.n_tokens[a:b]
        if not text or tokens.sum() <= limits[i]:
            out.append(None)
            continue
        start = words.start[a:b]
        before = np.concatenate(([0], np.cumsum(tokens)))
        wanted = np.array(natural_cuts(text), np.int64)
        at = np.searchsorted(start, wanted)
        hit = (at < len(start)) & (start[np.minimum(at, len(start) - 1)] == wanted)
        # a word may start with the blank before it
        led = ~hit & (at > 0)
        led[led] = [text[p - 1] == " " and start[k - 1] == p - 1 for p, k in zip(wanted[led].tolist(), at[led].tolist())]
        index = np.unique(np.concatenate(([0], at[hit], at[led] - 1, [len(start)])))
        sizes = np.diff(before[index])
        if np.any(sizes > limits[i]):
            index = np.unique(np.concatenate([index, *(np.arange(index[k], index[k + 1]) for k in np.flatnonzero(sizes > limits[i]))]))
        offsets = np.append(start, len(text))[index]
        counts = before[index]
        long = np.flatnonzero(np.diff(counts) > limits[i])
        if len(long):
            more = [_inside(text, offsets[k], offsets[k + 1], counts[k], encoder) for k in long]
            offsets = np.concatenate([offsets, *(m[0] for m in more)])
            counts = np.concatenate([counts, *(m[1] for m in more)])
            order = np.argsort(offsets, kind="stable")
            offsets, counts = offsets[order], counts[order]
        out.append((offsets, counts))
    return out


def _inside(text: str, start: int, end: int, before: int, encoder: Encoder) -> tuple[np.ndarray, np.ndarray]:
    """Offsets in one word where a token ends together with a character, and the tokens before each."""
    ids = encoder.encode_words([text[start:end]]).flat_ids()
    sizes = encoder.sizes()[ids]
    ends = np.cumsum(sizes)
    chars = np.cumsum([len(c.encode()) for c in text[start:end]])
    where = np.isin(ends, chars)
    where[-1] = False
    return start + np.searchsorted(chars, ends[where]) + 1, before + np.flatnonzero(where) + 1


def _limits(chunks: DataFrame, configs: DataFrame) -> DataFrame:
    config = configs.groupBy("config_id").agg(F.min_by("chunk_tokens", F.struct("chunk_tokens", "chunk_overlap")).alias("limit"), F.min_by("chunk_overlap", F.struct("chunk_tokens", "chunk_overlap")).alias("overlap"))
    overlap = F.least(F.greatest(F.coalesce("overlap", F.lit(0)), F.lit(0)), F.col("limit") - 1)
    return chunks.join(config.filter("limit > 0").withColumn("overlap", overlap), "config_id")


def find_boundaries(chunks: DataFrame, configs: DataFrame, path: str | None = None) -> DataFrame:
    """chunk_id, limit, overlap and arrays `pos` (offsets) and `cum` (tokens before) of each chunk above its limit.

    A token has a byte at least, so texts of no more bytes than their limit aren't tokenised.
    """
    path = path or tokenizer_file()
    schema = "chunk_id bigint, limit int, overlap int, pos array<int>, cum array<int>"

    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            keys, limits, overlaps, texts = (c.to_pylist() for c in batch.columns)
            for a, b in blocks(texts):
                rows = [(k, limits[k], overlaps[k], x) for k, x in enumerate(boundaries(texts[a:b], limits[a:b], encoder), a) if x]
                if rows:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "chunk_id": pa.array([keys[k] for k, *_ in rows], pa.int64()),
                            "limit": pa.array([r[1] for r in rows], pa.int32()),
                            "overlap": pa.array([r[2] for r in rows], pa.int32()),
                            "pos": pa.array([r[3][0] for r in rows], pa.list_(pa.int32())),
                            "cum": pa.array([r[3][1] for r in rows], pa.list_(pa.int32())),
                        }
                    )

    sized = _limits(chunks.select("chunk_id", "config_id", "text"), configs).filter(F.octet_length("text") > F.col("limit"))
    return sized.select("chunk_id", "limit", "overlap", "text").mapInArrow(run, schema).dropDuplicates(["chunk_id"])


def successors(found: DataFrame) -> DataFrame:
    """chunk_id, at, reach (the boundary at which a piece from `at` ends) and next (where the piece after it starts, null at the end).

    Both are joins of a boundary with the last one at or before a place, in one sort of boundaries and places together.
    """
    b = found.select("chunk_id", "limit", "overlap", F.posexplode(F.arrays_zip("pos", "cum")).alias("at", "b"))
    b = b.select("chunk_id", "at", F.col("b.cum").alias("cum"), "limit", "overlap")
    own = Window.partitionBy("chunk_id")

    def with_last(rows: DataFrame, place, tie: int, out: str) -> DataFrame:
        """The last boundary before `place`, or at it where tie is 1."""
        both = rows.select("*", F.explode(F.array(F.struct(F.col("cum").alias("place"), F.lit(0).alias("kind")), F.struct(place.alias("place"), F.lit(tie).alias("kind")))).alias("p"))
        seen = F.last(F.when(F.col("p.kind") == 0, F.col("at")), ignorenulls=True).over(own.orderBy("p.place", "p.kind").rowsBetween(Window.unboundedPreceding, 0))
        return both.withColumn(out, seen).filter(F.col("p.kind") == tie).drop("p")

    b = with_last(b, F.col("cum") + F.col("limit"), 1, "reach")
    b = b.withColumn("reach", F.when(F.col("reach") <= F.col("at"), F.col("at") + 1).otherwise(F.col("reach")))  # one character above the limit
    last = F.max("at").over(own)
    return b.withColumn("last", last).transform(_next_start).filter("at < last").drop("last")


def _next_start(b: DataFrame) -> DataFrame:
    """The first boundary from which the piece after `reach` may start: within the overlap, and reaching one boundary farther."""
    own = Window.partitionBy("chunk_id")
    ends = b.select("chunk_id", "at", "cum", F.lead("cum").over(own.orderBy("at")).alias("after"), "limit", "overlap")
    place = F.when(F.col("after").isNotNull(), F.greatest(F.col("cum") - F.col("overlap"), F.col("after") - F.col("limit")))
    both = ends.select("chunk_id", "at", "after", F.explode(F.array(F.struct(F.col("cum").alias("place"), F.lit(0).alias("kind")), F.struct(place.alias("place"), F.lit(-1).alias("kind")))).alias("p"))
    seen = F.last(F.when(F.col("p.kind") == 0, F.col("at")), ignorenulls=True).over(own.orderBy("p.place", "p.kind").rowsBetween(Window.unboundedPreceding, 0))
    starts = both.filter("p.place is not null").withColumn("seen", seen).filter(F.col("p.kind") == -1)
    starts = starts.select("chunk_id", F.col("at").alias("reach"), F.least(F.coalesce("seen", F.lit(-1)) + 1, F.col("at")).alias("next"))
    return b.select("chunk_id", "at", "reach", "last").join(starts, ["chunk_id", "reach"], "left").select("chunk_id", "at", "reach", "next", "last")


def cut_points(found: DataFrame, stages: Stages) -> DataFrame:
    """chunk_id, at, reach of all pieces, by pointer doubling over the successors."""
    step = stages.write("successors", successors(found))
    table, known = step.filter("next is not null").select("chunk_id", "at", "next"), step.filter("at = 0").select("chunk_id", "at")
    longest = table.groupBy("chunk_id").count().agg(F.max("count")).first()[0] or 0
    for k in range(math.ceil(math.log2(longest + 1))):
        ahead = known.join(table, ["chunk_id", "at"]).select("chunk_id", F.col("next").alias("at"))
        grown = known.unionAll(ahead)  # what was known lies less than 2^k pieces in, what is added beyond: no row twice
        square = table.join(table.select("chunk_id", F.col("at").alias("next"), F.col("next").alias("later")), ["chunk_id", "next"]).select("chunk_id", "at", F.col("later").alias("next"))
        known, table = stages.write("known", grown), stages.write("table", square)
        if table.isEmpty():
            break
    return known.join(step.select("chunk_id", "at", "reach"), ["chunk_id", "at"])


def split_chunks(chunks: DataFrame, configs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces of all chunks above their limit: chunk_id, piece, heading_path, text, n_tokens, overlap_chars."""
    stages = Stages(chunks.sparkSession, "split")
    found = stages.write("found", find_boundaries(chunks, configs, path))
    cuts = cut_points(found, stages).groupBy("chunk_id").agg(F.sort_array(F.collect_list(F.struct("at", "reach"))).alias("cuts"))
    places = found.join(cuts, "chunk_id").select("chunk_id", F.transform("cuts", lambda c: F.struct(F.get("pos", c["at"]).alias("a"), F.get("pos", c["reach"]).alias("b"), (F.get("cum", c["reach"]) - F.get("cum", c["at"])).alias("n"))).alias("places"))
    texts = chunks.select("chunk_id", "heading_path", "text").join(places, "chunk_id").dropDuplicates(["chunk_id"])
    pieces = texts.select("chunk_id", "heading_path", "text", "places", F.posexplode("places").alias("piece", "p"))
    before = F.when(F.col("piece") > 0, F.get("places", F.col("piece") - 1)["b"] - F.col("p.a")).otherwise(0)
    return pieces.select("chunk_id", (F.col("piece") + 1).alias("piece"), "heading_path", F.substring("text", F.col("p.a") + 1, F.col("p.b") - F.col("p.a")).alias("text"), F.col("p.n").alias("n_tokens"), before.alias("overlap_chars"))


def oversized(chunks: DataFrame, configs: DataFrame, path: str | None = None) -> DataFrame:
    """chunk_id of the chunks that come out in more than one piece."""
    stages = Stages(chunks.sparkSession, "split")
    found = stages.write("found", find_boundaries(chunks, configs, path))
    return cut_points(found, stages).filter("at > 0").select("chunk_id").distinct()
