"""Problem 5: pairs of similar texts, and the groups that they form, without comparing all pairs.

Similarity is the share of common runs of 5 characters, in the consistent form of problem 3 without white space.

Method: BK-trees. Equal forms are one class, and only its representative goes on. A task gives each text 128 minima of its
runs' hashes (4 hashings of 32 bins each). Texts are shards by TABLES keys of 3 minima each, and in each shard a text has a short sketch, one bit of each of
BITS other minima. In every shard a BK-tree takes the short sketches one after the other, a child hanging at the integer distance to its parent, and a
new text follows only the edges within the radius. The radius is small against the spread of the distances, so a tree is mostly not visited: of 2,400 sketches
of real texts a search sees about a seventh. What a tree finds must also be within WIDE_RADIUS by its long sketch (two bits of each minimum), is compared by all minima (a byte of
each), and what is near the threshold by then exactly, run by run.
The trees are built where the shuffle brings a shard, not broadcast: broadcasting them would take the sketches of all texts through the driver.

A shard of more than `shard` texts is cut into blocks before it is gathered; a tree is built for each block, and each block's texts
search the trees of the blocks before it in tasks of their own, so no text and no pair is left out and no task grows with the shard. Which shards are that large is
told by a sixteenth of the texts; one that slips through is found when it is read, and its rows take the same way then. Both ways give the same pairs.

Chance: a pair at the threshold of 0.6 shares a key and lies within the radius in a table with a probability of 0.12, and misses all TABLES with 1.2 %; a pair of 0.65
misses with 0.15 %.

Defined cases: null, empty and blank texts, and texts of fewer than `min_chars` characters in that form, are in no pair; rows delivered twice
count once; equal texts under different ids are pairs.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages
from lexmill.llm.codepoints import blocks, mix64
from lexmill.llm.lookalike import Forms, letter_pairs, texts_of
from lexmill.operators.components import components

RUN, HASHINGS, BINS, SHARD = 5, 4, 32, 4096
#: Keys (and trees) that a text is in, bits of a short sketch, radius in a tree, and radius of the long sketch.
TABLES, BITS, RADIUS, WIDE_RADIUS = 34, 12, 2, 74
#: One in so many texts tells which shards are large; parts into which the copies of a text are split.
SAMPLE, SLOTS = 16, 1024
SKETCH = ["s0", "s1", "s2", "s3"]
MIN_CHARS, THRESHOLD = 80, 0.6
#: Pairs whose share of equal minima is lower than the threshold by more than this aren't compared run by run (3.2 standard deviations).
MARGIN = 0.14
NONE = np.uint32(0xFFFFFFFF)
#: Bytes of a row that is sent to its shard, and about as many as a task should get.
ROW_BYTES, TASK_BYTES = 50, 64 << 20


def runs(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of 5 code points that lie in one text, and the number of the text of each."""
    n = len(codes) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = codes.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(RUN):
        h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + n]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = text[:n] == text[RUN - 1 :]
    return mix64(h[inside]), text[:n][inside]


def minima(hashes: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """n x 128 minima; an empty bin takes those of another bin of its hashing, the same for all texts."""
    out = np.full(n * HASHINGS * BINS, NONE, np.uint32)
    multipliers = mix64(np.arange(1, HASHINGS + 1)) | np.uint64(1)
    for k in range(HASHINGS):
        x = hashes * multipliers[k]
        np.minimum.at(out, (text * HASHINGS + k) * BINS + (x >> np.uint64(59)).astype(np.int64), (x >> np.uint64(27)).astype(np.uint32))
    out = out.reshape(n * HASHINGS, BINS)
    given = out.copy()
    for turn in range(1, 200):
        row, col = np.nonzero(out == NONE)
        if not len(row):
            break
        other = (mix64(col.astype(np.uint64) * np.uint64(1000) + np.uint64(turn)) % np.uint64(BINS)).astype(np.int64)
        out[row, col] = given[row, other]
    return out.reshape(n, HASHINGS, BINS)


def _places() -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]]]:
    """For each table the minima of its key and those of its bits, as (hashing, bin).

    The first 32 keys take one bin of three hashings, the others three bins of the fourth, so no minimum is in two keys. The bits are of
    minima scattered over all that aren't in the key: two tables have about one in common, so that they fail a pair independently.
    """
    out = []
    for t in range(TABLES):
        own = [(k, t) for k in range(3)] if t < BINS else [(3, (t - BINS) * 3 + k) for k in range(3)]
        others = [p for p in ((k, b) for k in range(HASHINGS) for b in range(BINS)) if p not in own]
        order = np.argsort(mix64(np.arange(len(others)) + 1000 * t))[:BITS]
        out.append((own, [others[i] for i in order]))
    return out


PLACES = _places()


def tables(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key and short sketch of each text in each table, from minima (texts x HASHINGS x BINS)."""
    n = len(m)
    keys, short = np.zeros((n, TABLES), np.uint64), np.zeros((n, TABLES), np.int64)
    bits = (mix64(m) & np.uint64(1)).astype(np.int64)
    for t, (own, others) in enumerate(PLACES):
        for k, b in own:
            keys[:, t] = mix64(keys[:, t] ^ m[:, k, b]) + np.uint64(t)
        for j, (k, b) in enumerate(others):
            short[:, t] |= bits[:, k, b] << j
    return keys, short


def sketches(texts: DataFrame, pairs: dict[str, float], min_chars: int = MIN_CHARS) -> DataFrame:
    """tbl, id, form (digest), s0 to s3 (the long sketch), fine (a byte of each minimum), keys (of shards) and short (sketches in them) of the texts long enough, each row once."""
    schema = "tbl string, id bigint, form binary, s0 bigint, s1 bigint, s2 bigint, s3 bigint, fine binary, keys array<bigint>, short array<smallint>"

    def run(batches):
        forms = Forms.of(pairs)
        for batch in batches:
            given = batch.column(2).to_pylist()
            for a, b in blocks(given, 400_000):
                codes, offsets = forms.codes(given[a:b], blanks=False)
                long = np.flatnonzero(np.diff(offsets) >= min_chars)
                if not len(long):
                    continue
                hashes, text = runs(codes, offsets)
                data = codes.tobytes()
                m = minima(hashes, text, b - a)[long]
                bits = mix64(m).reshape(len(long), 128, 1) >> np.array([0, 1], np.uint64) & np.uint64(1)
                words = np.packbits(bits.astype(np.uint8).reshape(len(long), 256), axis=1).view(">i8").astype(np.int64)
                key, short = tables(m)
                names = batch.column(0).slice(a, b - a).take(pa.array(long))
                other = np.array([t == "chunks" for t in names.to_pylist()], np.uint64)
                key = mix64(key + other[:, None])
                yield pa.RecordBatch.from_arrays(
                    [
                        names,
                        batch.column(1).slice(a, b - a).take(pa.array(long)),
                        pa.array([hashlib.blake2b(data[offsets[i] * 4 : offsets[i + 1] * 4], digest_size=12).digest() for i in long], pa.binary()),
                        *(pa.array(np.ascontiguousarray(words[:, k])) for k in range(4)),
                        pa.array([x.tobytes() for x in (mix64(m + np.uint32(1)) >> np.uint64(8)).astype(np.uint8).reshape(len(long), -1)], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1) * TABLES, pa.int32()), pa.array(key.view(np.int64).ravel())),
                        pa.ListArray.from_arrays(pa.array(np.arange(len(long) + 1) * TABLES, pa.int32()), pa.array(short.astype(np.int16).ravel())),
                    ],
                    schema=pa.schema([("tbl", pa.string()), ("id", pa.int64()), ("form", pa.binary()), *((n, pa.int64()) for n in SKETCH), ("fine", pa.binary()), ("keys", pa.list_(pa.int64())), ("short", pa.list_(pa.int16()))]),
                )

    return texts.filter(F.length("text") >= min_chars).mapInArrow(run, schema)


class BKTree:
    """Sketches (integers) in a tree by Hamming distance; each node holds the numbers of the items with its sketch."""

    def __init__(self):
        self.root = None

    def add(self, sketch: int, item: int) -> None:
        if self.root is None:
            self.root = (sketch, [item], {})
            return
        node = self.root
        while True:
            distance = (node[0] ^ sketch).bit_count()
            if not distance:
                node[1].append(item)
                return
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = (sketch, [item], {})
                return
            node = child

    def within(self, sketch: int, radius: int) -> list[int]:
        found, todo = [], [self.root] if self.root else []
        self.visited = 0
        while todo:
            value, items, children = todo.pop()
            self.visited += 1
            distance = (value ^ sketch).bit_count()
            if distance <= radius:
                found += items
            for edge, child in children.items():
                if distance - radius <= edge <= distance + radius:
                    todo.append(child)
        return found


_COLUMNS = ["key", "block", "home", "id", "short", *SKETCH]


def _search_shards(batches, radius: int, limit: int):
    """Over rows of _COLUMNS sorted by the first two: pairs that trees find (kind 0). Of a shard with more than `limit` rows, those above go out again as
    they are (kind 1), with the first ones; no more than `limit` rows of a shard are held."""

    def pairs_of(group: dict[str, np.ndarray], out: list):
        size = len(group["id"])
        if size < 2:
            return
        short, home = group["short"].tolist(), group["home"].tolist()
        mixed = not all(home)
        tree, a, b = BKTree(), [], []
        for i in range(size):
            if home[i]:
                if not mixed:
                    near = tree.within(short[i], radius)
                    a += near
                    b += [i] * len(near)
                tree.add(short[i], i)
        if mixed:
            for i in range(size):
                if not home[i]:
                    near = tree.within(short[i], radius)
                    a += near
                    b += [i] * len(near)
        if a:
            a, b = np.array(a), np.array(b)
            far = sum(np.bitwise_count((group[n][a] ^ group[n][b]).view(np.uint64)).astype(np.int64) for n in SKETCH)
            x, y = group["id"][a[far <= WIDE_RADIUS]], group["id"][b[far <= WIDE_RADIUS]]
            zero = np.zeros(len(x), np.int64)
            out.append((np.zeros(len(x), np.int8), zero, np.minimum(x, y), np.maximum(x, y), zero.astype(np.int16), zero, zero, zero, zero))

    def again(group: dict[str, np.ndarray], out: list):
        out.append((np.ones(len(group["id"]), np.int8), group["key"], group["id"], group["id"], *(group[n] for n in ("short", *SKETCH))))

    def flush(out: list):
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["kind", "key", "x", "y", "short", *SKETCH])

    rest: dict[str, np.ndarray] | None = None
    over = None  # the shard whose rows go out again
    for batch in batches:
        now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(batch.schema.names, batch.columns)}
        if rest is not None and len(rest["id"]):
            now = {n: np.concatenate((rest[n], now[n])) for n in now}
        starts = np.concatenate(([0], np.flatnonzero(np.diff(now["key"]) | np.diff(now["block"])) + 1, [len(now["id"])]))
        out: list = []
        for k, (s, e) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())):
            group = {n: c[s:e] for n, c in now.items()}
            last = k == len(starts) - 2
            if (int(now["key"][s]), int(now["block"][s])) == over or e - s > limit:
                over = (int(now["key"][s]), int(now["block"][s]))
                again(group, out)
                group = {n: c[:0] for n, c in group.items()}
            if last:
                rest = group
            elif e - s > 1:
                pairs_of(group, out)
        yield from flush(out)
    if rest is not None:
        out = []
        pairs_of(rest, out)
        yield from flush(out)


def candidates(classes: DataFrame, stages: Stages, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """tbl, a, b: representatives that a BK-tree found within the radius of each other. `classes`: tbl, id, s0 to s3, keys, short.

    Ids of the two tables may be equal; while a shard's key tells them apart, the table goes along in the id's lowest bit.
    """
    schema = "kind tinyint, key bigint, x bigint, y bigint, short smallint, s0 bigint, s1 bigint, s2 bigint, s3 bigint"
    coded = classes.select((F.col("id") * 2 + (F.col("tbl") == "chunks").cast("bigint")).alias("id"), *SKETCH, F.explode(F.arrays_zip("keys", "short")).alias("k"))
    rows = coded.select(F.col("k.keys").alias("key"), F.lit(0).cast("bigint").alias("block"), F.lit(True).alias("home"), "id", F.col("k.short").alias("short"), *SKETCH)

    at_least = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(at_least, classes.count() * TABLES * ROW_BYTES // TASK_BYTES)  # as many as the rows ask for: a task's share doesn't grow with the data

    def search(rows: DataFrame, limit: int) -> DataFrame:
        return rows.select(*_COLUMNS).repartition(tasks, "key", "block").sortWithinPartitions("key", "block").mapInArrow(lambda batches: _search_shards(batches, radius, limit), schema)

    some = classes.filter(F.pmod(F.xxhash64("id"), F.lit(SAMPLE)) == 0).select(F.explode("keys").alias("key"))
    hot = stages.write("hot", some.groupBy("key").count().filter(F.col("count") * SAMPLE > shard).select("key"))
    first = stages.write("search", search(rows.join(hot, "key", "left_anti"), 2 * shard))
    found = first.filter("kind = 0").select(F.col("x").alias("a"), F.col("y").alias("b"))
    large = first.filter("kind = 1").select("key", F.col("x").alias("id"), "short", *SKETCH)
    if not hot.isEmpty():
        large = large.unionAll(rows.join(hot, "key", "left_semi").select("key", "id", "short", *SKETCH))
    sizes = stages.write("sizes", large.groupBy("key").agg(F.ceil(F.count("*") / (shard / 2)).cast("bigint").alias("n")))
    if not sizes.isEmpty():
        found = found.unionAll(_blocks(large, sizes, search))
    found = found.distinct()
    return found.select(F.when(F.col("a") % 2 == 1, "chunks").otherwise("conversion_results").alias("tbl"), F.shiftright("a", 1).alias("a"), F.shiftright("b", 1).alias("b"))


def _blocks(large: DataFrame, sizes: DataFrame, search) -> DataFrame:
    """Pairs of the shards above the limit: blocks by hash, a tree for each, and each block's texts in the trees of the blocks before."""
    rows = large.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("n")))
    home = rows.select("key", F.explode(F.sequence(F.col("own"), F.col("n") - 1)).alias("other"), "own", "n", "id", "short", *SKETCH)
    visit = rows.select("key", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("own"))).alias("block"), "own", "n", "id", "short", *SKETCH)
    # the pair of blocks (block, other), block <= other: the tree of the first, searched by the second
    a = home.select("key", (F.col("own") * F.col("n") + F.col("other")).alias("block"), F.lit(True).alias("home"), "id", "short", *SKETCH)
    b = visit.filter("block < own").select("key", (F.col("block") * F.col("n") + F.col("own")).alias("block"), F.lit(False).alias("home"), "id", "short", *SKETCH)
    return search(a.unionAll(b), 1 << 40).select(F.col("x").alias("a"), F.col("y").alias("b"))


def similarity(pairs: DataFrame, texts: DataFrame, letters: dict[str, float]) -> DataFrame:
    """tbl, a, b and the exact similarity of pairs; `texts` (tbl, id, text) are read again for the ids in pairs only."""
    ids = pairs.select("tbl", F.explode(F.array("a", "b")).alias("id")).distinct()
    some = texts.join(ids, ["tbl", "id"], "left_semi").dropDuplicates(["tbl", "id"])
    both = pairs.join(some.select("tbl", F.col("id").alias("a"), F.col("text").alias("text_a")), ["tbl", "a"]).join(some.select("tbl", F.col("id").alias("b"), F.col("text").alias("text_b")), ["tbl", "b"])

    @F.pandas_udf("double")
    def share(a, b):
        import pandas as pd

        forms, out = Forms.of(letters), []
        a, b = list(a), list(b)
        for i, j in blocks([x + y for x, y in zip(a, b)], 400_000):
            number = {t: k for k, t in enumerate(dict.fromkeys(a[i:j] + b[i:j]))}
            hashes, text = runs(*forms.codes(list(number), blanks=False))
            cuts = np.searchsorted(text, np.arange(len(number) + 1))
            sets = [np.unique(hashes[s:e]) for s, e in zip(cuts[:-1], cuts[1:])]
            for x, y in zip(a[i:j], b[i:j]):
                x, y = sets[number[x]], sets[number[y]]
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) and len(y) else 0
                out.append(common / max(1, len(x) + len(y) - common))
        return pd.Series(out, dtype=float)

    return both.select("tbl", "a", "b", share("text_a", "text_b").alias("similarity"))


def near(pairs: DataFrame, fine: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose minima are equal often enough to be worth the exact comparison."""

    @F.pandas_udf("double")
    def equal(a, b):
        import pandas as pd

        width = HASHINGS * BINS
        x, y = (np.frombuffer(b"".join(c), np.uint8).reshape(-1, width) for c in (a, b))
        return pd.Series(((x == y).mean(1) - 1 / 256) / (1 - 1 / 256))

    both = pairs.join(fine.select("tbl", F.col("id").alias("a"), F.col("fine").alias("fine_a")), ["tbl", "a"]).join(fine.select("tbl", F.col("id").alias("b"), F.col("fine").alias("fine_b")), ["tbl", "b"])
    return both.filter(equal("fine_a", "fine_b") >= threshold - MARGIN).select("tbl", "a", "b")


def classes_and_links(chunks: DataFrame, results: DataFrame, threshold: float = THRESHOLD, min_chars: int = MIN_CHARS, label: str = "neardup") -> tuple[DataFrame, DataFrame]:
    """Members (tbl, id, rep: the smallest id with an equal form) and links between representatives (tbl, a, b, similarity)."""
    texts = texts_of(chunks, results)
    stages = Stages(texts.sparkSession, label)
    letters = letter_pairs(texts)
    own = stages.write("sketches", sketches(texts, letters, min_chars).withColumn("row", F.monotonically_increasing_id()))
    reps = stages.write("reps", own.groupBy("tbl", "form").agg(F.min(F.struct("id", "row")).alias("first")))
    members = own.select("tbl", "id", "form").distinct().join(reps, ["tbl", "form"])
    members = stages.write("members", members.select("tbl", "id", F.col("first.id").alias("rep")))
    first = stages.write("classes", own.drop("form").join(reps.select(F.col("first.row").alias("row")).hint("merge"), "row", "left_semi").drop("row"))
    stages.drop("sketches", "reps")
    found = stages.write("found", near(candidates(first.drop("fine"), stages), first, threshold))
    stages.drop("search", "classes", "hot", "sizes")
    links = stages.write("links", similarity(found, texts, letters).filter(F.col("similarity") >= threshold))
    stages.drop("found")
    return members, links


def similar_pairs(chunks: DataFrame, results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """tbl, id_a, id_b of all rows above the threshold: the links of representatives for all their members, and equal forms.

    Links are expanded by slots of members, SLOTS for a class, so that a text with very many copies isn't one key.
    """
    members, links = classes_and_links(chunks, results, threshold)
    rows = members.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(SLOTS)))
    slots = rows.groupBy("tbl", "rep", "slot").agg(F.count("*").alias("n"))
    several = slots.groupBy("tbl", "rep").agg(F.sum("n").alias("n")).filter("n > 1").select("tbl", F.col("rep").alias("a"), F.col("rep").alias("b"))
    pairs = links.select("tbl", "a", "b").unionByName(several)
    for k in "ab":
        pairs = pairs.join(slots.select("tbl", F.col("rep").alias(k), F.col("slot").alias(f"slot_{k}")), ["tbl", k])
    pairs = pairs.filter("a != b or slot_a <= slot_b")
    for k in "ab":
        pairs = pairs.join(rows.select("tbl", F.col("rep").alias(k), F.col("slot").alias(f"slot_{k}"), F.col("id").alias(f"id_{k}")), ["tbl", k, f"slot_{k}"])
    pairs = pairs.filter("a != b or slot_a < slot_b or id_a < id_b")
    return pairs.select("tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def similar_groups(chunks: DataFrame, results: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """tbl, id, rep (its class of equal forms), group (the smallest id of the component of links), n_links (of its class) and
    n_copies of the class, of each row that has a similar one. Copies aren't expanded into pairs."""
    members, links = classes_and_links(chunks, results, threshold, label="groups")
    ends = links.select("tbl", F.explode(F.array("a", "b")).alias("rep")).groupBy("tbl", "rep").agg(F.count("*").alias("n_links"))
    edges = links.select(F.struct("tbl", F.col("a").alias("id")).alias("a"), F.struct("tbl", F.col("b").alias("id")).alias("b"))
    found = components(edges).select(F.col("node.tbl").alias("tbl"), F.col("node.id").alias("rep"), F.col("component.id").alias("group"))
    copies = members.groupBy("tbl", "rep").agg(F.count("*").alias("n_copies"))
    each = copies.join(ends, ["tbl", "rep"], "left").join(found, ["tbl", "rep"], "left").filter("n_copies > 1 or n_links is not null")
    each = each.select("tbl", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("group", "rep").alias("group"))
    return members.join(each, ["tbl", "rep"]).select("tbl", "id", "rep", "group", "n_links", "n_copies")
