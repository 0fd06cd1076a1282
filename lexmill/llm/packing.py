"""Problem 7: documents put into containers of a fixed capacity with little unused space; only longer ones are split.

Method: swap-based local search. Items (documents, or the full and the last parts of a document above the capacity) go to neighbourhoods of bounded
size, where they are placed best-fit in order of size; then the search fills the underfull bins from the emptier ones, by a move, an exchange of one for one, or of two for
one, whichever fills most, and only where the sum of squared fills grows. That sum has a largest value, so the search ends when no move and no exchange is left, and not before:
full bins get fuller, the emptiest become empty and vanish.
Bins that are nearly full are done; what lies in the others goes to new, mixed neighbourhoods in the next round, until a round saves no
more than LEAST_SAVED of them, or there is only one neighbourhood.

A neighbourhood has about ITEMS items: the number of neighbourhoods, not their size, grows with the data, and each is a group of its own in a task.

Containers are numbered from 0 on without gaps: done bins are numbered within their neighbourhood, and sums over neighbourhoods tell where each one's numbers start.

Defined cases: null and empty texts, which have no tokens, are in no container; of rows with the same id one counts; an item that fills the capacity has its own
container; a document above the capacity comes out as parts of `capacity` tokens and a last part that is packed like any other.
"""

from __future__ import annotations

import bisect

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.checkpoints import Stages
from lexmill.llm.bpe import count_tokens

ITEMS = 4_000
#: A bin with at most this share of its capacity unused is done; each later round allows as much again, up to MOST_UNUSED. It decides what is mixed
#: again, and leaves no item out.
NEARLY_FULL, MOST_UNUSED = 0.002, 0.02
#: The rounds end when one saves no more than this share of the bins that it began with.
LEAST_SAVED = 0.001
#: Neighbourhoods whose numbers of bins are summed up in one task.
WIDE = 10_000


def fill_bins(sizes: np.ndarray, capacity: int, search: bool = True) -> np.ndarray:
    """The bin of each item: best fit by falling size, then, with `search`, local search until nothing improves."""
    order = np.argsort(-sizes, kind="stable")
    of = np.zeros(len(sizes), np.int64)
    bins: list[list[int]] = []
    fill: list[int] = []
    free: list[tuple[int, int]] = []  # (unused, bin), sorted
    for i in order.tolist():
        size = int(sizes[i])
        k = bisect.bisect_left(free, (size, -1))
        if k < len(free):
            unused, b = free.pop(k)
        else:
            unused, b = capacity, len(bins)
            bins.append([])
            fill.append(0)
        bins[b].append(i)
        fill[b] += size
        bisect.insort(free, (unused - size, b))
    while search and _improve(bins, fill, sizes, capacity):
        pass
    for number, b in enumerate(x for x in bins if x):
        of[b] = number
    return of


def _improve(bins: list[list[int]], fill: list[int], sizes: np.ndarray, capacity: int) -> bool:
    """One turn over the underfull bins, the fullest first: each is filled from the bins after it while the sum of squared fills grows."""
    low = sorted((b for b in range(len(bins)) if bins[b] and fill[b] < capacity), key=lambda b: (-fill[b], b))
    pool = sorted((int(sizes[i]), i) for b in low for i in bins[b])  # what lies in the bins after the one that is filled
    home = {i: b for b in low for i in bins[b]}
    changed = False

    def at_most(limit: int) -> tuple[int, int] | None:
        k = bisect.bisect_right(pool, (limit, 1 << 60))
        return pool[k - 1] if k else None

    def two_at_most(limit: int, values: np.ndarray, first: np.ndarray) -> tuple[tuple[int, int], tuple[int, int]] | None:
        """Two items of the pool with the largest sum within the limit. `values`: distinct sizes; `first`: where each starts in the pool."""
        other = np.searchsorted(values, limit - values, "right") - 1
        good = other >= 0
        once = np.diff(np.append(first, len(pool))) < 2
        clash = good & once & (other == np.arange(len(values)))  # a size that is there once isn't taken twice
        other[clash] -= 1
        good &= other >= 0
        if not good.any():
            return None
        total = np.where(good, values + values[np.maximum(other, 0)], -1)
        k = int(total.argmax())
        a, b = pool[first[k]], pool[first[other[k]] + (1 if other[k] == k else 0)]
        return a, b

    def gain(b: int, take: list[tuple[int, int]], give: int | None) -> int | None:
        """Growth of the sum of squared fills when b takes some items and gives one to the first one's bin; null where a bin would run over."""
        delta: dict[int, int] = {b: sum(s for s, _ in take)}
        for s, i in take:
            delta[home[i]] = delta.get(home[i], 0) - s
        if give is not None:
            delta[b] -= int(sizes[give])
            delta[home[take[0][1]]] += int(sizes[give])
        if any(fill[a] + d > capacity for a, d in delta.items()):
            return None
        return sum((fill[a] + d) ** 2 - fill[a] ** 2 for a, d in delta.items())

    for b in low:
        for i in bins[b]:
            pool.pop(bisect.bisect_left(pool, (int(sizes[i]), i)))
        while pool and bins[b] and fill[b] < capacity:
            room = capacity - fill[b]
            options: list[tuple[int, list[tuple[int, int]], int | None]] = []
            if one := at_most(room):
                options.append((one[0], [one], None))
            if not one or one[0] < room:  # nothing fills the bin by itself
                flat = np.array([s for s, _ in pool])
                values, first = np.unique(flat, return_index=True)
                given = {int(sizes[i]): i for i in bins[b]}  # of items of one size, any
                for size, i in given.items():
                    if (one := at_most(room + size)) and one[0] > size:
                        options.append((one[0] - size, [one], i))
                    if two := two_at_most(room + size, values, first):
                        if two[0][0] + two[1][0] > size:
                            options.append((two[0][0] + two[1][0] - size, list(two), i))
            options.sort(key=lambda o: -o[0])
            for _, take, give in options:
                g = gain(b, take, give)
                if g is not None and g > 0:
                    break
            else:
                break
            away = home[take[0][1]]
            for s, i in take:
                pool.pop(bisect.bisect_left(pool, (s, i)))
                bins[home[i]].remove(i)
                fill[home[i]] -= s
                bins[b].append(i)
                fill[b] += s
                home[i] = b
            if give is not None:
                bins[b].remove(give)
                fill[b] -= int(sizes[give])
                bins[away].append(give)
                fill[away] += int(sizes[give])
                home[give] = away
                bisect.insort(pool, (int(sizes[give]), give))
            changed = True
    return changed


def _pack_round(items: DataFrame, groups: int, capacity: int, most_unused: int, turn: int) -> DataFrame:
    """doc_id, part, size, turn, g, bin: items in neighbourhoods `g` by hash; bins with at most `most_unused` are done and numbered from 0 in
    their neighbourhood, the others' bins are -1, -2 and so on."""
    schema = "doc_id bigint, part int, size int, turn int, g bigint, bin int"

    def pack(rows):
        import pandas as pd

        sizes = rows["size"].to_numpy()
        of = fill_bins(sizes, capacity)
        done = capacity - np.bincount(of, sizes).astype(np.int64) <= most_unused
        number = np.where(done, np.cumsum(done) - 1, -np.cumsum(~done))
        return pd.DataFrame({"doc_id": rows["doc_id"], "part": rows["part"], "size": rows["size"], "turn": turn, "g": rows["g"], "bin": number[of].astype("int32")})

    spark = items.sparkSession
    tasks = min(groups, max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups // 16))  # stated, so that few bytes don't put all neighbourhoods into one task
    mixed = items.select("doc_id", "part", "size", F.pmod(F.xxhash64("doc_id", "part", F.lit(turn)), F.lit(groups)).alias("g"))
    return mixed.repartition(tasks, "g").groupBy("g").applyInPandas(pack, schema)


def _numbered(done: DataFrame) -> DataFrame:
    """Rows (turn, g, bin) with `container`, a number for each of their bins, from 0 on without gaps.

    Only one row for each neighbourhood is summed up, in stretches of WIDE neighbourhoods and then over the stretches.
    """
    sums = done.groupBy("turn", "g").agg((F.max("bin").cast("bigint") + 1).alias("n")).withColumn("stretch", F.floor(F.col("g") / WIDE))
    before = lambda own: F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wide = sums.groupBy("turn", "stretch").agg(F.sum("n").alias("n")).withColumn("base", before(Window.orderBy("turn", "stretch"))).drop("n")
    starts = sums.withColumn("inside", before(Window.partitionBy("turn", "stretch").orderBy("g"))).join(wide, ["turn", "stretch"]).select("turn", "g", (F.col("base") + F.col("inside")).alias("first"))
    return done.join(starts, ["turn", "g"]).withColumn("container", F.col("first") + F.col("bin"))


def items_of(documents: DataFrame, capacity: int, path: str | None = None) -> DataFrame:
    """doc_id, part, size: one row for each document with tokens, and one for each part of those above the capacity."""
    counted = count_tokens(documents.select("doc_id", "text").filter(F.length("text") > 0), path=path).select("doc_id", "n_tokens").dropDuplicates(["doc_id"])
    parts = F.transform(F.sequence(F.lit(0), ((F.col("n_tokens") - 1) / capacity).cast("int")), lambda k: F.least(F.lit(capacity), F.col("n_tokens") - k * capacity).cast("int"))
    return counted.filter("n_tokens > 0").select("doc_id", F.posexplode(parts).alias("part", "size"))


def pack(documents: DataFrame, capacity: int, items: int = ITEMS, path: str | None = None) -> DataFrame:
    """container (numbers from 0 on), doc_id, part, start and n_tokens (of the part in its document): every document with tokens once."""
    stages = Stages(documents.sparkSession, "packing")
    all_items = stages.write("items", items_of(documents, capacity, path))
    left, turn = all_items.filter(F.col("size") < capacity), 0
    n, n_full = all_items.agg(F.count_if(F.col("size") < capacity), F.count_if(F.col("size") == capacity)).first()
    alone = Window.partitionBy("g").orderBy("doc_id", "part")  # a full item is a bin of its own
    full = all_items.filter(F.col("size") == capacity).withColumn("turn", F.lit(-1)).withColumn("g", F.pmod(F.xxhash64("doc_id", "part"), F.lit(max(1, -(-n_full // items)))))
    done = full.withColumn("bin", F.row_number().over(alone) - 1)
    bins = n
    while n:
        groups = -(-n // items)
        most_unused = int(min(MOST_UNUSED, NEARLY_FULL * (1 + turn)) * capacity)
        packed = stages.write(f"round{turn}", _pack_round(left, groups, capacity, most_unused, turn))
        left = packed.filter("bin < 0").select("doc_id", "part", "size")
        n, now = packed.agg(F.count_if(F.col("bin") < 0), F.count_distinct("g", "bin")).first()
        if groups == 1 or bins - now <= LEAST_SAVED * bins:  # the rest stays as it is, its bins numbered after the done ones of their neighbourhood
            most = F.coalesce(F.max("bin").over(Window.partitionBy("turn", "g")), F.lit(-1))
            done = done.unionByName(packed.withColumn("most", F.greatest(most, F.lit(-1))).withColumn("bin", F.when(F.col("bin") < 0, F.col("most") - F.col("bin")).otherwise(F.col("bin"))).drop("most"))
            break
        done = done.unionByName(packed.filter("bin >= 0"))
        bins = packed.filter("bin < 0").agg(F.count_distinct("g", "bin")).first()[0]
        turn += 1
    return _numbered(done).select("container", "doc_id", "part", (F.col("part").cast("bigint") * capacity).alias("start"), F.col("size").alias("n_tokens"))


def capacity_of(containers: DataFrame, name: str) -> int:
    """The capacity of the container with this name; the smallest if it is there more than once."""
    found = containers.filter(F.col("container_name") == name).agg(F.min("capacity_tokens")).first()[0]
    if not found or found < 1:
        raise ValueError(f"no container {name!r} with a capacity")
    return int(found)
