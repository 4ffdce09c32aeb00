"""Best-fit packing of token sequences into bins of several permitted sizes.

Items of equal length are alike, so the packing is worked out on the histogram of lengths, whose size is bounded by the
largest bin and not by the data: best-fit decreasing places whole runs of equal items into whole classes of equal bins. Each
document then finds its bin from its rank among the items of its length. Nothing grows on the driver, and no task holds
a length's items together: ranks are counted within salted parts of a length.
"""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import only, save, small_batches, text_or_empty, trim
from .encoding import Lengths, encoder, tokenizer_path

SIZES = (512, 1024, 2048, 4096, 8192)
#: Words that a worker keeps with the numbers of their ids, some 90 MB: executors' heaps are full of the stages before.
WORDS = 900_000


def default_cost(size: int) -> float:
    """Work of a training sequence: a linear part, and attention's part that grows with the square."""
    return size * (1 + size / 65536)


@dataclass
class Plan:
    """Intervals of ranks: items of a length with ranks low <= r < high go to bins first + (r - low) // each, at offset + length * ((r - low) % each)."""

    length: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    size: np.ndarray
    cost: float
    bins: int


def _best_fit(counts: dict[int, int], sizes: tuple[int, ...], permitted: tuple[int, ...], cost: Callable[[int], float]) -> Plan:
    """Best-fit decreasing over the histogram, opening bins of sizes and at last shrinking each to one of permitted.

    A class of equal bins is [first bin, bins, used]; classes wait by their room.
    """
    lengths = sorted((n for n in counts if n > 0 and counts[n]), reverse=True)
    left = np.zeros(max(sizes) + 2)
    for n in lengths:
        left[n] += n * counts[n]
    below = np.cumsum(left)  # tokens of items not yet placed, up to a length
    rooms: list[int] = []
    waiting: dict[int, list[list]] = {}
    done: list[list] = []
    rows: list[list] = []
    made = 0

    def wait(group: list, room: int) -> None:
        if room <= 0:
            done.append([*group, room])
            return
        if room not in waiting:
            waiting[room] = []
            bisect.insort(rooms, room)
        waiting[room].append(group)

    for n in lengths:
        todo, rank = counts[n], 0
        below[n:] -= n * counts[n]
        while todo:
            i = bisect.bisect_left(rooms, n)
            if i < len(rooms):
                room = rooms[i]
                group = waiting[room].pop()
                if not waiting[room]:
                    del waiting[room], rooms[i]
            else:
                # The least cost for each token that the new bin is sure to get: its own items, and shorter ones still to come.
                fill = lambda s: min(s, n * min(todo, s // n) + below[min(n - 1, s)])  # noqa: E731, B023
                room = min((s for s in sizes if s >= n), key=lambda s: (cost(s) / fill(s), s))
                group = [made, max(1, todo // (room // n)), 0]
                made += group[1]
            first, bins, used = group
            each = min(room // n, todo)
            take = min(bins, todo // each)
            if take < bins:
                wait([first + take, bins - take, used], room)
            rows.append([n, rank, rank + take * each, first, each, used])
            rank, todo = rank + take * each, todo - take * each
            wait([first, take, used + each * n], room - each * n)
    for room, groups in waiting.items():
        done += [[*g, room] for g in groups]
    # Each bin shrinks to the least size that holds what it got.
    ends = sorted((first, bins, next(s for s in permitted if s >= used)) for first, bins, used, _ in done)
    starts = [e[0] for e in ends]
    out: list[list] = []
    for n, low, high, first, each, offset in rows:
        at, last = first, first + (high - low) // each
        while at < last:  # later splits of a class may have given its bins different sizes
            f, bins, size = ends[bisect.bisect_right(starts, at) - 1]
            stop = min(last, f + bins)
            out.append([n, low + (at - first) * each, low + (stop - first) * each, at, each, offset, size])
            at = stop
    table = np.array(out, dtype=np.int64).reshape(-1, 7)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return Plan(*table.T, cost=sum(bins * cost(size) for _, bins, size in ends), bins=made)


def plan_bins(counts: dict[int, int], sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = default_cost) -> Plan:
    """The cheapest of: all sizes opened jointly, or only those from some size up (a larger bin may gather the rest better)."""
    sizes = tuple(sorted(sizes))
    longest = max(counts, default=0)
    if longest > sizes[-1]:
        raise ValueError("an item is longer than the largest bin")
    return min((_best_fit(counts, sizes[i:], sizes, cost) for i in range(len(sizes))), key=lambda p: p.cost)


def pack(items: DataFrame, sizes: tuple[int, ...] = SIZES, cost: Callable[[int], float] = default_cost) -> DataFrame:
    """Packs items (doc_id, n_tokens, tie): doc_id, chunk, chunk_start, n_tokens, bin_id, bin_size, bin_offset.

    An item longer than the largest size is cut into chunks of that size and a rest; every token keeps its place in one bin.
    A length that is null or not positive gives one row with null bin columns. Equal items are told apart by doc_id,
    chunk and tie; rows that are alike in all of them may change places, which changes nothing that can be seen.
    """
    spark = items.sparkSession
    most = max(sizes)
    n = F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    cut = items.select("doc_id", "tie", n.alias("whole")).select("doc_id", "tie", "whole", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), ((F.col("whole") - 1) / most).cast("int")))).alias("chunk"))
    cut = cut.select("doc_id", "tie", "chunk", (F.col("chunk") * F.lit(most).cast("long")).alias("chunk_start"), F.greatest(F.lit(0), F.least(F.lit(most), F.col("whole") - F.col("chunk") * most)).cast("int").alias("n_tokens"))
    counts = {r.n_tokens: r["count"] for r in cut.groupBy("n_tokens").count().collect()}  # at most max(sizes) + 1 rows
    plan = plan_bins({k: v for k, v in counts.items() if k > 0}, sizes, cost)
    salts = max(16, -(-max(counts.values(), default=0) // 20_000))
    cut = cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "chunk", "tie"), F.lit(salts)).cast("int"))
    parts = cut.groupBy("n_tokens", "salt").count()
    before = Window.partitionBy("n_tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = save(parts.select("n_tokens", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before")), "packing-parts")
    own = Window.partitionBy("n_tokens", "salt").orderBy("doc_id", "chunk", "tie")
    ranked = cut.withColumn("rank", F.row_number().over(own)).join(parts, ["n_tokens", "salt"]).select("doc_id", "chunk", "chunk_start", "n_tokens", (F.col("before") + F.col("rank") - 1).alias("rank"))
    # The plan has a bounded number of intervals, as its histogram has: no more than a few for each length.
    held = spark.sparkContext.broadcast(plan)

    def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        only()
        p = held.value
        keys = p.length * (1 << 44) + p.low
        for part in parts:
            n, rank = part["n_tokens"].to_numpy(np.int64), part["rank"].to_numpy(np.int64)
            out = part[["doc_id", "chunk", "chunk_start", "n_tokens"]].copy()
            if len(keys):
                i = np.clip(np.searchsorted(keys, n * (1 << 44) + rank, side="right") - 1, 0, len(keys) - 1)
                step = rank - p.low[i]
                none = n <= 0
                out["bin_id"] = pd.array(p.first[i] + step // p.each[i], dtype="Int64")
                out["bin_size"] = pd.array(p.size[i], dtype="Int64")
                out["bin_offset"] = pd.array(p.offset[i] + n * (step % p.each[i]), dtype="Int64")
                out.loc[none, ["bin_id", "bin_size", "bin_offset"]] = pd.NA
            else:
                for c in ("bin_id", "bin_size", "bin_offset"):
                    out[c] = pd.array([pd.NA] * len(out), dtype="Int64")
            yield out

    text_id = ranked.withColumn("doc_id", F.col("doc_id").cast("string"))
    return text_id.mapInPandas(place, "doc_id string, chunk int, chunk_start long, n_tokens int, bin_id long, bin_size long, bin_offset long").withColumn("doc_id", F.col("doc_id").cast(items.schema["doc_id"].dataType))


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, tie) of docs: ids of the whole text (null: empty) and the end id; tie is the text's hash."""
    small_batches(docs.sparkSession)
    path = tokenizer or tokenizer_path()

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = encoder(path, WORDS, Lengths)
        for part in parts:
            yield pd.DataFrame({"doc_id": part["doc_id"], "n_tokens": [n + 1 for n in lengths.many(part["text"].tolist())], "tie": part["tie"]})
        trim()

    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty().alias("text"))
    return rows.withColumn("tie", F.xxhash64("text")).mapInPandas(count, "doc_id string, n_tokens long, tie long").withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def pack_documents(docs: DataFrame, sizes: tuple[int, ...] = SIZES, tokenizer: str | None = None) -> DataFrame:
    """Packs documents by their token counts; see pack(). An empty table gives no row."""
    return pack(save(token_counts(docs, tokenizer), "packing-lengths"), sizes)
