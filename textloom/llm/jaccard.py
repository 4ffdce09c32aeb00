"""Exact set-similarity join of documents on word shingles, by signature trees.

1. Documents with equal shingle sets collapse into one representative.
2. Two sets can only reach the similarity if they share a shingle among their first few in a global order (prefix
   filter): by hash, with very common shingles last. Each such shingle is a bucket of representatives.
3. Most pairs are settled at first by comparing each representative with the one that answers for most of its buckets. What is
   linked becomes one class.
4. Each bucket that still holds several classes gets a signature tree: leaves hold bitmaps of a set's shingles,
   inner nodes the OR of their children's and their range of sizes. The tree is traversed against itself; a pair of nodes is
   dropped if the largest overlap that its bitmaps and sizes allow falls short. Leaf pairs of different classes that
   survive are compared exactly. A large bucket is split into blocks, and pairs of blocks go to tasks.
5. Classes are the connected components of all links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, only, save, small_batches, text_or_empty, tidy, trim

#: Shingles that more prefixes hold count as common, the most common COMMON_MOST of them at least. Any choice gives the same links.
COMMON, COMMON_MOST = 12, 200_000
BITS = 2048
BLOCK, FANOUT = 512, 8
#: Rows of a cell that one node holds, and rows that a task takes at a time.
NODE, BUNDLE_ROWS = 32, 20_000
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)]


#: Words stand between these bytes: space and 9 to 13. In UTF-8 they are parts of no other character.
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
SLICE = 1 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M[4]
    h = (h ^ (h >> np.uint64(29))) * _M[5]
    return h ^ (h >> np.uint64(32))


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data and where they start: a polynomial of each word's bytes, all words at once."""
    b = np.frombuffer(data, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    n = ends - starts
    letters = b[~space].astype(np.uint64) + np.uint64(1)
    first = np.cumsum(n) - n
    place = np.arange(len(letters)) - np.repeat(first, n)
    power = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(n.max()) - 1, _M[0])]))
    return _mix(np.add.reduceat(letters * power[place], first)), starts


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """_word_hashes() of slices that end between words, so that memory is bounded by a slice or the longest word."""
    out, at = [], 0
    while at < len(data):
        end = at + SLICE
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        h, starts = _word_hashes(data[at:end])
        out.append((h, starts + at))
        at = end
    return (np.concatenate([h for h, _ in out]), np.concatenate([s for _, s in out])) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingles(texts: list, k: int) -> list[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct k-word shingles; of the whole sequence if it has fewer words."""
    out, i = [], 0
    while i < len(texts):
        group, size = [], 0
        while i < len(texts) and (not group or size < SLICE):
            group.append(texts[i].encode("utf-8", "surrogatepass").lower() if texts[i] else b"")
            size += len(group[-1]) + 1
            i += 1
        w, starts = word_hashes(b" ".join(group))
        begin = np.cumsum([0, *(len(g) + 1 for g in group)])
        bounds = np.searchsorted(starts, begin)
        n = max(0, len(w) - k + 1)
        h = w[:n] * _M[0]
        for j in range(1, k):
            h = (h ^ (h >> np.uint64(29))) * _M[1] + w[j : j + n] * _M[2 + j % 6]
        h = _mix(h)
        for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if z - a >= k:
                own = np.sort(h[a : z - k + 1])
                keep = np.empty(len(own), bool)
                keep[0], keep[1:] = True, own[1:] != own[:-1]
                out.append(own[keep])
            elif z > a:
                short = np.array([z - a], np.uint64)
                for x in w[a:z, None]:  # arrays of one, whose products wrap around without a warning
                    short = (short ^ (short >> np.uint64(29))) * _M[1] + x * _M[3]
                out.append(_mix(short ^ _M[6]))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def needed(n: int, percent: int) -> int:
    """Least overlap with a set of n shingles at a similarity of percent / 100."""
    return -(-percent * n // 100)


def _prefix(h: np.ndarray, percent: int, common: np.ndarray) -> np.ndarray:
    n = len(h)
    p = n - needed(n, percent) + 1
    if len(common) and n:
        at = np.searchsorted(common, h)
        last = common[np.minimum(at, len(common) - 1)] == h
        if last.any():
            return np.concatenate([h[~last], h[last]])[:p]
    return h[:p]


def set_table(docs: DataFrame, k: int, percent: int, common: list[int]) -> DataFrame:
    """(doc_id, n_shingles, digest, prefix) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(common, np.int64).view(np.uint64)))

    @F.pandas_udf("struct<n_shingles:bigint, digest:binary, prefix:array<bigint>>")
    def sets(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        only()
        for part in parts:
            rows = []
            for h in shingles(part.tolist(), k):  # a prefix is copied, for a view would hold the whole set
                rows.append((len(h), hashlib.blake2b(h.tobytes(), digest_size=16).digest(), _prefix(h, percent, held.value).view(np.int64).copy()))
            yield pd.DataFrame(rows, columns=["n_shingles", "digest", "prefix"])
        trim()

    return docs.select(F.col("doc_id"), sets(text_or_empty()).alias("s")).select("doc_id", "s.*")


def _linked(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids whose sets reach the similarity, compared exactly."""
    pairs = save(pairs.select("a", "b").distinct(), "jaccard-pairs")
    ids = save(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "jaccard-ids")

    @F.pandas_udf("binary")
    def packed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only()
        for part in parts:
            yield pd.Series([h.tobytes() for h in shingles(part.tolist(), k)], dtype=object)
        trim()

    @F.pandas_udf("boolean")
    def enough(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = len(x) + len(y) - len(np.union1d(x, y))
            out.append(100 * both >= percent * (len(x) + len(y) - both) > 0)
        return pd.Series(out)

    own = docs.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id", "left_semi")
    held = save(own.dropDuplicates(["doc_id"]).select("doc_id", packed("text").alias("s")), "jaccard-sets")
    both = pairs.join(held.withColumnsRenamed({"doc_id": "a", "s": "x"}), "a").join(held.withColumnsRenamed({"doc_id": "b", "s": "y"}), "b")
    links = save(both.where(enough("x", "y")).select("a", "b"), "jaccard-links")
    drop(pairs, ids, held)
    return links


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BITS // 64), np.uint64)
    for i, h in enumerate(sets):
        bit = (h >> np.uint64(7)) % np.uint64(BITS)
        np.bitwise_or.at(out[i], (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


class Tree:
    """Levels of nodes over sets ordered by size: bitmap, least and most size, and the most shingles a set holds beyond its bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        extra = sizes - np.bitwise_count(bits).sum(1)
        self.levels = [(bits, sizes, sizes, extra)]
        while len(self.levels[-1][1]) > 1:
            b, lo, hi, ex = self.levels[-1]
            at = np.arange(0, len(lo), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(b, at), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(ex, at)))

    def bound(self, level: int, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Whether nodes i and j of a level may hold sets similar enough."""
        b, lo, hi, ex = self.levels[level]
        least = np.maximum(np.maximum(lo[i], lo[j]), 1)
        ok = (100 * hi[i] >= percent * lo[j]) & (100 * hi[j] >= percent * lo[i])
        k = np.flatnonzero(ok)
        for part in np.array_split(k, max(1, len(k) // 20_000)):
            p, q = i[part], j[part]
            most = np.bitwise_count(b[p] & b[q]).sum(1) + np.minimum(ex[p], ex[q])
            most = np.minimum(most, np.minimum(hi[p], hi[q]))
            # overlap o must be at least percent * |union|; union is at least the larger set, and |a| + |b| - o.
            ok[part] = (100 * most >= percent * least[part]) & ((100 + percent) * most >= percent * (lo[p] + lo[q]))
        return ok

    def pairs(self, percent: int, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs i < j of leaves of different classes that no bound rules out, by traversing the tree against itself."""
        top = len(self.levels) - 1
        i = j = np.zeros(min(1, len(self.levels[0][1])), np.int64)
        for level in range(top - 1, -1, -1):
            n = len(self.levels[level][1])
            grid = np.arange(FANOUT)
            i2 = (i[:, None, None] * FANOUT + grid[None, :, None] + 0 * grid[None, None, :]).ravel()
            j2 = (j[:, None, None] * FANOUT + grid[None, None, :] + 0 * grid[None, :, None]).ravel()
            keep = (i2 < n) & (j2 < n) & (i2 <= j2)
            if level == 0:
                keep &= i2 < j2
                keep[keep] = classes[i2[keep]] != classes[j2[keep]]
            i, j = i2[keep], j2[keep]
            ok = self.bound(level, i, j, percent)
            i, j = i[ok], j[ok]
        return (i, j) if top else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def tree_pairs(bits: np.ndarray, sizes: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(sizes, kind="stable")
    i, j = Tree(bits[order], sizes[order]).pairs(percent, classes[order])
    return order[i], order[j]


def cell_pairs(cell: np.ndarray, bits: np.ndarray, sizes: np.ndarray, classes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """tree_pairs() of every cell: a cell that fits one node is met by that node's bound, all such cells at once."""
    order = np.lexsort((sizes, cell))
    c, n, k = cell[order], sizes[order], classes[order]
    heads = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
    lengths = np.diff(heads, append=len(c))
    flat = Tree.__new__(Tree)
    flat.levels = [(bits[order], n, n, n - np.bitwise_count(bits[order]).sum(1))]
    small = np.repeat(lengths <= NODE, lengths)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for d in range(1, min(NODE, len(c))):
        i = np.flatnonzero((c[d:] == c[:-d]) & small[d:] & (k[d:] != k[:-d]) & (100 * n[:-d] >= percent * n[d:]))
        i = i[flat.bound(0, i, i + d, percent)]
        out.append((i, i + d))
    for h, m in zip(heads[lengths > NODE], lengths[lengths > NODE], strict=True):
        i, j = tree_pairs(flat.levels[0][0][h : h + m], n[h : h + m], k[h : h + m], percent)
        out.append((i + h, j + h))
    i, j = (np.concatenate(x) for x in zip(*out, strict=True))
    return order[i], order[j]


def similar_documents(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs.

    Documents link if the Jaccard similarity of their sets of k-word shingles (words between white space, A-Z lower-cased) is at
    least percent / 100; component_id is the smallest doc_id reachable by links, itself included. No link between documents is
    lost. Null and empty texts have empty sets and link with nothing. doc_id is a key: rows that repeat one with another
    text are told apart nowhere but in n_shingles; a null doc_id links with nothing.
    """
    small_batches(docs.sparkSession)
    first = set_table(docs, k, percent, []).where("doc_id IS NOT NULL")
    counts = first.select(F.explode("prefix").alias("key")).groupBy("key").count().where(F.col("count") > COMMON)
    with tidy(docs.sparkSession):
        common = [r.key for r in counts.orderBy(F.col("count").desc(), "key").limit(COMMON_MOST).collect()]
    table = save(set_table(docs, k, percent, common), "jaccard-table")
    real = table.where("doc_id IS NOT NULL AND n_shingles > 0")
    equal = save(real.groupBy("digest").agg(F.min("doc_id").alias("rep")), "jaccard-equal")
    members = save(real.join(equal, "digest").select("doc_id", "rep", "n_shingles", F.when(F.col("doc_id") == F.col("rep"), F.col("prefix")).alias("prefix")), "jaccard-members")
    drop(equal)
    # Repeated rows go before the prefixes are laid out, where they are few.
    keys = members.where("doc_id = rep").select("rep", "n_shingles", "prefix").dropDuplicates().select("rep", "n_shingles", F.size("prefix").alias("p"), F.explode("prefix").alias("key"))
    buckets = save(keys.groupBy("key").agg(F.min("rep").alias("head"), F.count("*").alias("n")).where("n > 1"), "jaccard-buckets")
    shared = save(keys.join(buckets, "key"), "jaccard-shared")
    drop(buckets)
    # Each representative meets the head that most of its buckets have.
    votes = shared.where("rep <> head").groupBy("rep", "p", "head").agg(F.count("*").alias("n"))
    best = votes.where("4 * n >= p").groupBy("rep").agg(F.max_by("head", F.struct("n", -F.col("head"))).alias("head"))
    links = _linked(best.select(F.col("rep").alias("a"), F.col("head").alias("b")), docs, k, percent)
    classes = save(components(links, "jaccard-classes"), "jaccard-classes")
    # Buckets with several classes left.
    open_ = shared.select("key", "rep", "n_shingles").join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    open_ = save(open_, "jaccard-open")
    drop(shared)
    mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).where("lo <> hi")
    mixed = save(mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "jaccard-mixed")
    rest = open_.join(mixed, "key")
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    rest = rest.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"), "rep", "n_shingles", "component")
    rest = save(rest, "jaccard-rest")
    drop(open_, mixed)
    reps = save(rest.select(F.col("rep").alias("doc_id")).distinct(), "jaccard-rest-ids")

    @F.pandas_udf("binary")
    def signed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        only()
        for part in parts:
            yield pd.Series([b.tobytes() for b in bitmaps(shingles(part.tolist(), k))], dtype=object)
        trim()

    marks = save(docs.select("doc_id", text_or_empty().alias("text")).join(reps, "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("rep"), signed("text").alias("bits")), "jaccard-marks")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["cell", "rep"])
        bits = np.frombuffer(b"".join(part["bits"]), np.uint64).reshape(len(part), -1)
        ids, cell, sizes, classes = (part[c].to_numpy(np.int64) for c in ("rep", "cell", "n_shingles", "component"))
        i, j = cell_pairs(cell, bits, sizes, classes, percent)
        return pd.DataFrame({"a": np.maximum(ids[i], ids[j]), "b": np.minimum(ids[i], ids[j])}).drop_duplicates()

    # Many cells make a bundle, whose rows are bounded as a cell's are; a task's work isn't spent on handing over small groups.
    bundles = max(1, rest.count() // BUNDLE_ROWS)
    cells = rest.join(marks, "rep").withColumn("bundle", F.pmod(F.xxhash64("cell"), F.lit(bundles))).groupBy("bundle").applyInPandas(meet, "a long, b long")
    more = _linked(cells, docs, k, percent)
    drop(rest, reps, marks)
    joined = more.join(classes.select(F.col("id").alias("a"), F.col("component").alias("x")), "a", "left").join(classes.select(F.col("id").alias("b"), F.col("component").alias("y")), "b", "left")
    joined = joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    merged = components(joined, "jaccard-merged")
    top = save(merged.select(F.col("id").alias("component"), F.col("component").alias("top")), "jaccard-top")
    # A representative's class by two small maps, then every member's.
    found = members.where("doc_id = rep").select("rep").join(classes.select(F.col("id").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    found = save(found.join(top, "component", "left").select("rep", F.coalesce("top", "component").alias("component_id")), "jaccard-found")
    drop(links, more, classes, top)
    ours = members.select("doc_id", "rep").distinct().join(found, "rep").select("doc_id", "component_id")
    ours = save(ours.groupBy("doc_id").agg(F.min("component_id").alias("component_id")), "jaccard-ours")
    drop(members, found)
    return table.select("doc_id", "n_shingles").join(ours, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs but those that are linked to a document with a smaller doc_id, directly or through others."""
    gone = save(similar_documents(docs, k, percent).where("component_id < doc_id").select("doc_id").distinct(), "jaccard-gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


