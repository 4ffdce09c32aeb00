"""Near-duplicate vectors: spherical k-means cells, blocked cosine products within cells, one representative a group.

Equal vectors (in direction and length) collapse first. Centroids are fitted on a bounded sample and every distinct vector is
assigned to its nearest cell, its home, and visits the PROBES - 1 next ones. In each cell homes meet homes and visitors meet
homes, block by block; a pair that both of its homes would see is counted in one of them. Blocks add up numbers of links and
hand out only the links that a spanning forest needs, so that a group of n near copies gives n - 1 rows a block, not n * n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, drop, save

THRESHOLD = 0.95
#: Rows of the sample on which centroids are fitted, most cells, cells that a vector is compared in, and rows of a block.
SAMPLE, CELLS, PROBES, BLOCK = 20_000, 1024, 4, 2048


def fit_centroids(X: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means of unit vectors X: centroids of unit length; an empty cell takes the vector that fits its own worst."""
    r = np.random.default_rng(seed)
    C = X[np.sort(r.choice(len(X), min(k, len(X)), replace=False))].copy()
    for _ in range(rounds):
        near, sim = _nearest(X, C, 1)
        near, sim = near[:, 0], sim[:, 0]
        new = np.zeros_like(C)
        np.add.at(new, near, X)
        norm = np.linalg.norm(new, axis=1)
        empty = np.flatnonzero(norm < 1e-9)
        if len(empty):
            new[empty] = X[np.argsort(sim, kind="stable")[: len(empty)]]
            norm = np.linalg.norm(new, axis=1)
        C = new / np.maximum(norm, 1e-12)[:, None]
    return C


def _nearest(X: np.ndarray, C: np.ndarray, p: int) -> tuple[np.ndarray, np.ndarray]:
    """The p nearest centroids of each row, nearest first, and their cosines."""
    p = min(p, len(C))
    out, sims = np.empty((len(X), p), np.int64), np.empty((len(X), p))
    for i in range(0, len(X), 4096):
        S = X[i : i + 4096] @ C.T
        top = np.argpartition(-S, p - 1, axis=1)[:, :p]
        order = np.argsort(-np.take_along_axis(S, top, 1), axis=1, kind="stable")
        out[i : i + 4096] = np.take_along_axis(top, order, 1)
        sims[i : i + 4096] = np.take_along_axis(S, out[i : i + 4096], 1)
    return out, sims


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """(a, b) links of a spanning forest of the links given, each from a node to the smallest node of its tree."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.get(x, x) != x:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    return [(x, t) for x in up if (t := top(x)) != x]


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, cells: int = CELLS, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding).

    Two vectors link if the cosine of their components in double precision is at least threshold and one of them has the other's home
    cell among its probes; none links below it. n_links counts rows, equal vectors too. Vectors that are null, empty, zero or hold
    null or non-finite components link with nothing, nor do vectors of different lengths or a null vec_id. component_id is the
    smallest vec_id reachable by links; kept marks the one row of a group with that id. Rows that repeat a vec_id with the same vector
    are links of each other; of rows that repeat it with other vectors the vector of the least hash counts for all. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("e").isNotNull() & (F.size("e") > 0) & F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("e", lambda x: x != 0)
    real = rows.where(sound & F.col("vec_id").isNotNull())
    # Equal vectors: one stands for all. Its squares must not overflow, so the largest component becomes 1 first.
    big = F.array_max(F.transform("e", F.abs))
    real = real.withColumn("big", big).withColumn("e", F.expr("transform(e, x -> x / big)")).drop("big")
    real = save(real.withColumn("d", F.struct(F.xxhash64("e"), F.xxhash64(F.lit(1), "e"), F.size("e"))), "embed-real")
    unclear = save(real.groupBy("vec_id").agg(F.min("d").alias("own"), F.max("d").alias("most")).where("own <> most").select("vec_id", "own"), "embed-unclear")
    ids = real.select("vec_id", "d").join(unclear, "vec_id", "left").where("own IS NULL OR d = own").drop("own")
    equal = save(ids.groupBy("d").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "embed-equal")
    mapping = save(ids.distinct().join(equal, "d").select("vec_id", "rep", "copies"), "embed-members")
    reps = real.join(equal.withColumnRenamed("rep", "vec_id"), ["vec_id", "d"]).select(F.col("vec_id").alias("rep"), "copies", "e")
    reps = save(reps.groupBy("rep").agg(F.min("copies").alias("copies"), F.min("e").alias("e")), "embed-reps")
    drop(real, unclear, equal)
    total = reps.count()
    if not total:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    centroids: dict[int, np.ndarray] = {}
    taken = reps.select("rep", "e").orderBy(F.xxhash64("rep"), "rep").limit(sample).collect()
    by_dim: dict[int, list] = {}
    for r in taken:
        by_dim.setdefault(len(r.e), []).append(r.e)
    for dim, own in by_dim.items():
        X = np.array(own)
        X /= np.linalg.norm(X, axis=1)[:, None]
        k = int(min(cells, max(1, round(total**0.5)), max(1, len(X) // 8)))
        centroids[dim] = fit_centroids(X, k)
    held = spark.sparkContext.broadcast(centroids)

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, own in part.groupby(part["e"].map(len)):
                X = np.stack(own["e"].to_numpy())
                X = X / np.linalg.norm(X, axis=1)[:, None]
                C = held.value.get(dim)
                near = _nearest(X, C, probes)[0] if C is not None else np.zeros((len(X), 1), np.int64)
                yield pd.DataFrame({"rep": own["rep"], "copies": own["copies"], "dim": dim, "e": [x.tobytes() for x in X], "probes": near.tolist()})

    placed = save(reps.mapInPandas(assign, "rep long, copies long, dim int, e binary, probes array<long>"), "embed-cells")
    drop(reps)
    at_home = placed.groupBy("dim", F.col("probes")[0].alias("cell")).count()
    # A cell's homes are dealt to blocks, its visitors to parts; block b meets part p in a group of its own, so that no task
    # holds a whole cell. Part o of the homes is block o.
    blocks = save(at_home.select("dim", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "embed-blocks")
    seen = placed.select("*", F.posexplode("probes").alias("place", "cell")).join(F.broadcast(blocks), ["dim", "cell"])  # at most CELLS rows for each length
    seen = seen.withColumn("home", F.col("place") == 0).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    asks = F.transform(every, lambda b: F.struct(b.alias("block"), F.col("own").alias("part"), (F.col("home") & (b == F.col("own"))).alias("base"), F.lit(True).alias("query")))
    answers = F.transform(F.filter(every, lambda p: p != F.col("own")), lambda p: F.struct(F.col("own").alias("block"), p.alias("part"), F.lit(True).alias("base"), F.lit(False).alias("query")))
    seen = seen.withColumn("g", F.explode(F.when(F.col("home"), F.concat(asks, answers)).otherwise(asks)))
    seen = seen.select("dim", "cell", "g.*", "rep", "copies", "e", "probes", "home", "own")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        dim, cell = int(part["dim"].iloc[0]), int(part["cell"].iloc[0])
        X = np.frombuffer(b"".join(part["e"]), np.float64).reshape(-1, dim)
        ids, copies = part["rep"].to_numpy(np.int64), part["copies"].to_numpy(np.int64)
        home, own = part["home"].to_numpy(bool), part["own"].to_numpy(np.int64)
        base = np.flatnonzero(part["base"].to_numpy(bool))
        asking = np.flatnonzero(part["query"].to_numpy(bool))
        block = int(part["block"].iloc[0])
        probes = part["probes"].tolist()
        sees = {int(j): set(map(int, probes[j])) for j in base}
        links, la, lb = np.zeros(len(part), np.int64), [], []
        for i in range(0, len(asking) if len(base) else 0, BLOCK):
            q = asking[i : i + BLOCK]
            S = X[q] @ X[base].T
            x, y = np.nonzero(S >= threshold - 1e-12)
            x, y = q[x], base[y]
            # In a block of homes each pair once; with another block's homes if that block is the later one.
            keep = np.where(home[x], np.where(own[x] == block, x < y, own[x] < block), True)
            for n in np.flatnonzero(keep & ~home[x]):
                # A visitor whose own home is among this row's probes meets it there as well: the smaller cell counts.
                there = int(probes[x[n]][0])
                if there in sees[int(y[n])] and there < cell:
                    keep[n] = False
            x, y = x[keep], y[keep]
            exact = (X[x] * X[y]).sum(1) >= threshold
            x, y = x[exact], y[exact]
            np.add.at(links, x, copies[y])
            np.add.at(links, y, copies[x])
            la.append(ids[x])
            lb.append(ids[y])
        forest = _forest(np.concatenate(la), np.concatenate(lb)) if la else []
        some = np.flatnonzero(links)
        return pd.DataFrame({"a": [*ids[some].tolist(), *(a for a, _ in forest)], "b": pd.array([*[pd.NA] * len(some), *(b for _, b in forest)], dtype="Int64"), "n": [*links[some].tolist(), *[0] * len(forest)]})

    found = save(seen.groupBy("dim", "cell", "block", "part").applyInPandas(meet, "a long, b long, n long"), "embed-found")
    drop(placed, blocks)
    groups = save(components(found.where("b IS NOT NULL").select("a", "b"), "embed-groups"), "embed-groups")
    degrees = save(found.where("b IS NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n")), "embed-degrees")
    answer = mapping.join(degrees, "rep", "left").join(groups.select(F.col("id").alias("rep"), "component"), "rep", "left")
    answer = answer.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = rows.select("vec_id").join(answer, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

