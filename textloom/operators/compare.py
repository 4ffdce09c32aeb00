"""Runs side by side: costs by owner and stage, scores, missing outputs, the best provider. All are map-side combinable roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import text as T


def cost_role(stage: Column) -> Column:
    return F.when((stage == "all") | stage.isin(*L.CANDIDATE_STAGES), "candidate").when(stage.isin(*L.JUDGE_STAGES), "judge").otherwise("pipeline")


def usage(calls: DataFrame, keys: list[str]) -> DataFrame:
    """calls (stage, cost or null, latency_ms, input_tokens, output_tokens) summed; a call without a price counts as unpriced."""
    return calls.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        T.round_half_up(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost_usd"),
        T.round_half_up(F.sum("latency_ms"), 3).alias("latency_ms"),
        F.count_if(F.col("cost").isNull()).alias("unpriced"),
    )


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Candidate stages by (provider, stage) and, as stage all, by provider: grouping sets over one pass."""
    rows = calls.where(cost_role(F.col("stage")) == "candidate")
    g = rows.groupingSets([[F.col("provider"), F.col("stage")], [F.col("provider")]], F.col("provider"), F.col("stage"))
    out = g.agg(F.count("*").alias("calls"), T.round_half_up(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("cost_usd"))
    return out.withColumn("stage", F.coalesce("stage", F.lit("all")))


#: Fixed value: scores and costs this near are equal.
SAME = 1e-9


def best_provider(scores: DataFrame) -> DataFrame:
    """scores (locale, provider, score, cost, n) to the best provider of each locale: score (equal within SAME), then cost, then order n; and what decided."""
    w, same = Window.partitionBy("locale"), Window.partitionBy("locale").orderBy(F.asc_nulls_last("cost"), "n")
    rows = scores.withColumn("top", F.max("score").over(w)).where(F.col("score") >= F.col("top") - SAME)
    rows = rows.withColumn("ties", F.count("*").over(w)).withColumn("rn", F.row_number().over(same)).withColumn("low", F.min("cost").over(w))
    rows = rows.withColumn("cheap", F.count_if(F.col("cost") <= F.col("low") + SAME).over(w)).where("rn = 1")
    decided = F.when(F.col("ties") == 1, "score").when(F.col("cheap") == 1, "cost").otherwise("order")
    return rows.select("locale", "provider", "score", "cost", decided.alias("decided_by"), (F.col("ties") - 1).alias("tied"))


def segment_diff(outputs: DataFrame, providers: list[str]) -> DataFrame:
    """outputs (locale, segment_id, provider, text) with a column a provider and whether all that there is is the same."""
    wide = outputs.groupBy("locale", "segment_id").pivot("provider", providers).agg(F.first("text", ignorenulls=True))
    there = F.array_compact(F.array(*(F.col(f"`{p}`") for p in providers)))
    return wide.withColumn("identical", F.size(F.array_distinct(there)) <= 1)


def under_ceiling(calls: DataFrame, keys: list[str], order: list[str], ceiling: float = L.CEILING_USD) -> DataFrame:
    """calls with spent, the cost before each, and halted, whether that had reached the ceiling."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(F.coalesce("cost", F.lit(0.0))).over(w), F.lit(0.0))
    return calls.withColumn("spent", T.round_half_up(spent, 6)).withColumn("halted", F.col("spent") >= ceiling)


def merge_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping spans (keys…, start, end) of a key merged; those that only touch stay apart; nulls come last.

    Both windows are of one order and so of one sort: equal spans stand alike in both, and which of them comes first makes no difference.
    """
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("end"))
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.when(before.isNull() | (F.col("start") >= before), 1).otherwise(0))
    rows = rows.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def batches(rows: DataFrame, keys: list[str], order: str, size: str, most: int = L.BATCH_SEGMENTS, most_size: int = L.BATCH_CHARS) -> DataFrame:
    """Greedy batches in order: a new one when the next item doesn't fit by number or size. One row an item: keys…, order, batch.

    The state of a fold over each key's ordered array is the batch number, its items and its size; a key's items are bounded by
    a document's segments.
    """
    g = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(size).cast("long").alias("s")))).alias("xs"))
    zero = F.struct(F.lit(1).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("c"), F.array().cast("array<bigint>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] > 0) & ((a["n"] >= most) | (a["c"] + x["s"] > most_size))
        b = F.when(full, a["b"] + 1).otherwise(a["b"])
        return F.struct(b.alias("b"), F.when(full, F.lit(1)).otherwise(a["n"] + 1).cast("long").alias("n"), F.when(full, x["s"]).otherwise(a["c"] + x["s"]).alias("c"), F.concat(a["out"], F.array(b)).alias("out"))

    folded = g.select(*keys, "xs", F.aggregate("xs", zero, step, lambda a: a["out"]).alias("bs"))
    return folded.select(*keys, F.explode(F.arrays_zip("xs", "bs")).alias("z")).select(*keys, F.col("z.xs.o").alias(order), F.col("z.bs").alias("batch"))


def bursts(rows: DataFrame, keys: list[str], time: str, failed: Column, most: int = 8, idle_s: int = 900) -> DataFrame:
    """Runs of failures of a key that no success and no pause of idle_s seconds breaks, if they reach most."""
    w = Window.partitionBy(*keys).orderBy(time, "event_id")
    rows = rows.withColumn("fail", failed).withColumn("gap", F.unix_micros(F.col(time).cast("timestamp")) - F.lag(F.unix_micros(F.col(time).cast("timestamp"))).over(w))
    rows = rows.withColumn("cut", F.when(~F.col("fail") | F.col("gap").isNull() | (F.col("gap") > idle_s * 1_000_000), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = rows.where("fail").groupBy(*keys, "run").agg(F.count("*").alias("failures"), F.min(time).alias("since"))
    return g.where(F.col("failures") >= most).drop("run")
