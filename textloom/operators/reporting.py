"""Notes on comparisons, recommendations, keywords and the job list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import first_by, title_head

#: What a comparison may have to say of itself.
NOTES = ("CANDIDATE_FAILED", "JUDGE_NOT_INDEPENDENT", "CANDIDATE_INCOMPLETE", "ROUTING_MISMATCH", "SOURCE_DIFFERS", "TARGETS_DIFFER", "JUDGE_COST_SHARED", "PRICING_UNKNOWN", "LOCALE_NOT_VALIDATED", "SEGMENTS_WITHOUT_OUTPUT")


def notes(runs: DataFrame, judge: str) -> DataFrame:
    """(provider, code) for runs (provider, status, served_by, doc_key, targets, unpriced, unvalidated, missing): each code is a test on a run, or on a run against the others."""
    keys, targets = F.count_distinct("doc_key"), F.count_distinct("targets")
    every = runs.agg(keys.alias("keys"), targets.alias("target_sets"))
    rows = runs.crossJoin(F.broadcast(every))  # one row
    tests = {
        "CANDIDATE_FAILED": F.col("status") == "FAILED",
        "JUDGE_NOT_INDEPENDENT": F.col("provider") == judge,
        "CANDIDATE_INCOMPLETE": F.col("status").isin("PARTIAL", "HALTED_COST_CEILING"),
        "ROUTING_MISMATCH": F.col("served_by") != F.col("provider"),
        "SOURCE_DIFFERS": F.col("keys") > 1,
        "TARGETS_DIFFER": F.col("target_sets") > 1,
        "PRICING_UNKNOWN": F.col("unpriced") > 0,
        "LOCALE_NOT_VALIDATED": F.col("unvalidated") > 0,
        "SEGMENTS_WITHOUT_OUTPUT": F.col("missing") > 0,
    }
    return rows.select("provider", F.explode(F.array_compact(F.array(*(F.when(t, c) for c, t in tests.items())))).alias("code"))


#: Documents of neighbouring numbers that are counted together when rows are numbered.
BLOCK = 10_000


def numbered(rows: DataFrame, group: str, doc: str, order: str) -> DataFrame:
    """rows with n: 1, 2, … within each group, documents in order (a number), a document's rows by order.

    Positions are sums of counts: of the blocks before, of the block's documents before, then the place in the document. No window holds
    a group's rows, only its blocks, a block's documents or a document's rows.
    """
    rows = rows.withColumn("__block", F.floor(F.col(doc) / BLOCK))
    docs = rows.groupBy(group, "__block", doc).agg(F.count("*").alias("__c"))
    blocks = docs.groupBy(group, "__block").agg(F.sum("__c").alias("__c"))
    before = lambda *keys, by: F.coalesce(F.sum("__c").over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(group, "__block", before(group, by="__block").alias("__far"))
    docs = docs.select(group, "__block", doc, before(group, "__block", by=doc).alias("__near")).join(blocks, [group, "__block"])
    place = F.row_number().over(Window.partitionBy(group, "__block", doc).orderBy(order))
    rows = rows.withColumn("__at", place).join(docs, [group, "__block", doc])
    return rows.withColumn("n", F.col("__far") + F.col("__near") + F.col("__at")).drop("__block", "__far", "__near", "__at")


def recommendations(*sources: DataFrame) -> DataFrame:
    """(target, text) of all sources, the first of each text that differs in case and outer space only."""
    out = None
    for n, s in enumerate(sources):
        s = s.select("target", "text", F.lit(n).alias("n"))
        out = s if out is None else out.unionByName(s)
    return first_by(out.withColumn("k", F.lower(F.trim("text"))), ["target", "k"], [F.col("n"), F.col("text")]).drop("k", "n")


def keyword(provided: Column, meta: Column, h1: Column, title: Column) -> tuple[Column, Column]:
    """(keyword, origin): what the caller gave, the page's first keyword, its heading, its title's head."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    first = F.get(F.filter(F.transform(F.split(meta, "[,;]"), lambda k: F.trim(k)), lambda k: k != ""), F.lit(0))
    head = some(title_head(title))
    origin = F.when(some(provided).isNotNull(), "provided").when(first.isNotNull(), "meta_keywords").when(some(h1).isNotNull(), "derived_h1").when(head.isNotNull(), "derived_title")
    return F.coalesce(some(provided), first, some(h1), head), origin


def final_locale(known: Column, detected: Column) -> Column:
    """A known region is never traded for none."""
    keeps = (F.split_part(known, F.lit("-"), F.lit(1)) == F.split_part(detected, F.lit("-"), F.lit(1))) & ~known.endswith("*") & detected.endswith("*")
    return F.when(keeps, known).otherwise(detected)


def job_summary(jobs: DataFrame) -> DataFrame:
    """jobs (job_id, locale, verdict, warning) to one row a job."""
    return jobs.groupBy("job_id").agg(F.countDistinct("locale").alias("locales"), F.count_if(F.col("verdict") == "FAIL").alias("failed"), F.array_join(F.array_sort(F.collect_set("warning")), "; ").alias("warnings"))


def rule_examples(tests: DataFrame) -> DataFrame:
    """tests (rule, n, target, expect) to a wrong and a right example of each rule, the first of each."""
    ex = lambda e: F.min_by(F.when(F.col("expect") == e, F.col("target")), F.when(F.col("expect") == e, F.col("n")))
    return tests.groupBy("rule").agg(ex("fail").alias("wrong"), ex("pass").alias("right"))


def host_allowed(host: Column, allowed: tuple[str, ...]) -> Column:
    """Whether a Host header names an allowed host, its port apart."""
    return F.lower(F.regexp_replace(host, r":[0-9]+$", "")).isin(*(a.lower() for a in allowed))
