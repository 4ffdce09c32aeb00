"""The same stateless transforms over streams, and windows over the call log. Additions to what the batch plans do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules, segments


def read_documents(spark: SparkSession, path: str, schema: str, files: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def lint_stream(docs: DataFrame, locale: str) -> DataFrame:
    """Documents as they come to segments with findings: no state, so no watermark."""
    seg = segments.line_segments(docs)
    rows = seg.withColumns({"source_text": F.col("text"), "target_text": F.col("text"), "source_lang": F.lit(locale[:2]), "operation": F.lit("ADAPT_ONLY")})
    return rules.lint(rows, locale).where(F.size("findings") > 0).select("doc_id", "segment_id", F.explode("findings").alias("f")).select("doc_id", "segment_id", "f.*")


def spend_windows(calls: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Cost and calls by provider and window of event time; what comes later than the watermark is left out and its state is dropped."""
    return calls.withWatermark("ts", late).groupBy(F.window("ts", width), "provider").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
