"""The plans themselves: what must not shuffle doesn't, filters and columns reach the scan, Python stays out where it isn't needed."""

import re

import pytest

from textloom.plans.queries import ORACLE_SQL, QUERIES

NARROW = (
    "text_hash word_count char_length collapse_space plain_text tag_signature tag_diff slugify match_spans redact md_escape text_blocks text_segments segment_ids title_head source_slug classify_pages locale_tag source_locale "
    "route_segments translatable letters_words emails lex_eszett lint autofix_eszett conditional segment_score verdicts parse_number format_number rule_scope glossary_hits cidr_block extract_entities html_blocks"
).split()
NATIVE = [n for n in QUERIES if n not in "currency_amounts units extract_entities entity_counts html_blocks ingest_pages detect_lang document_language market_claims overlap_resolve format_offences normalize_formats model_answers render_html render_markdown plain_spans nesting markdown_segments run_pipeline run_results compare_runs export_pages entity_formats integrity_findings back_translation judge_scores".split()]


def plan(spark, sf, name):
    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NARROW)
def test_no_shuffle(spark, sf, name):
    assert not re.search(r"Exchange|Sort\b", plan(spark, sf, name))


@pytest.mark.parametrize("name", NATIVE)
def test_no_python(spark, sf, name):
    if name in ("list_locales",):
        return
    p = plan(spark, sf, name)
    assert not re.search("Python|Pandas|CartesianProduct", p)
    assert "BroadcastNestedLoopJoin" not in p or name in ("comparison_notes",)


def test_columns_and_filters_reach_the_scan(spark, sf):
    p = plan(spark, sf, "session_user")
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in p and "o_totalprice" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan(spark, sf, "segment_score")
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan(spark, sf, "latest_orders")


def test_partial_aggregates_come_first(spark, sf):
    for name in ("usage_totals", "locale_score", "lang_summary", "compare_scores", "reason_counts"):
        assert "partial_" in plan(spark, sf, name)


def test_top_k_is_kept_small_in_each_task(spark, sf):
    assert "TakeOrderedAndProject" in plan(spark, sf, "top_findings") and "TakeOrderedAndProject" in plan(spark, sf, "latest_orders")


def test_merged_spans_of_odd_rows(spark, tmp_path):
    """Fractions, nulls and equal spans as the query's SQL has them; on one thread, for its two sorts may order equal spans differently else."""
    import duckdb
    from oracle import compare

    odd = [(1, 1, 2.5), (1, 1, 3.5), (1, 2, 14.6), (1, 2, None), (1, None, 3.0), (1, 3, 0.0), (1, 3, 0.0), (2, 7, 2.0), (2, 7, 2.0), (2, 1, 2.0), (None, 1, 44.5), (None, 1, 3.0), (3, 2, None), (3, 1, 7.5)]
    df = spark.createDataFrame(odd, "l_orderkey long, l_linenumber int, l_quantity double")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert compare(spark, con, QUERIES["merge_spans"], ORACLE_SQL["merge_spans"], str(tmp_path)) is None
    p = QUERIES["merge_spans"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Window \[", p)) == 2 and len(re.findall(r"Sort \[", p)) == 1
