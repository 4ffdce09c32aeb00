"""Costs, comparisons, order-dependent logic and joins over the tables that stand in for call logs, jobs and users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import text as T
from ..operators import compare, entities, routing, rules
from ..operators.segments import first_by
from .registry import query, table
from .segment_queries import LINES, line_rows

#: events as a call log: a provider, stage, cost (null without a price), latency and tokens of each.
_STAGE = "CASE CAST(user_id % 6 AS INT) WHEN 0 THEN 'language_detection' WHEN 1 THEN 'translation' WHEN 2 THEN 'localization' WHEN 3 THEN 'validation' WHEN 4 THEN 'backtranslation' ELSE 'repair' END"
_COLS = f"event_id, ts, user_id, event_type AS provider, {_STAGE} AS stage, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 1000.0{{d}} END AS cost, value * 3.0{{d}} AS latency_ms, event_id % 500 AS input_tokens, event_id % 300 AS output_tokens"
_CALLS = f"WITH calls AS (SELECT {_COLS.format(d='::DOUBLE')} FROM events)"
_COST = "floor(sum(coalesce(cost, 0.0::DOUBLE)) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE"
_LATENCY = "floor(sum(latency_ms) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE"
_SUMS = f"count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, {_COST} AS cost_usd, {_LATENCY} AS latency_ms, count(*) FILTER (cost IS NULL) AS unpriced"


def calls(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr(*_COLS.format(d="D").split(", ")[:3], "event_type AS provider", f"{_STAGE} AS stage", "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value / 1000.0D END AS cost", "value * 3.0D AS latency_ms", "event_id % 500 AS input_tokens", "event_id % 300 AS output_tokens")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 500 * 3.0::DOUBLE + event_id % 40 * coalesce(CASE WHEN event_id % 2 = 0 THEN 0.3::DOUBLE END, 3.0::DOUBLE) + event_id % 300 * 15.0::DOUBLE) / 1000000.0::DOUBLE END AS cost FROM events")
def call_cost(spark, sf_dir):
    e = F.col("event_id")
    cost = T.call_cost(e % 500, e % 40, e % 300, F.lit(3.0), F.when(e % 2 == 0, F.lit(0.3)), F.lit(15.0))
    return table(spark, sf_dir, "events").select("event_id", F.when(e % 9 == 0, None).otherwise(cost).alias("cost"))


@query(_CALLS + f" SELECT provider, {_SUMS} FROM calls GROUP BY provider")
def usage_totals(spark, sf_dir):
    return compare.usage(calls(spark, sf_dir), ["provider"])


@query(_CALLS + f" SELECT user_id, {_SUMS} FROM calls GROUP BY user_id")
def run_totals(spark, sf_dir):
    return compare.usage(calls(spark, sf_dir), ["user_id"])


_ROLE = "CASE WHEN stage IN ('translation','localization','repair') THEN 'candidate' WHEN stage IN ('validation','backtranslation') THEN 'judge' ELSE 'pipeline' END"


@query(_CALLS + f" SELECT event_id, {_ROLE} AS role FROM calls")
def cost_role(spark, sf_dir):
    return calls(spark, sf_dir).select("event_id", compare.cost_role(F.col("stage")).alias("role"))


@query(_CALLS + f", o AS (SELECT *, CASE {_ROLE} WHEN 'judge' THEN 'the judge' ELSE provider END AS owner FROM calls) SELECT owner, stage, {_SUMS} FROM o GROUP BY owner, stage")
def cost_buckets(spark, sf_dir):
    owner = F.when(compare.cost_role(F.col("stage")) == "judge", "the judge").otherwise(F.col("provider"))
    return compare.usage(calls(spark, sf_dir).withColumn("owner", owner), ["owner", "stage"])


@query(_CALLS + f" SELECT provider, coalesce(stage, 'all') AS stage, count(*) AS calls, {_COST} AS cost_usd FROM calls WHERE {_ROLE} = 'candidate' GROUP BY GROUPING SETS ((provider, stage), (provider))")
def cost_rollup(spark, sf_dir):
    return compare.cost_rollup(calls(spark, sf_dir))


@query(_CALLS + f" SELECT provider, count(*) FILTER (cost IS NOT NULL) AS priced, floor(sum(latency_ms) / count(*) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS avg_ms FROM calls WHERE {_ROLE} = 'judge' GROUP BY provider")
def cost_totals(spark, sf_dir):
    rows = calls(spark, sf_dir).where(compare.cost_role(F.col("stage")) == "judge").groupBy("provider")
    return rows.agg(F.count("cost").alias("priced"), T.round_half_up(F.try_divide(F.sum("latency_ms"), F.count("*")), 2).alias("avg_ms"))


@query(_CALLS + " SELECT user_id, stage, arg_max(provider, event_id) AS provider FROM calls WHERE cost IS NOT NULL GROUP BY user_id, stage")
def stage_binding(spark, sf_dir):
    """The provider of each stage's last successful call."""
    return calls(spark, sf_dir).where("cost IS NOT NULL").groupBy("user_id", "stage").agg(F.max_by("provider", "event_id").alias("provider"))


@query("SELECT event_type AS code, CASE WHEN value > 50 THEN 'error' ELSE 'warning' END AS level, count(*) AS n FROM events WHERE value > 20 GROUP BY ALL")
def log_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 20").select(F.col("event_type").alias("code"), F.when(F.col("value") > 50, "error").otherwise("warning").alias("level"))
    return rows.groupBy("code", "level").agg(F.count("*").alias("n"))


@query(_CALLS + f" SELECT user_id, ts::DATE AS day, {_COST} AS spent FROM calls GROUP BY user_id, ts::DATE")
def daily_spend(spark, sf_dir):
    return calls(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(T.round_half_up(F.sum(F.coalesce("cost", F.lit(0.0))), 6).alias("spent"))


@query(_CALLS + """, s AS (SELECT event_id, user_id, floor(coalesce(sum(coalesce(cost, 0.0::DOUBLE)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS spent FROM calls)
SELECT event_id, spent, spent >= 0.5 AS halted FROM s""")
def cost_ceiling(spark, sf_dir):
    """What a user had spent before each call, and whether that halts it."""
    return compare.under_ceiling(calls(spark, sf_dir), ["user_id"], ["ts", "event_id"], 0.5).select("event_id", "spent", "halted")


@query("""WITH t AS (SELECT *, event_type = 'error' AS fail, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
c AS (SELECT *, CASE WHEN NOT fail OR gap IS NULL OR gap > 86400000000 THEN 1 ELSE 0 END AS cut FROM t), r AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM c)
SELECT user_id, count(*) AS failures, min(ts) AS since FROM r WHERE fail GROUP BY user_id, run HAVING count(*) >= 2""")
def error_bursts(spark, sf_dir):
    return compare.bursts(table(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "error", 2, 86_400)


#: labels and documents as judged outputs: providers are sources, a judge's scores come from the labels.
_JUDGED = "WITH j AS (SELECT d.source AS provider, d.lang AS locale, l.quality, l.toxic, d.doc_id, length(d.text) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"


def _judged(spark, sf_dir):
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.select("doc_id", F.col("source").alias("provider"), F.col("lang").alias("locale"), F.length("text").cast("long").alias("n")).join(la.select("doc_id", "quality", "toxic"), "doc_id", "left")


@query(_JUDGED + " SELECT provider, floor(avg(quality * 100.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS accuracy, floor(avg(100.0::DOUBLE - toxic * 100.0::DOUBLE) * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS fluency, count(quality) AS judged FROM j GROUP BY provider")
def judge_avg(spark, sf_dir):
    """Mean scores over what was judged; null where nothing was."""
    m = lambda c: T.round_half_up(F.avg(c), 1)
    return _judged(spark, sf_dir).groupBy("provider").agg(m(F.col("quality") * F.lit(100.0)).alias("accuracy"), m(F.lit(100.0) - F.col("toxic") * F.lit(100.0)).alias("fluency"), F.count("quality").alias("judged"))


_SCORES = _JUDGED + """, s AS (SELECT provider, locale, count(*) FILTER (quality = 0) AS minor, count(*) FILTER (toxic = 1) AS critical, sum(n)::BIGINT AS words, count(*) AS segments FROM j GROUP BY provider, locale),
p AS (SELECT *, floor((minor + critical * 25) * 100.0::DOUBLE / greatest(words, 100) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS penalty FROM s),
q AS (SELECT *, floor(greatest(0.0::DOUBLE, 100.0::DOUBLE - penalty) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM p)"""


def _scores(spark, sf_dir):
    from ..operators import scoring

    rows = _judged(spark, sf_dir).groupBy("provider", "locale").agg(F.count_if(F.col("quality") == 0).alias("minor"), F.count_if(F.col("toxic") == 1).alias("critical"), F.sum("n").alias("words"), F.count("*").alias("segments"))
    p = scoring.penalty(F.col("minor") + F.col("critical") * 25, F.col("words"))
    return rows.withColumn("penalty", p).withColumn("score", scoring.score(p))


@query(_SCORES + " SELECT provider, locale, minor, critical, penalty, score FROM q")
def compare_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("provider", "locale", "minor", "critical", "penalty", "score")


_BEST = _SCORES + """, c AS (SELECT *, CASE WHEN provider LIKE '%3' THEN NULL ELSE segments::DOUBLE END AS cost, substring(provider, 4)::BIGINT AS n FROM q),
t AS (SELECT *, max(score) OVER (PARTITION BY locale) AS top FROM c), u AS (SELECT *, count(*) OVER (PARTITION BY locale) AS ties, min(cost) OVER (PARTITION BY locale) AS low, row_number() OVER (PARTITION BY locale ORDER BY cost ASC NULLS LAST, n) AS rn FROM t WHERE score = top),
b AS (SELECT *, count(*) FILTER (cost = low) OVER (PARTITION BY locale) AS cheap FROM u)"""


def _best(spark, sf_dir):
    rows = _scores(spark, sf_dir).withColumn("cost", F.when(F.col("provider").like("%3"), None).otherwise(F.col("segments").cast("double"))).withColumn("n", F.substring("provider", 4, 9).cast("long"))
    return compare.best_provider(rows)


@query(_BEST + " SELECT locale, provider, score, cost, CASE WHEN ties = 1 THEN 'score' WHEN cheap = 1 THEN 'cost' ELSE 'order' END AS decided_by, ties - 1 AS tied FROM b WHERE rn = 1")
def best_provider(spark, sf_dir):
    return _best(spark, sf_dir)


@query(_BEST + ", m AS (SELECT provider, locale, count(*) FILTER (quality IS NULL) AS missing FROM j GROUP BY ALL) SELECT b.locale, b.provider, m.missing FROM b JOIN m ON b.locale = m.locale AND b.provider = m.provider WHERE rn = 1")
def best_with_caution(spark, sf_dir):
    """The best provider with the number of its segments that weren't judged."""
    m = _judged(spark, sf_dir).groupBy("provider", "locale").agg(F.count_if(F.col("quality").isNull()).alias("missing"))
    return _best(spark, sf_dir).select("locale", "provider").join(m, ["locale", "provider"]).select("locale", "provider", "missing")


@query(_JUDGED + ", g AS (SELECT DISTINCT provider FROM j), h AS (SELECT DISTINCT locale FROM j) SELECT g.provider, h.locale, count(j.doc_id) FILTER (j.quality IS NULL) AS missing, count(j.doc_id) AS total FROM g CROSS JOIN h LEFT JOIN j ON j.provider = g.provider AND j.locale = h.locale GROUP BY ALL")
def missing_outputs(spark, sf_dir):
    """Every provider with every locale, zero counts too: locales are few and fixed, so they are a pivot turned back, not a join."""
    rows = _judged(spark, sf_dir)
    langs = ["en", "fr", "de", "es"]
    g = rows.groupBy("provider").agg(*(x for c in langs for x in (F.count_if((F.col("locale") == c) & F.col("quality").isNull()).alias(f"m_{c}"), F.count_if(F.col("locale") == c).alias(f"t_{c}"))))
    return g.select("provider", F.explode(F.array(*(F.struct(F.lit(c).alias("locale"), F.col(f"m_{c}").alias("missing"), F.col(f"t_{c}").alias("total")) for c in langs))).alias("x")).select("provider", "x.*")


#: conversations as outputs of three providers for segments: the role made it.
_OUT = "WITH o AS (SELECT conv_id, turn // 3 AS seg, role AS provider, min(md5(text)) AS text FROM conversations GROUP BY ALL)"
_ROLES = ["user", "assistant", "system"]


def _outputs(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("locale"), F.floor(F.col("turn") / 3).alias("segment_id"), F.col("role").alias("provider")).agg(F.min(F.md5("text")).alias("text"))


@query(_OUT + " SELECT conv_id, seg, max(text) FILTER (provider = 'user') AS \"user\", max(text) FILTER (provider = 'assistant') AS assistant, max(text) FILTER (provider = 'system') AS system, count(DISTINCT text) <= 1 AS identical FROM o GROUP BY conv_id, seg")
def segment_diff(spark, sf_dir):
    return compare.segment_diff(_outputs(spark, sf_dir), _ROLES).withColumnsRenamed({"locale": "conv_id", "segment_id": "seg"})


@query(_OUT + " SELECT conv_id, seg, coalesce(max(text) FILTER (provider = 'user'), max(text) FILTER (provider = 'assistant'), max(text) FILTER (provider = 'system')) AS baseline FROM o GROUP BY conv_id, seg")
def diff_baseline(spark, sf_dir):
    wide = compare.segment_diff(_outputs(spark, sf_dir), _ROLES)
    return wide.select(F.col("locale").alias("conv_id"), F.col("segment_id").alias("seg"), F.coalesce(*_ROLES).alias("baseline"))


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(DISTINCT role) = (SELECT count(DISTINCT role) FROM conversations)")
def common_targets(spark, sf_dir):
    """What every run has: an intersection by counting."""
    c = table(spark, sf_dir, "conversations")
    every = c.agg(F.countDistinct("role").alias("all"))
    return c.groupBy("conv_id").agg(F.countDistinct("role").alias("n")).join(F.broadcast(every), F.col("n") == F.col("all"), "left_semi").select("conv_id")


@query("SELECT turn, count(*) FILTER (role = 'user') AS \"user\", count(*) FILTER (role = 'assistant') AS assistant, count(*) FILTER (role = 'system') AS system FROM conversations GROUP BY turn")
def segments_pivot(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("turn").pivot("role", _ROLES).count().fillna(0, _ROLES)


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def session_user(spark, sf_dir):
    """Live sessions with their users: the date reaches the scan."""
    o = table(spark, sf_dir, "orders").where("o_orderdate >= TIMESTAMP '1998-01-01'")
    return o.join(table(spark, sf_dir, "customer"), o.o_custkey == F.col("c_custkey")).select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS jobs, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS done FROM customer")
def user_jobs(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("jobs"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("jobs", F.lit(0).cast("long")).alias("jobs"), F.coalesce("done", F.lit(0).cast("long")).alias("done"))


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20")
def latest_orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(20).select("o_orderkey", "o_orderdate")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def unrecorded_repairs(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND coalesce(b.l_returnflag, '') = coalesce(a.l_returnflag, '') AND b.l_linestatus = 'O')")
def fixed_findings(spark, sf_dir):
    """Findings of one pass that the next has no more."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.coalesce("l_returnflag", F.lit("")).alias("k"), "l_linestatus")
    return li.where("l_linestatus = 'F'").join(li.where("l_linestatus = 'O'").select("l_orderkey", "k"), ["l_orderkey", "k"], "left_anti").select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def missing_results(spark, sf_dir):
    """What a stage has no result for: these go in again."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query(r"""WITH c AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS cited FROM conversations)
SELECT conv_id, turn, count(*) AS own FROM c WHERE NOT EXISTS (SELECT 1 FROM c d WHERE d.conv_id = c.conv_id AND d.turn = c.turn + 1 AND d.cited = c.cited) GROUP BY conv_id, turn""")
def judge_dedup(spark, sf_dir):
    """What a judge cites that the rules had reported already doesn't count again."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0))).alias("cited"))
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), "cited").distinct()
    return c.join(nxt, ["conv_id", "turn", "cited"], "left_anti").groupBy("conv_id", "turn").agg(F.count("*").alias("own"))


@query("SELECT c_custkey, n_name, coalesce(r_name, 'none') AS market FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey AND r_regionkey < 3")
def facts_join(spark, sf_dir):
    """Facts of a market, where there are any."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r.where("r_regionkey < 3"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.select("c_custkey", "n_name", F.coalesce("r_name", F.lit("none")).alias("market"))


@query("""WITH r(id, type, blocks) AS (VALUES ('A', 'lexicon', 'paragraph'), ('B', 'length', 'meta'), ('C', 'inline_tags', NULL)), s AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'meta' ELSE 'paragraph' END AS block_type, CASE WHEN doc_id % 4 = 0 THEN 'SKIP_IDENTICAL' ELSE 'ADAPT_ONLY' END AS operation FROM documents)
SELECT doc_id, id AS rule FROM s, r WHERE (blocks IS NULL OR blocks = block_type) AND (operation <> 'SKIP_IDENTICAL' OR type IN ('lexicon', 'length'))""")
def rule_scope(spark, sf_dir):
    """Which rules hold for a segment: the rules unrolled into a literal array, no join."""
    mine = (rules.Rule("A", "lexicon", "minor", blocks=("paragraph",)), rules.Rule("B", "length", "minor", blocks=("meta",)), rules.Rule("C", "inline_tags", "minor"))
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN 'meta' ELSE 'paragraph' END AS block_type", "CASE WHEN doc_id % 4 = 0 THEN 'SKIP_IDENTICAL' ELSE 'ADAPT_ONLY' END AS operation")
    hold = F.array_compact(F.array(*(F.when(rules.applies(r, F.col("block_type"), F.lit("title"), F.col("operation")), r.id) for r in mine)))
    return rows.select("doc_id", F.explode(hold).alias("rule"))


def _one_of(forms):
    return lambda x: x.isin(*forms)


_TERMS = {"T1": ("the", "and"), "T2": ("der",), "T3": ("les", "des"), "T4": ("that",)}


@query(r"""WITH t(term_id, form) AS (VALUES ('T1', 'the'), ('T1', 'and'), ('T2', 'der'), ('T3', 'les'), ('T3', 'des'), ('T4', 'that')), w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')) AS k FROM documents)
SELECT doc_id, term_id, count(*) AS hits FROM w JOIN t ON k = form GROUP BY doc_id, term_id""")
def glossary_hits(spark, sf_dir):
    """Glossary terms in texts: each text is split once and every term's forms are counted in it, with no join."""
    words = F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")
    known = F.array(*(F.lit(f) for fs in _TERMS.values() for f in fs))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.filter(words, lambda w: F.array_contains(known, w)).alias("w"))
    counts = F.array(*(F.struct(F.lit(t).alias("term_id"), F.size(F.filter("w", _one_of(fs))).cast("long").alias("hits")) for t, fs in _TERMS.items()))
    return rows.select("doc_id", F.explode_outer(F.filter(counts, lambda c: c["hits"] > 0)).alias("c")).where("c IS NOT NULL").select("doc_id", "c.*")


@query("SELECT p_name AS id, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("id")).agg(F.count("*").alias("n")).where("n > 1")


_SPANS = "SELECT l_orderkey AS k, l_linenumber * 10 - CAST(l_quantity AS BIGINT) % 15 AS s, l_linenumber * 10 AS e FROM lineitem"


@query(f"""WITH x AS ({_SPANS}), y AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x),
z AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM y)
SELECT k AS l_orderkey, min(s)::BIGINT AS start, max(e)::BIGINT AS "end", count(*) AS n FROM z GROUP BY k, island""")
def merge_spans(spark, sf_dir):
    # DuckDB's cast rounds, half to even.
    s = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "CAST(l_linenumber * 10 - CAST(rint(l_quantity) AS BIGINT) % 15 AS BIGINT) AS start", "CAST(l_linenumber * 10 AS BIGINT) AS end")
    return compare.merge_spans(s, ["l_orderkey"])


@query("""WITH l AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM conversations), r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM l)
SELECT conv_id, run::BIGINT AS run, min(role) AS role, count(*) AS items FROM r GROUP BY conv_id, run""")
def list_runs(spark, sf_dir):
    """Neighbouring items of one group are one list."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.when(F.coalesce(F.lag("role").over(w) == F.col("role"), F.lit(False)), 0).otherwise(1).alias("cut"))
    rows = rows.withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("items"))


@query("""WITH x AS (SELECT conv_id, turn, min(CASE WHEN role = 'system' OR turn = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS h FROM conversations) SELECT conv_id, sum(h)::BIGINT AS header_rows FROM x GROUP BY conv_id""")
def header_rows(spark, sf_dir):
    """Rows at the top that are all headers."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    h = F.min(F.when((F.col("role") == "system") | (F.col("turn") == 0), 1).otherwise(0)).over(w)
    return table(spark, sf_dir, "conversations").select("conv_id", h.alias("h")).groupBy("conv_id").agg(F.sum("h").alias("header_rows"))


@query(LINES + """, n AS (SELECT doc_id, ord, length(text) AS s FROM segments), packed AS (SELECT doc_id, list(s ORDER BY ord) AS xs FROM n GROUP BY doc_id),
f AS (WITH RECURSIVE r AS (SELECT doc_id, xs, 1 AS i, 1 AS batch, 1 AS n, xs[1] AS c FROM packed UNION ALL SELECT doc_id, xs, i + 1, CASE WHEN n >= 12 OR c + xs[i + 1] > 6000 THEN batch + 1 ELSE batch END, CASE WHEN n >= 12 OR c + xs[i + 1] > 6000 THEN 1 ELSE n + 1 END, CASE WHEN n >= 12 OR c + xs[i + 1] > 6000 THEN xs[i + 1] ELSE c + xs[i + 1] END FROM r WHERE i < len(xs)) SELECT doc_id, i AS ord, batch FROM r)
SELECT doc_id, ord::BIGINT AS ord, batch::BIGINT AS batch FROM f""")
def batches(spark, sf_dir):
    return compare.batches(line_rows(spark, sf_dir).withColumn("s", F.length("text")), ["doc_id"], "ord", "s")


@query("""WITH r AS (SELECT doc_id, lower(trim(text)) AS k FROM documents) SELECT md5(k) AS k, min(doc_id) AS doc_id FROM r GROUP BY k""")
def dedup_recs(spark, sf_dir):
    """Of recommendations with the same text the first: a minimum rather than a window."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lower(F.trim("text")).alias("k"))
    return rows.groupBy("k").agg(F.min("doc_id").alias("doc_id")).withColumn("k", F.md5("k"))


@query("SELECT event_type AS reason, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, min(event_id) LIMIT 3")
def top_reasons(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.min("event_id").alias("first")).orderBy(F.desc("n"), "first").limit(3).drop("first")


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT source, string_agg(lang || ' ' || n, ', ' ORDER BY lang) AS shown FROM c GROUP BY source")
def per_locale_str(spark, sf_dir):
    c = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lang", "n"))), lambda x: F.concat(x["lang"], F.lit(" "), x["n"].cast("string"))), ", ").alias("shown"))


@query("""WITH o AS (SELECT o_orderkey, o_totalprice, ['EUR','GBP','CHF','USD'][1 + o_orderkey % 4] AS code, o_custkey FROM orders)
SELECT o_custkey, code, count(*) AS amounts, code <> 'CHF' AS offends FROM o GROUP BY o_custkey, code""")
def currency_policy(spark, sf_dir):
    """Amounts of each document by currency, and whether a Swiss reader would ask about it."""
    code = F.element_at(F.array(*(F.lit(c) for c in ("EUR", "GBP", "CHF", "USD"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", code.alias("code")).groupBy("o_custkey", "code").agg(F.count("*").alias("amounts"))
    return rows.withColumn("offends", F.col("code") != L.PROFILES["de-CH"].currency)


@query("""WITH o AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '€ ' || floor(o_totalprice)::BIGINT WHEN 1 THEN floor(o_totalprice)::BIGINT || ' CHF' ELSE '$' || floor(o_totalprice)::BIGINT END AS s FROM orders)
SELECT o_orderkey, CASE WHEN contains(s, '€') THEN 'EUR' WHEN contains(s, 'CHF') THEN 'CHF' ELSE 'USD' END AS code, regexp_extract(s, '[0-9]+') AS value FROM o""")
def currency_amounts(spark, sf_dir):
    """Amounts read back from how they are written, by the entity extractor."""
    p = F.floor("o_totalprice").cast("string")
    s = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("€ "), p)).when(F.col("o_orderkey") % 3 == 1, F.concat(p, F.lit(" CHF"))).otherwise(F.concat(F.lit("$"), p))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(entities.entities(s, F.lit("en"))).alias("e"))
    return rows.where("e.kind = 'currency'").select("o_orderkey", F.col("e.currency").alias("code"), F.col("e.value").alias("value"))


@query("""WITH p AS (SELECT p_partkey, p_size, ['kW','m³/h','°C','mm'][1 + p_partkey % 4] AS u FROM part) SELECT p_partkey, p_size::VARCHAR AS value, u AS unit FROM p""")
def units(spark, sf_dir):
    """Quantities with units read back from text."""
    u = F.element_at(F.array(*(F.lit(c) for c in ("kW", "m³/h", "°C", "mm"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = F.concat(F.lit("with "), F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " ").otherwise(""), u, F.lit(" in use"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.explode(entities.entities(s, F.lit("en"))).alias("e"))
    return rows.where("e.kind = 'unit'").select("p_partkey", F.col("e.value").alias("value"), F.col("e.unit").alias("unit"))


@query()
def html_blocks(spark, sf_dir):
    """Typed segments of every page."""
    from ..sources.readers import html_segments

    return html_segments(table(spark, sf_dir, "pages")).select("page_id", "ord", "segment_id", "block_type", "hash", F.length("text").cast("long").alias("chars"))


@query()
def ingest_pages(spark, sf_dir):
    """Pages through the whole intake: class, locale, number of segments and whether there is anything to translate."""
    from ..operators import segments
    from ..sources.readers import html_segments

    pages = table(spark, sf_dir, "pages")
    seg = html_segments(pages).groupBy("page_id").agg(F.count("*").alias("segments"), F.sum(T.word_count(F.col("text"))).alias("words"), F.max(T.natural_language(F.col("text"))).alias("translatable"))
    title = segments.page_title(F.col("html"))
    kind, why = segments.classify(F.col("url"), title, F.lit(""))
    lang = F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1)
    head = pages.select("page_id", kind.alias("page_type"), why.alias("evidence"), segments.source_locale(lang, lang, F.col("url")).alias("source_locale"))
    rows = head.join(seg, "page_id", "left")
    return rows.withColumn("accepted", F.coalesce("translatable", F.lit(False)))
