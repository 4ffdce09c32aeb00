"""Queries whose operators have no SQL: held against scalar twins and small cases in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..engine import Engine
from ..functions import inline
from ..functions import text as T
from ..operators import claims, entities, export, formats, integrity, language, reporting, stages
from ..sources import readers, web
from .registry import query, table
from .report_queries import calls
from .segment_queries import line_rows


def _v4(d: str) -> str:
    return f"(user_id * 7919 % 223 + 1) || '.' || (event_id % 256) || '.' || (user_id % 256) || '.' || (event_id % 250 + 1){d}"


_NETS = [n for n in web.BLOCKED if n.version == 4]
_CASES = " ".join(f"WHEN n BETWEEN {int(n[0])} AND {int(n[-1])} THEN '{n}'" for n in _NETS)


@query(f"""WITH a AS (SELECT event_id, {_v4('')} AS address FROM events), b AS (SELECT *, string_split(address, '.') AS p FROM a), c AS (SELECT event_id, address, ((p[1]::BIGINT * 256 + p[2]::BIGINT) * 256 + p[3]::BIGINT) * 256 + p[4]::BIGINT AS n FROM b)
SELECT event_id, address, CASE {_CASES} END AS blocked FROM c""")
def cidr_block(spark, sf_dir):
    """Addresses that no fetch may reach, by number ranges in the plan."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr(_v4("")).alias("address"))
    return rows.withColumn("blocked", web.blocked_v4(F.col("address")))


@query()
def detect_lang(spark, sf_dir):
    """Each document's language by n-gram profiles, with its confidence."""
    docs = table(spark, sf_dir, "documents")
    rows = Engine(spark).detect(docs)
    return rows.select("doc_id", "lang", F.col("found.lang").alias("found"), F.col("found.confidence").alias("confidence"))


@query()
def document_language(spark, sf_dir):
    """Detected, declared and attributed languages of pages as one, with the method that decided."""
    docs = table(spark, sf_dir, "documents")
    rows = Engine(spark).detect(docs)
    declared = F.when(F.col("doc_id") % 3 == 0, F.col("lang"))
    attribute = F.when(F.col("doc_id") % 3 == 1, F.col("lang"))
    lang, conf, method = language.combined(F.col("found.lang"), F.col("found.confidence"), declared, attribute)
    return rows.select("doc_id", lang.alias("language"), conf.alias("confidence"), method.alias("method"))


@query()
def market_claims(spark, sf_dir):
    """Claims in texts that were given one: the intake of the claim rule."""
    said = F.element_at(F.array(*(F.lit(x) for x in (" Levering in heel Nederland.", " Nationwide coverage.", " Lieferung in die Schweiz.", ""))), (F.col("turn") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(claims.claims_of(F.concat("text", said))).alias("c"))
    return rows.select("conv_id", "turn", "c.*")


@query()
def overlap_resolve(spark, sf_dir):
    """Terms of a glossary whose forms overlap: the longest wins."""
    forms = {"A": ("the", "of the"), "B": ("in the",), "C": ("on of the",)}
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(claims.terms_of(F.col("text"), forms)).alias("t"))
    return rows.select("doc_id", "t.*")


@query()
def format_offences(spark, sf_dir):
    """Amounts and dates of orders that aren't written as in Switzerland."""
    s = F.concat(F.lit("Am "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" fuer "), F.format_number("o_totalprice", 2), F.lit(" EUR geliefert."))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(formats.offences_of(s, "de-CH")).alias("o"))
    return rows.select("o_orderkey", "o.*")


@query()
def normalize_formats(spark, sf_dir):
    """Dutch amounts and dates that a model left as they were, put into the Swiss form."""
    s = F.concat(F.lit("Prijs € "), F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), F.lit(" op "), F.date_format("o_orderdate", "d-M-yyyy"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return rows.select("o_orderkey", formats.normalized(F.col("s"), F.col("s"), F.lit("nl"), "de-CH").alias("n")).select("o_orderkey", "n.text", "n.changes")


@query()
def list_depth(spark, sf_dir):
    """Depths of list items without gaps."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 4).cast("int").alias("d")))), lambda x: x["d"]).alias("levels"))
    zero = F.struct(F.lit(-1).alias("last"), F.array().cast("array<int>").alias("out"))
    fold = F.aggregate("levels", zero, lambda a, d: F.struct(F.least(d, a["last"] + 1).alias("last"), F.concat(a["out"], F.array(F.least(d, a["last"] + 1))).alias("out")), lambda a: a["out"])
    return c.select("conv_id", F.posexplode(fold).alias("item", "depth"))


@query()
def model_answers(spark, sf_dir):
    """JSON out of answers with thoughts, fences and slips around it."""
    said = F.concat(F.lit("<think>so</think> Here: ```json\n"), F.regexp_replace("props", "}$", ",}"), F.lit("\n``` done"))
    got = inline.column(lambda t: (lambda v: None if v is None else str(v.get("k")))(inline.model_json(t)), "string", said)
    return table(spark, sf_dir, "events").select("event_id", got.cast("long").alias("k"))


_MARKED = "replace(replace(text, ' the ', ' <a1>the</a1> '), ' of ', ' of<br2/> ')"


@query()
def render_html(spark, sf_dir):
    """Segments with placeholders as HTML."""
    r = inline.column(lambda t: inline.render(t, {"a1": {"tag": "a", "attrs": {"href": "/x?a=1&b=2"}}}), "string", F.expr(_MARKED))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(r).alias("digest"))


@query()
def render_markdown(spark, sf_dir):
    r = inline.column(lambda t: inline.render(t, {"a1": {"tag": "a", "attrs": {"href": "/x"}}}, markdown=True), "string", F.expr(_MARKED))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(r).alias("digest"))


@query()
def plain_spans(spark, sf_dir):
    """A place in the plain text as one in the text with placeholders, which no pair is split by."""
    r = inline.column(lambda t: "{}:{}".format(*inline.map_span(t, 3, 12)), "string", F.expr(_MARKED))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("span"))


@query()
def nesting(spark, sf_dir):
    """What is wrong with the nesting of texts whose closing placeholders were swapped."""
    broken = F.replace(F.expr(_MARKED), F.lit("</a1>"), F.lit("</b3>"))
    r = inline.column(lambda t: len(inline.nesting_problems(t)), "int", broken)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r.alias("problems"))


@query()
def markdown_segments(spark, sf_dir):
    """Markdown documents to typed segments by way of HTML."""
    md = F.concat(F.lit("---\ntitle: x\n---\n# Title\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n")), F.lit("\n\n- one\n- two\n"))
    html = inline.column(lambda t: readers.markdown_html(readers.front_matter(t)[1]), "string", md)
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("page_id"), html.alias("html"))
    return readers.html_segments(rows).select("page_id", "ord", "segment_id", "block_type", "level", "hash")


def _run(spark, sf_dir, target):
    docs = table(spark, sf_dir, "documents")
    rows = line_rows(spark, sf_dir).join(docs.select("doc_id", "source"), "doc_id")
    rows = rows.select("doc_id", "ord", "segment_id", F.lit("paragraph").alias("block_type"), "text", "lang", F.concat("lang", F.lit("-*")).alias("page_locale"), F.when(F.col("doc_id") % 5 == 0, "LEGAL").otherwise("CONTENT").alias("page_type"))
    return Engine(spark).run(rows, (target,))


@query()
def run_pipeline(spark, sf_dir):
    """Line segments through routing, the deterministic provider, rules, repair, scores and verdicts for Switzerland."""
    return _run(spark, sf_dir, "de-CH").select("doc_id", "segment_id", "operation", "status", "repairs", "penalty", "score", "verdict")


@query()
def run_results(spark, sf_dir):
    return Engine(spark).locale_results(_run(spark, sf_dir, "de-CH"))


@query()
def compare_runs(spark, sf_dir):
    """Two providers over the same segments, and the better one of each locale."""
    rows = line_rows(spark, sf_dir).select("doc_id", "ord", "segment_id", F.lit("paragraph").alias("block_type"), "text", "lang", F.concat("lang", F.lit("-*")).alias("page_locale"), F.lit("CONTENT").alias("page_type"))
    one, two = Engine(spark), Engine(spark, stages.mock_provider({("de-CH", "ß"): "ss"}))
    both = one.compare({"plain": one.run(rows, ("de-CH",)), "swiss": two.run(rows, ("de-CH",))})
    return one.best(both)


@query()
def export_pages(spark, sf_dir):
    """Results as pages of HTML, one a document."""
    rows = _run(spark, sf_dir, "de-CH").select("doc_id", "ord", "segment_id", "block_type", F.lit(None).cast("int").alias("level"), "target_text", F.lit(None).cast("string").alias("grp"), "verdict")
    return export.pages(rows).select("doc_id", F.length("page").cast("long").alias("chars"))


@query()
def list_locales(spark, sf_dir):
    return Engine(spark).list_locales()


@query()
def entity_formats(spark, sf_dir):
    """Which kinds of entities of documents a locale would write otherwise."""
    e = entities.entity_rows(table(spark, sf_dir, "documents")).where("kind IN ('number','unit','currency','date')")
    return e.groupBy("kind").agg(F.count("*").alias("n"), F.count("value").alias("read"))


@query("SELECT provider, floor(epoch(ts) / 3600)::BIGINT AS hour, count(*) AS calls FROM (SELECT event_type AS provider, ts FROM events) GROUP BY ALL")
def hourly_calls(spark, sf_dir):
    """Tumbling windows over the call log; the same plan runs on a stream with a watermark."""
    rows = calls(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "provider").agg(F.count("*").alias("calls"))
    return rows.select("provider", F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', w.start)").alias("hour"), "calls")




@query()
def integrity_findings(spark, sf_dir):
    """Figures, codes, addresses, claims and terms of each turn held against the next as if it were its translation."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    terms = {"T1": {"en": ("the",), "de-CH": ("der", "die")}}
    f = integrity.findings(F.col("text"), F.col("target"), F.lit("en"), F.lit("en-GB"), "de-CH", glossary=terms)
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", F.explode(f).alias("f")).select("conv_id", "turn", "f.rule", "f.severity", "f.found")


@query()
def back_translation(spark, sf_dir):
    """Targets translated back by a provider and held against their sources."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("p-"), F.col("turn").cast("string")).alias("segment_id"), F.col("text").alias("source_text"), F.col("text").alias("target_text"), F.lit("en").alias("source_lang"))
    back = stages.back_translate(rows, stages.mock_provider(), "de-CH")
    return back.select("doc_id", "segment_id", T.round_half_up(T.token_f1(F.col("source_text"), F.col("back")), 3).alias("f1"))


@query()
def judge_scores(spark, sf_dir):
    """A judge's five scores read from its JSON."""
    import pandas as pd

    def scorer(rows):
        return pd.DataFrame({"key": rows["key"], "output": [f'{{"accuracy":{len(t) % 101},"fluency":90,"terminology":80,"locale_conventions":70,"style_brand":60,"confidence":0.9}}' for t in rows["text"]]})

    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat(F.lit("p-"), F.col("turn").cast("string")).alias("segment_id"), F.col("text").alias("target_text"))
    return stages.judge(rows, scorer).select("doc_id", "segment_id", "judged.*")


@query("""WITH r AS (SELECT source AS provider, CASE WHEN source LIKE '%7' THEN 'PARTIAL' WHEN source LIKE '%5' THEN 'FAILED' ELSE 'COMPLETE' END AS status, count(*) FILTER (l.quality IS NULL) AS missing, count(*) FILTER (l.toxic = 1) AS unpriced, count(DISTINCT lang) AS targets FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source),
a AS (SELECT count(DISTINCT targets) AS n FROM r)
SELECT provider, unnest(list_filter([CASE WHEN status = 'FAILED' THEN 'CANDIDATE_FAILED' END, CASE WHEN provider = 'src3' THEN 'JUDGE_NOT_INDEPENDENT' END, CASE WHEN status = 'PARTIAL' THEN 'CANDIDATE_INCOMPLETE' END, CASE WHEN n > 1 THEN 'TARGETS_DIFFER' END, CASE WHEN unpriced > 0 THEN 'PRICING_UNKNOWN' END, CASE WHEN missing > 0 THEN 'SEGMENTS_WITHOUT_OUTPUT' END], lambda x: x IS NOT NULL)) AS code FROM r, a""")
def comparison_notes(spark, sf_dir):
    """What a comparison of sources has to say of itself."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    runs = d.groupBy(F.col("source").alias("provider")).agg(F.count_if(F.col("quality").isNull()).alias("missing"), F.count_if(F.col("toxic") == 1).alias("unpriced"), F.countDistinct("lang").alias("targets"))
    runs = runs.withColumns({"status": F.when(F.col("provider").like("%7"), "PARTIAL").when(F.col("provider").like("%5"), "FAILED").otherwise("COMPLETE"), "served_by": F.col("provider"), "doc_key": F.lit("one"), "unvalidated": F.lit(0)})
    return reporting.notes(runs, "src3")


_HEADS = "CASE WHEN doc_id % 5 = 0 THEN '  given ' ELSE '' END AS a, CASE WHEN doc_id % 5 = 1 THEN ' ; first, second' END AS b, CASE WHEN doc_id % 5 = 2 THEN 'Heading' END AS c, CASE WHEN doc_id % 5 = 3 THEN 'Title | Brand' END AS d"


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'given' WHEN 1 THEN 'first' WHEN 2 THEN 'Heading' WHEN 3 THEN 'Title' END AS keyword, CASE doc_id % 5 WHEN 0 THEN 'provided' WHEN 1 THEN 'meta_keywords' WHEN 2 THEN 'derived_h1' WHEN 3 THEN 'derived_title' END AS origin FROM documents")
def pick_keyword(spark, sf_dir):
    k, o = reporting.keyword(*(F.col(c) for c in "abcd"))
    return table(spark, sf_dir, "documents").selectExpr("doc_id", *_HEADS.split(", CASE")[:1], *(f"CASE{x}" for x in _HEADS.split(", CASE")[1:])).select("doc_id", k.alias("keyword"), o.alias("origin"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || '-' || upper(lang) ELSE 'xx-*' END AS locale FROM documents")
def final_locale(spark, sf_dir):
    """A region that is known stays where the text's language agrees."""
    known = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("-"), F.upper("lang"))).otherwise(F.concat("lang", F.lit("-*")))
    found = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit("-*"))).otherwise(F.lit("xx-*"))
    return table(spark, sf_dir, "documents").select("doc_id", reporting.final_locale(known, found).alias("locale"))


@query("SELECT o_custkey AS job_id, count(DISTINCT o_orderstatus) AS locales, count(*) FILTER (o_orderstatus = 'F') AS failed, string_agg(DISTINCT o_orderpriority, '; ' ORDER BY o_orderpriority) AS warnings FROM orders GROUP BY o_custkey")
def job_summary(spark, sf_dir):
    jobs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderstatus").alias("locale"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("verdict"), F.col("o_orderpriority").alias("warning"))
    return reporting.job_summary(jobs)


@query("SELECT source AS rule, arg_min(text, doc_id) FILTER (doc_id % 3 = 0) AS wrong, arg_min(text, doc_id) FILTER (doc_id % 3 <> 0) AS right FROM documents GROUP BY source".replace("AS right", 'AS "right"'))
def rule_examples(spark, sf_dir):
    tests = table(spark, sf_dir, "documents").select(F.col("source").alias("rule"), F.col("doc_id").alias("n"), F.col("text").alias("target"), F.when(F.col("doc_id") % 3 == 0, "fail").otherwise("pass").alias("expect"))
    return reporting.rule_examples(tests)


@query(r"SELECT page_id, lower(regexp_extract(url, '://([^/?#:]*)', 1)) IN ('tionsh.example.net', 'm.tiontion.example.com') AS allowed FROM pages")
def host_allowed(spark, sf_dir):
    host = F.concat(F.regexp_extract("url", "://([^/?#:]*)", 1), F.lit(":443"))
    return table(spark, sf_dir, "pages").select("page_id", reporting.host_allowed(host, ("tionsh.example.net", "m.tiontion.example.com")).alias("allowed"))


@query("WITH a AS (SELECT lang AS target, text, 0 AS n FROM documents UNION ALL SELECT 'en', ' ' || text, 1 FROM conversations) SELECT target, arg_min(text, (n, text)) AS text FROM a GROUP BY target, lower(trim(text))")
def recommendations(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("lang").alias("target"), F.col("text"))
    b = table(spark, sf_dir, "conversations").select(F.lit("en").alias("target"), F.concat(F.lit(" "), F.col("text")).alias("text"))
    return reporting.recommendations(a, b)
