"""Documents and pages to segments, page classes, locales and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import text as T
from ..operators import routing, segments
from .registry import SP, query, table
from .text_queries import _TITLE

_CLEAN = r"regexp_replace(replace(regexp_replace(text, '^\x{feff}', ''), chr(13) || chr(10), chr(10)), '\r', chr(10), 'g')"
_LINE = rf"trim(regexp_replace(regexp_replace(x, '[\x{{00ad}}\x{{200b}}\x{{2060}}\x{{feff}}]', '', 'g'), '{SP}+', ' ', 'g'), ' ')"
_BLOCKS = rf"""WITH c AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array({_CLEAN}, '\n[ \t]*\n'), lambda k: list_filter(list_transform(string_split(k, chr(10)), lambda x: {_LINE}), lambda x: x <> '')), lambda k: len(k) > 0) AS chunks FROM documents),
b AS (SELECT doc_id, len(chunks) AS n_blocks, unnest(chunks) AS lines, generate_subscripts(chunks, 1) - 1 AS pos FROM c),
j AS (SELECT doc_id, n_blocks, pos, len(lines) AS k, array_to_string(lines, ' ') AS t FROM b),
blocks AS (SELECT doc_id, pos, n_blocks, CASE WHEN pos = 0 AND n_blocks > 1 AND k = 1 AND length(t) <= 80 AND NOT regexp_matches(t, '[.!?:;,…]$') THEN 'heading' ELSE 'paragraph' END AS block_type, replace(replace(t, '<', '&lt;'), '>', '&gt;') AS text FROM j)"""
_SEGMENTS = rf""", segments AS (SELECT doc_id, pos + 1 AS ord, (CASE block_type WHEN 'heading' THEN 'h' ELSE 'p' END) || '-' || CASE WHEN length((pos + 1)::VARCHAR) < 3 THEN lpad((pos + 1)::VARCHAR, 3, '0') ELSE (pos + 1)::VARCHAR END AS segment_id, block_type, text, substring(sha1(text), 1, 12) AS hash FROM blocks)"""
LINES = rf"""WITH c AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_LINE}), lambda x: x <> '') AS lines FROM documents),
b AS (SELECT doc_id, lang, unnest(lines) AS text, generate_subscripts(lines, 1) AS ord FROM c),
segments AS (SELECT doc_id, lang, ord, 'p-' || CASE WHEN length(ord::VARCHAR) < 3 THEN lpad(ord::VARCHAR, 3, '0') ELSE ord::VARCHAR END AS segment_id, text, length(text) - length(replace(text, ' ', '')) + 1 AS words FROM b)"""


def line_rows(spark, sf_dir):
    """Line segments with their document's language and word counts."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "lang", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(T.collapse_space(x))), lambda x: x != "").alias("x"))
    # The outer form: for the other Spark infers a filter on the array's size, and computes it twice.
    rows = rows.select("doc_id", "lang", F.posexplode_outer("x").alias("pos", "text")).where("pos IS NOT NULL")
    n = (F.col("pos") + 1).cast("string")
    segment_id = F.concat(F.lit("p-"), F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n))
    return rows.select("doc_id", "lang", (F.col("pos") + 1).cast("long").alias("ord"), segment_id.alias("segment_id"), "text", T.spaced_words(F.col("text")).alias("words"))


@query(_BLOCKS + " SELECT doc_id, pos, n_blocks, block_type, md5(text) AS digest FROM blocks")
def text_blocks(spark, sf_dir):
    return segments.text_blocks(table(spark, sf_dir, "documents")).select("doc_id", "pos", "n_blocks", "block_type", F.md5("text").alias("digest"))


@query(_BLOCKS + _SEGMENTS + " SELECT doc_id, ord, segment_id, block_type, hash FROM segments")
def text_segments(spark, sf_dir):
    return segments.seal(segments.text_blocks(table(spark, sf_dir, "documents"))).drop("text")


@query(LINES + " SELECT doc_id, ord, segment_id, substring(sha1(text), 1, 12) AS hash, words FROM segments")
def segment_ids(spark, sf_dir):
    return line_rows(spark, sf_dir).select("doc_id", "ord", "segment_id", T.text_hash(F.col("text")).alias("hash"), "words")


@query(_BLOCKS + _SEGMENTS + " SELECT doc_id, 'doc-' || substring(sha1('text' || chr(10) || doc_id || chr(10) || string_agg(segment_id || ':' || hash, chr(10) ORDER BY ord)), 1, 12) AS doc_key FROM segments GROUP BY doc_id")
def document_ids(spark, sf_dir):
    return segments.document_ids(segments.seal(segments.text_blocks(table(spark, sf_dir, "documents"))))


@query("""WITH t AS (SELECT page_id, url, html FROM pages) SELECT page_id, CASE WHEN regexp_matches(url, '(?i)\\.(html?|md|markdown|txt|docx)([?#]|$)') THEN lower(regexp_extract(url, '(?i)\\.(html?|md|markdown|txt|docx)([?#]|$)', 1)) WHEN contains(html, chr(0)) THEN 'binary' WHEN regexp_matches(ltrim(html), '(?i)^<(!doctype|html|head|body)') THEN 'html' WHEN regexp_matches(html, '^(---|#)') THEN 'markdown' ELSE 'text' END AS format FROM t""".replace("\\\\", "\\"))
def sniff_format(spark, sf_dir):
    from ..sources.readers import sniff

    return table(spark, sf_dir, "pages").select("page_id", sniff(F.col("url"), F.col("html")).alias("format"))


@query(f"SELECT page_id, {_TITLE} AS title FROM pages")
def page_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", segments.page_title(F.col("html")).alias("title"))


_HEAD = rf"trim(regexp_split_to_array({_TITLE}, '\s+[|–—·•-]\s+|\s*\|\s*')[1], ' ')"


@query(f"SELECT page_id, {_HEAD} AS head FROM pages")
def title_head(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", segments.title_head(segments.page_title(F.col("html"))).alias("head"))


_LAST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', ''), '^.*/', '')"
_USABLE = "({0} <> '' AND NOT regexp_matches({0}, '^[0-9]+$') AND NOT regexp_matches({0}, '(?i)^(index|default|home|start|main)$'))"


@query(rf"""WITH t AS (SELECT page_id, lower(trim(regexp_replace(regexp_replace(url_decode({_LAST}), '(?i)\.[a-z0-9]{{2,5}}$', ''), '[-_+]+', ' ', 'g'), ' ')) AS a, array_to_string(list_filter(regexp_split_to_array(lower({_HEAD}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')[1:8], ' ') AS b FROM pages)
SELECT page_id, CASE WHEN {_USABLE.format('a')} THEN a WHEN {_USABLE.format('b')} THEN b END AS slug FROM t""")
def source_slug(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", segments.source_slug(F.col("url"), segments.page_title(F.col("html"))).alias("slug"))


_PATH = r"url_decode(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''))"
_H1 = r"trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), ' ')"


@query(rf"""WITH t AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN url || '/privacy-policy/' WHEN page_id % 7 = 1 THEN url || '/Legal.html' ELSE url END AS url, CASE WHEN page_id % 7 = 2 THEN 'Terms & Conditions' ELSE {_TITLE} END AS title, {_H1} AS h1 FROM pages),
u AS (SELECT page_id, {_PATH} AS path, title, h1 FROM t)
SELECT page_id, CASE WHEN regexp_matches(path, '{segments.LEGAL_URL}') OR regexp_matches(title, '{segments.LEGAL_TITLE}') OR regexp_matches(h1, '{segments.LEGAL_TITLE}') THEN 'LEGAL' ELSE 'CONTENT' END AS page_type,
CASE WHEN regexp_matches(path, '{segments.LEGAL_URL}') THEN 'url:' || regexp_replace(regexp_extract(path, '{segments.LEGAL_URL}', 0), '^[/_.-]+|[/_.-]+$', '', 'g') WHEN regexp_matches(title, '{segments.LEGAL_TITLE}') THEN 'title:' || regexp_extract(title, '{segments.LEGAL_TITLE}', 0) WHEN regexp_matches(h1, '{segments.LEGAL_TITLE}') THEN 'h1:' || regexp_extract(h1, '{segments.LEGAL_TITLE}', 0) ELSE 'none' END AS evidence FROM u""")
def classify_pages(spark, sf_dir):
    url = F.expr("CASE WHEN page_id % 7 = 0 THEN url || '/privacy-policy/' WHEN page_id % 7 = 1 THEN url || '/Legal.html' ELSE url END")
    title = F.when(F.col("page_id") % 7 == 2, "Terms & Conditions").otherwise(segments.page_title(F.col("html")))
    h1 = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]*>", ""), r"\s+", " "))
    kind, why = segments.classify(F.col("url"), F.col("title"), F.col("h1"))
    return table(spark, sf_dir, "pages").select("page_id", url.alias("url"), title.alias("title"), h1.alias("h1")).select("page_id", kind.alias("page_type"), why.alias("evidence"))


_TAGS = "CASE CAST(doc_id % 6 AS INT) WHEN 0 THEN lang WHEN 1 THEN lang || '_' || upper(lang) WHEN 2 THEN 'x-default' WHEN 3 THEN lang || '-Hans-CN' WHEN 4 THEN '*' ELSE lang || '-*' END"


@query(f"""WITH t AS (SELECT doc_id, trim(replace({_TAGS}, '_', '-')) AS tag FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(tag, '(?i)^[a-z]{{2,3}}(-|$)') THEN lower(split_part(tag, '-', 1)) END AS language, CASE WHEN regexp_matches(tag, '(?i)^[a-z]{{2,3}}(-|$)') THEN nullif(upper(regexp_extract(tag, '(?i)^[a-z]{{2,3}}(?:-[a-z0-9]{{3,8}})*-([a-z]{{2}})(?:-|$)', 1)), '') END AS region FROM t""")
def locale_tag(spark, sf_dir):
    a, b = segments.locale_tag(F.col("tag"))
    return table(spark, sf_dir, "documents").select("doc_id", F.expr(_TAGS).alias("tag")).select("doc_id", a.alias("language"), b.alias("region"))


@query("""WITH t AS (SELECT page_id, regexp_extract(html, '<html[^>]*lang="([^"]*)"', 1) AS hl, ['en','de','it','nl','und'][1 + page_id % 5] AS lang, replace(replace(url, '.com/', '.de/'), '.net/', '.ch/') AS url FROM pages),
u AS (SELECT *, lower(regexp_extract(url, '://[^/?#:]*\\.([a-z]+)', 1)) AS tld, nullif(lower(hl), '') AS a FROM t),
v AS (SELECT *, (a IS NOT NULL AND (lang = 'und' OR a = lang)) AS agrees FROM u),
w AS (SELECT page_id, lang, agrees, CASE WHEN agrees THEN a ELSE lang END AS l, tld FROM v)
SELECT page_id, CASE WHEN NOT agrees AND lang = 'und' THEN 'und' WHEN (l, tld) IN (('de','de'),('de','ch'),('de','at'),('it','it'),('it','ch'),('nl','nl')) THEN l || '-' || upper(tld) WHEN l = 'nl' THEN 'nl-NL' ELSE l || '-*' END AS source_locale FROM w""".replace("\\\\", "\\"))
def source_locale(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html[^>]*lang="([^"]*)"', 1).alias("hl"), F.expr("element_at(array('en','de','it','nl','und'), CAST(1 + page_id % 5 AS INT))").alias("lang"), F.expr("replace(replace(url, '.com/', '.de/'), '.net/', '.ch/')").alias("url"))
    return rows.select("page_id", segments.source_locale(F.col("lang"), F.col("hl"), F.col("url")).alias("source_locale"))


@query("SELECT event_id, floor((1.0::DOUBLE - (1.0::DOUBLE - least(value, 100.0::DOUBLE) / 100.0::DOUBLE) * (1.0::DOUBLE - 0.9::DOUBLE)) * 1000.0::DOUBLE + 0.5::DOUBLE) / 1000.0::DOUBLE AS confidence FROM events")
def noisy_or(spark, sf_dir):
    c = F.lit(1.0) - (F.lit(1.0) - F.least("value", F.lit(100.0)) / F.lit(100.0)) * (F.lit(1.0) - F.lit(0.9))
    return table(spark, sf_dir, "events").select("event_id", T.round_half_up(c, 3).alias("confidence"))


@query(LINES + " SELECT doc_id, segment_id, CASE WHEN words < 4 THEN 'inherited' ELSE 'lib' END AS method, lang FROM segments")
def segment_lang(spark, sf_dir):
    """Short segments take their document's language."""
    return line_rows(spark, sf_dir).select("doc_id", "segment_id", F.when(F.col("words") < 4, "inherited").otherwise("lib").alias("method"), "lang")


@query(LINES + " SELECT lang, count(*) AS segments, sum(words)::BIGINT AS words, count(DISTINCT doc_id) AS docs FROM segments GROUP BY lang")
def lang_summary(spark, sf_dir):
    return line_rows(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("segments"), F.sum("words").alias("words"), F.countDistinct("doc_id").alias("docs"))


_OPERATION = """CASE WHEN lang <> lower(split_part(target, '-', 1)) THEN CASE WHEN page_type = 'LEGAL' THEN 'TRANSLATE_ONLY' ELSE 'TRANSLATE_LOCALIZE' END
WHEN lower(CASE WHEN split_part(page_locale, '-', 1) = lang THEN page_locale WHEN lang = 'nl' THEN 'nl-NL' ELSE lang || '-*' END) = lower(target) THEN 'SKIP_IDENTICAL' WHEN page_type = 'LEGAL' THEN 'SKIP_IDENTICAL' ELSE 'ADAPT_ONLY' END"""
_ROUTED = f"""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'nl' ELSE lang END AS lang, CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'de-CH' ELSE lang || '-*' END AS page_locale, CASE WHEN doc_id % 5 = 0 THEN 'LEGAL' ELSE 'CONTENT' END AS page_type FROM documents),
r AS (SELECT s.*, target FROM s, (SELECT unnest({list(L.LOCALES)}) AS target)), o AS (SELECT *, {_OPERATION} AS operation FROM r)"""


def routed(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 11 = 0 THEN 'nl' ELSE lang END AS lang", "CASE WHEN lang = 'de' AND doc_id % 2 = 0 THEN 'de-CH' ELSE lang || '-*' END AS page_locale", "CASE WHEN doc_id % 5 = 0 THEN 'LEGAL' ELSE 'CONTENT' END AS page_type")
    return routing.route(rows)


@query(_ROUTED + " SELECT doc_id, target, operation FROM o")
def route_segments(spark, sf_dir):
    return routed(spark, sf_dir).select("doc_id", "target", "operation")


@query(_ROUTED + " SELECT target, operation, count(*) AS n FROM o GROUP BY target, operation")
def operation_counts(spark, sf_dir):
    return routed(spark, sf_dir).groupBy("target", "operation").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'en-NL,en-GB,de-DE,de-AT,de-CH,it-IT,nl-NL' END AS targets FROM documents")
def resolve_targets(spark, sf_dir):
    """Targets of each document's language; languages that aren't accepted as a source get none."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source_language"))
    return routing.resolve_targets(rows, en_to_nl=True).select("doc_id", F.array_join("targets", ",").alias("targets"))


@query("SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'KEEP' WHEN event_type <> 'error' THEN 'REPLACE_WITH_FACT' ELSE 'NEUTRALIZE' END AS action FROM events")
def claim_action(spark, sf_dir):
    fact = F.when(F.col("event_type") != "error", F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", routing.claim_action(F.col("user_id") % 3 == 0, fact).alias("action"))


@query(f"""WITH t AS (SELECT p.page_id, l.target, {_TITLE} AS title FROM pages p, (SELECT unnest({list(L.LOCALES)}) AS target) l)
SELECT target, count(*) AS pages, count(*) FILTER (length(title) <= 60) AS title_ok, max(length(title))::BIGINT AS longest FROM t GROUP BY target""")
def seo_meta(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(T.char_length(segments.page_title(F.col("html"))).alias("n"), F.explode(F.array(*(F.lit(c) for c in L.LOCALES))).alias("target"))
    return rows.groupBy("target").agg(F.count("*").alias("pages"), F.count_if(F.col("n") <= 60).alias("title_ok"), F.max("n").alias("longest"))
