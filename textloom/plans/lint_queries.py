"""Entities, numbers and rules over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import numbers as N
from ..functions import text as T
from ..operators import entities, reporting, rules, scoring
from .registry import SP, query, table
from .segment_queries import LINES, line_rows
from .text_queries import _TITLE

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_PHONE = r"\+[0-9]{1,3}(?:[ .-]?\(?[0-9]\)?){8,12}"


def _found(pattern: str, name: str = "match") -> str:
    p = pattern.replace("'", "''")
    return f"SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) AS {name} FROM documents"


def _each(spark, sf_dir, pattern: str, need: str, name: str = "match"):
    text = F.col("text")
    hits = F.when(F.contains(text, F.lit(need)), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(hits).alias(name)).where(F.col(name).isNotNull())


@query(_found(_EMAIL, "email"))
def emails(spark, sf_dir):
    return _each(spark, sf_dir, _EMAIL, "@", "email")


@query(_found(_PHONE, "phone"))
def phones(spark, sf_dir):
    return _each(spark, sf_dir, _PHONE, "+", "phone")


@query("""SELECT page_id, unnest(regexp_extract_all(html, 'https?://[^ \\t\\n<>"'')\\]]+')) AS url FROM (SELECT page_id, html || ' ' || url AS html FROM pages)""".replace("\\\\", "\\"))
def urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all(F.concat("html", F.lit(" "), "url"), F.lit("https?://[^ \\t\\n<>\"')\\]]+"), F.lit(0))).alias("url"))


_ORDER_TEXT = "o_orderstatus || ' ' || {day} || '. am ' || {d} || ' fuer ' || {price} || ' EUR'"
_DE_ORDERS = """SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS day FROM orders"""


@query("SELECT o_orderkey, lpad(day(o_orderdate)::VARCHAR, 2, '0') || '.' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '.' || year(o_orderdate) AS de, lpad(day(o_orderdate)::VARCHAR, 2, '0') || '/' || lpad(month(o_orderdate)::VARCHAR, 2, '0') || '/' || year(o_orderdate) AS en FROM orders")
def date_text(spark, sf_dir):
    d = [F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate")]
    return table(spark, sf_dir, "orders").select("o_orderkey", N.date_text(*d, ".").alias("de"), N.date_text(*d, "/").alias("en"))


@query("""WITH t AS (SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') || ' or ' || strftime(o_orderdate, '%m/%d/%y') || ' or 45.13.2020' AS s FROM orders),
x AS (SELECT o_orderkey, unnest(regexp_extract_all(s, '[0-9]{2}[./][0-9]{2}[./][0-9]{2,4}')) AS d FROM t)
SELECT o_orderkey, count(*) AS dates, count(*) FILTER (substring(d, 3, 1) = substring(d, 6, 1) AND substring(d, 1, 2)::INT BETWEEN 1 AND 31 AND substring(d, 4, 2)::INT BETWEEN 1 AND 12) AS valid FROM x GROUP BY o_orderkey""")
def numeric_dates(spark, sf_dir):
    """Dates written in digits and how many of them can be read as day and month."""
    s = F.concat(F.date_format("o_orderdate", "dd.MM.yyyy"), F.lit(" or "), F.date_format("o_orderdate", "MM/dd/yy"), F.lit(" or 45.13.2020"))
    hits = F.regexp_extract_all(s, F.lit("[0-9]{2}[./][0-9]{2}[./][0-9]{2,4}"), F.lit(0))
    part = lambda d, i: F.substring(d, i, 2).cast("int")
    good = F.filter(hits, lambda d: (F.substring(d, 3, 1) == F.substring(d, 6, 1)) & part(d, 1).between(1, 31) & part(d, 4).between(1, 12))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.size(hits).cast("long").alias("dates"), F.size(good).cast("long").alias("valid"))


#: Prices as they are written in six ways.
_PRICE = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)"
_WAYS = "CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN {g_dot} || ',' || {c} WHEN 1 THEN {g_com} || '.' || {c} WHEN 2 THEN {p} || '.' || {c} WHEN 3 THEN '0' || {p} WHEN 4 THEN {g_dot} ELSE {g_com} || ',-' END"


def _ways(dialect: str) -> str:
    if dialect == "spark":
        p, c = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)", "lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')"
        g = lambda s: f"regexp_replace({p}, '(?<=[0-9])(?=([0-9]{{3}})+$)', '{s}')"
    else:
        p, c = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)", "lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')"
        g = lambda s: f"replace(format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)), ',', '{s}')"
    return _WAYS.format(g_dot=g("."), g_com=g(","), p=p, c=c)


def _parsed_sql(lang: str) -> str:
    """parse_number() for the six ways, by a different route: what each way must mean in a language."""
    p, c = "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)", "lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')"
    big, million = "floor(o_totalprice) >= 1000", "floor(o_totalprice) >= 1000000"
    dot = f"CASE WHEN {million} OR NOT {big} THEN {p} ELSE CASE '{lang}' WHEN 'en' THEN left({p}, length({p}) - 3) || '.' || right({p}, 3) ELSE {p} END END"
    # 12,345,- : the dash's comma also stands between groups, so its meaning is contradictory
    dash = f"CASE WHEN {big} THEN NULL ELSE {p} END"
    return f"CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN {p} || '.' || {c} WHEN 1 THEN {p} || '.' || {c} WHEN 2 THEN {p} || '.' || {c} WHEN 3 THEN '0' || {p} WHEN 4 THEN {dot} ELSE {dash} END"


@query(f"SELECT o_orderkey, {_ways('duck')} AS raw, {_parsed_sql('de')} AS de, {_parsed_sql('en')} AS en FROM orders")
def parse_number(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ways("spark")).alias("raw"))
    return rows.select("o_orderkey", "raw", N.parse_number(F.col("raw"), F.lit("de"))["value"].alias("de"), N.parse_number(F.col("raw"), F.lit("en"))["value"].alias("en"))


@query(f"""WITH t AS (SELECT o_orderkey, {_ways('duck')} AS raw, {_parsed_sql('de')} AS v FROM orders)
SELECT o_orderkey, CASE WHEN v IS NULL THEN NULL WHEN o_orderkey % 6 = 3 THEN '#' || raw WHEN contains(v, '.') THEN regexp_replace(regexp_replace(v, '0+$', ''), '\\.$', '') ELSE v END AS key FROM t""".replace("\\\\", "\\"))
def numeric_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ways("spark")).alias("raw")).withColumn("p", N.parse_number(F.col("raw"), F.lit("de")))
    return rows.select("o_orderkey", N.numeric_key(F.col("p"), F.col("raw")).alias("key"))


@query(f"""WITH t AS (SELECT o_orderkey, o_totalprice, {_ways('duck')} AS raw, {_parsed_sql('de')} AS v FROM orders), u AS (SELECT *, format('{{:,}}', CAST(floor(o_totalprice) AS BIGINT)) AS g, CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS p, lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0') AS c FROM t)
SELECT o_orderkey, CASE WHEN v IS NULL THEN NULL ELSE CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN replace(g, ',', '''') || '.' || c WHEN 1 THEN replace(g, ',', '''') || '.' || c WHEN 2 THEN p || '.' || c WHEN 3 THEN raw WHEN 4 THEN replace(g, ',', '''') ELSE p || '.-' END END AS ch FROM u""")
def format_number(spark, sf_dir):
    """German prices as Swiss ones."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ways("spark")).alias("raw")).withColumn("p", N.parse_number(F.col("raw"), F.lit("de")))
    p = L.PROFILES["de-CH"]
    return rows.select("o_orderkey", N.format_number(F.col("p"), F.col("raw"), p.decimal, p.thousands, p.keep_dash).alias("ch"))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^\\p{L}\\p{N}_])([0-9]+)', 2)) AS number FROM documents) SELECT doc_id, count(*) AS n, sum(length(number))::BIGINT AS digits FROM x GROUP BY doc_id""".replace("\\\\", "\\"))
def numbers(spark, sf_dir):
    """Digit runs that begin no word's end, counted without an explode."""
    hits = F.regexp_extract_all("text", F.lit(r"(^|[^\p{L}\p{N}_])([0-9]+)"), F.lit(2))
    rows = table(spark, sf_dir, "documents").select("doc_id", hits.alias("h")).where(F.size("h") > 0)
    return rows.select("doc_id", F.size("h").cast("long").alias("n"), F.length(F.array_join("h", "")).cast("long").alias("digits"))


@query("SELECT doc_id, (length(text) - length(replace(text, 'ß', '')))::BIGINT AS n FROM documents WHERE contains(text, 'ß')")
def lex_eszett(spark, sf_dir):
    """Findings of the Swiss rule against ß: counted from the rule's spans."""
    seg = _pairs(spark, sf_dir)
    rule = next(r for r in rules.RULES if r.id == "DECH-SZ-01")
    rows = rules.lint(seg, "de-CH", (rule,))
    return rows.where(F.size("findings") > 0).select("doc_id", F.size("findings").cast("long").alias("n"))


def _pairs(spark, sf_dir):
    """Documents as their own targets."""
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source_text"), F.col("text").alias("target_text"), F.col("lang").alias("source_lang"), F.lit("ADAPT_ONLY").alias("operation"), F.lit("paragraph").alias("block_type"))


@query("""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]{1,300})"')) AS found FROM documents) SELECT doc_id, found, '«' || substring(found, 2, length(found) - 2) || '»' AS replacement FROM x""".replace("\\\\", "\\"))
def lex_quotes(spark, sf_dir):
    rule = rules.Rule("QUOTES", "lexicon", "major", ((r'"([^"\n]{1,300})"', "«$1»"),), keep_case=False)
    rows = rules.lint(_pairs(spark, sf_dir), "de-CH", (rule,)).select("doc_id", F.explode_outer("findings").alias("f")).where("f IS NOT NULL")
    return rows.select("doc_id", "f.found", "f.replacement")


@query("SELECT doc_id, md5(replace(replace(text, 'ß', 'ss'), 'ẞ', 'SS')) AS digest FROM documents")
def autofix_eszett(spark, sf_dir):
    rule = next(r for r in rules.RULES if r.id == "DECH-SZ-01")
    rows = rules.lint(_pairs(spark, sf_dir), "de-CH", (rule,))
    return rows.select("doc_id", F.md5(rules.autofix(F.col("target_text"), F.col("findings"))).alias("digest"))


@query(r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)(^|[^\p{L}\p{N}_])(oner|there)s?', 2)) AS w FROM documents) SELECT doc_id, count(*) AS n FROM x GROUP BY doc_id""")
def lex_uk_spelling(spark, sf_dir):
    """A spelling list of word beginnings, as the rule for one spelling against another uses; words of the corpus stand in."""
    rule = rules.Rule("SPELL", "lexicon", "minor", ((r"(?iu)(?<![\p{L}\p{N}_])(oner|there)s?", "$1x"),))
    rows = rules.lint(_pairs(spark, sf_dir), "en-GB", (rule,))
    return rows.where(F.size("findings") > 0).select("doc_id", F.size("findings").cast("long").alias("n"))


@query("SELECT doc_id, CASE WHEN contains(text, ' of ') THEN len(regexp_extract_all(text, ' an ')) + CASE WHEN contains(text, ' with ') THEN 0 ELSE 1 END ELSE 0 END AS n FROM documents")
def conditional(spark, sf_dir):
    rule = rules.Rule("COND", "conditional", "minor", when_source=" of ", forbid=(" an ",), require=(" with ",))
    return rules.lint(_pairs(spark, sf_dir), "en-GB", (rule,)).select("doc_id", F.size("findings").cast("long").alias("n"))


@query("""WITH g AS (SELECT conv_id, bool_or(contains(text, ' the ')) AS asked, min(turn) FILTER (contains(text, 'The')) AS ord FROM conversations GROUP BY conv_id)
SELECT g.conv_id, g.ord, position('The' IN c.text)::BIGINT AS at, substring(c.text, position('The' IN c.text), 4) = 'The ' AS ok FROM g JOIN conversations c ON c.conv_id = g.conv_id AND c.turn = g.ord WHERE asked""")
def first_mention(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("source_text"), F.col("text").alias("target_text"))
    return rules.first_mention(c, ["conv_id"], "turn", " the ", "The", "The ")


@query(f"SELECT page_id, length({_TITLE}) AS chars, length({_TITLE}) > 40 AS over FROM pages")
def length_rule(spark, sf_dir):
    from ..operators.segments import page_title

    seg = table(spark, sf_dir, "pages").select("page_id", page_title(F.col("html")).alias("target_text"), F.lit("").alias("source_text"), F.lit("en").alias("source_lang"), F.lit("TRANSLATE_LOCALIZE").alias("operation"), F.lit("meta").alias("block_type"), F.lit("title").alias("meta_kind"))
    rule = rules.Rule("LEN", "length", "minor", most=40, blocks=("meta",), metas=("title",))
    return rules.lint(seg, "de-DE", (rule,)).select("page_id", T.char_length(F.col("target_text")).alias("chars"), (F.size("findings") > 0).alias("over"))


@query("SELECT page_id, NOT regexp_matches(slug, '^[a-z0-9]+(-[a-z0-9]+)*$') AS bad FROM (SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', '') AS slug FROM pages)")
def slug_rule(spark, sf_dir):
    slug = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", "")
    seg = table(spark, sf_dir, "pages").select("page_id", slug.alias("target_text"), F.lit("").alias("source_text"), F.lit("en").alias("source_lang"), F.lit("TRANSLATE_LOCALIZE").alias("operation"), F.lit("meta").alias("block_type"), F.lit("slug").alias("meta_kind"))
    rule = next(r for r in rules.RULES if r.id == "SEO-SLUG-01")
    return rules.lint(seg, "de-DE", (rule,)).select("page_id", (F.size("findings") > 0).alias("bad"))


@query(f"""WITH n AS (SELECT conv_id, turn, lower(trim(regexp_replace(text, '{SP}+', ' ', 'g'), ' ')) AS k FROM conversations)
SELECT a.conv_id, a.turn, a.k = coalesce(b.k, '') AND length(a.k) - length(replace(a.k, ' ', '')) + 1 >= 3 AS untranslated FROM n a LEFT JOIN n b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def untranslated(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target_text"))
    seg = c.join(nxt, ["conv_id", "turn"], "left").select("conv_id", "turn", F.col("text").alias("source_text"), F.coalesce("target_text", F.lit("")).alias("target_text"), F.lit("nl").alias("source_lang"), F.lit("TRANSLATE_LOCALIZE").alias("operation"), F.lit("paragraph").alias("block_type"))
    rule = next(r for r in rules.RULES if r.type == "untranslated")
    return rules.lint(seg, "de-DE", (rule,)).select("conv_id", "turn", (F.size("findings") > 0).alias("untranslated"))


@query("""SELECT doc_id, CASE WHEN contains(lower(text), ' the ') AND NOT (contains(lower(text), ' that ') OR contains(lower(text), ' with ')) THEN 'the' END AS missing FROM documents""")
def terminology(spark, sf_dir):
    """A source term needs one of its approved forms in the target."""
    low = F.lower("text")
    forms = F.array(F.lit(" that "), F.lit(" with "))
    missing = F.when(F.contains(low, F.lit(" the ")) & ~F.exists(forms, lambda f: F.contains(low, f)), "the")
    return table(spark, sf_dir, "documents").select("doc_id", missing.alias("missing"))


@query("SELECT doc_id, trim(text) <> '' AND doc_id % 4 = 0 AS empty FROM documents")
def empty_output(spark, sf_dir):
    seg = _pairs(spark, sf_dir).withColumn("target_text", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("target_text")))
    rule = next(r for r in rules.RULES if r.type == "empty_output")
    return rules.lint(seg, "de-DE", (rule,)).select("doc_id", (F.size("findings") > 0).alias("empty"))


_COMPOSED = """WITH t AS (SELECT doc_id, lang, text, length(text) - length(replace(text, 'ß', '')) AS sz, len(regexp_extract_all(text, '"([^"\\n]{1,300})"')) AS q, CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 0 END AS e FROM documents)""".replace("\\\\", "\\")


@query(_COMPOSED + """ SELECT doc_id, 'DECH-SZ-01' AS rule, sz::BIGINT AS n FROM t WHERE sz > 0 AND e = 0 UNION ALL SELECT doc_id, 'QUOTES', q FROM t WHERE q > 0 AND e = 0 UNION ALL SELECT doc_id, 'INTEGRITY-EMPTY', 1 FROM t WHERE e = 1 AND trim(text) <> ''""")
def lint(spark, sf_dir):
    """Several rules in one pass over each document, findings counted by rule."""
    mine = (next(r for r in rules.RULES if r.id == "DECH-SZ-01"), rules.Rule("QUOTES", "lexicon", "major", ((r'"([^"\n]{1,300})"', "«$1»"),), keep_case=False), next(r for r in rules.RULES if r.type == "empty_output"))
    seg = _pairs(spark, sf_dir).withColumn("target_text", F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("target_text")))
    counted = F.transform(F.array(*(F.lit(r.id) for r in mine)), lambda i: F.struct(i.alias("rule"), F.size(F.filter("findings", lambda f: f["rule"] == i)).cast("long").alias("n")))
    rows = rules.lint(seg, "de-CH", mine).select("doc_id", F.explode_outer(F.filter(counted, lambda c: c["n"] > 0)).alias("c")).where("c IS NOT NULL")
    return rows.select("doc_id", "c.rule", "c.n")


def _swiss(spark, sf_dir):
    """Line segments with the Swiss rule's findings, words and score."""
    rows = line_rows(spark, sf_dir)
    n = (F.length("text") - F.length(F.replace("text", F.lit("ß"), F.lit("")))).cast("long")
    raw = n * F.lit(25) + F.when(F.col("words") > 80, 5).otherwise(0)
    rows = rows.select("doc_id", "lang", "ord", "segment_id", "words", n.alias("critical"), F.when(F.col("words") > 80, 1).otherwise(0).cast("long").alias("major"), raw.cast("long").alias("raw"))
    p = scoring.penalty(F.col("raw"), F.col("words"))
    return rows.withColumn("penalty", p).withColumn("score", scoring.score(p))


_SWISS = LINES + """, w AS (SELECT doc_id, lang, ord, segment_id, words, (length(text) - length(replace(text, 'ß', '')))::BIGINT AS critical, CASE WHEN words > 80 THEN 1 ELSE 0 END::BIGINT AS major FROM segments),
s AS (SELECT *, (critical * 25 + major * 5)::BIGINT AS raw FROM w), p AS (SELECT *, floor(raw * 100.0::DOUBLE / greatest(words, 100) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS penalty FROM s),
q AS (SELECT *, floor(greatest(0.0::DOUBLE, 100.0::DOUBLE - penalty) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM p),
v AS (SELECT *, CASE WHEN critical > 0 OR score < 90 THEN 'FAIL' WHEN doc_id % 5 = 0 OR major > 0 THEN 'HUMAN_REVIEW' WHEN words < 4 THEN 'PASS_WITH_NOTES' ELSE 'PASS' END AS verdict FROM q)"""


def _judged(spark, sf_dir):
    v = scoring.verdict(F.lit("OK"), F.lit(True), F.col("score"), F.col("critical"), F.col("major"), F.lit(0), F.lit(0), F.col("doc_id") % 5 == 0, F.col("words") < 4)
    return _swiss(spark, sf_dir).withColumn("verdict", v)


@query(_SWISS + " SELECT doc_id, segment_id, raw FROM v WHERE raw > 0")
def raw_weight(spark, sf_dir):
    return _swiss(spark, sf_dir).where("raw > 0").select("doc_id", "segment_id", "raw")


@query(_SWISS + " SELECT doc_id, segment_id, penalty, score FROM v")
def segment_score(spark, sf_dir):
    return _swiss(spark, sf_dir).select("doc_id", "segment_id", "penalty", "score")


@query(_SWISS + " SELECT doc_id, segment_id, verdict FROM v")
def verdicts(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "segment_id", "verdict")


_LOCALE = _SWISS + """, g AS (SELECT lang, sum(raw)::BIGINT AS raw, sum(words)::BIGINT AS words, min(list_position(['FAIL','HUMAN_REVIEW','PASS_WITH_NOTES','PASS'], verdict)) AS worst, count(*) AS segments FROM v GROUP BY lang),
h AS (SELECT *, floor(raw * 100.0::DOUBLE / greatest(words, 100) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS penalty FROM g)"""


@query(_LOCALE + " SELECT lang, raw, words, segments, penalty, floor(greatest(0.0::DOUBLE, 100.0::DOUBLE - penalty) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS score FROM h")
def locale_score(spark, sf_dir):
    return scoring.locale_scores(_judged(spark, sf_dir), ["lang"]).select("lang", "raw", "words", "segments", "penalty", "score")


@query(_LOCALE + " SELECT lang, ['FAIL','HUMAN_REVIEW','PASS_WITH_NOTES','PASS'][worst] AS verdict FROM h")
def locale_verdict(spark, sf_dir):
    return scoring.locale_scores(_judged(spark, sf_dir), ["lang"]).select("lang", "verdict")


@query(_SWISS + " SELECT lang, count(*) FILTER (verdict = 'FAIL') AS fail, count(*) FILTER (verdict = 'HUMAN_REVIEW') AS review, count(*) FILTER (verdict = 'PASS_WITH_NOTES') AS notes, count(*) FILTER (verdict = 'PASS') AS pass, count(DISTINCT doc_id) AS docs FROM v GROUP BY lang")
def locale_counts(spark, sf_dir):
    n = lambda v: F.count_if(F.col("verdict") == v)
    return _judged(spark, sf_dir).groupBy("lang").agg(n("FAIL").alias("fail"), n("HUMAN_REVIEW").alias("review"), n("PASS_WITH_NOTES").alias("notes"), n("PASS").alias("pass"), F.countDistinct("doc_id").alias("docs"))


@query(_SWISS + " SELECT doc_id, sum(critical)::BIGINT AS critical, sum(major)::BIGINT AS major FROM v GROUP BY doc_id")
def open_counts(spark, sf_dir):
    return _judged(spark, sf_dir).groupBy("doc_id").agg(F.sum("critical").alias("critical"), F.sum("major").alias("major"))


@query(_SWISS + """, r AS (SELECT doc_id, unnest(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'LEGAL_PAGE' END, CASE WHEN major > 0 THEN 'MAJOR' END, CASE WHEN critical > 0 THEN 'CRITICAL' END], lambda x: x IS NOT NULL)) AS reason FROM v)
SELECT reason, count(*) AS n, reason || ' (' || count(*) || CASE WHEN count(*) = 1 THEN ' segment)' ELSE ' segments)' END AS shown FROM r GROUP BY reason""")
def reason_counts(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("doc_id") % 5 == 0, "LEGAL_PAGE"), F.when(F.col("major") > 0, "MAJOR"), F.when(F.col("critical") > 0, "CRITICAL")))
    rows = _judged(spark, sf_dir).select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return rows.withColumn("shown", F.concat("reason", F.lit(" ("), F.col("n").cast("string"), F.when(F.col("n") == 1, " segment)").otherwise(" segments)")))


@query(_SWISS + """, r AS (SELECT doc_id, list_distinct(list_filter([CASE WHEN doc_id % 5 = 0 THEN 'LEGAL_PAGE' END, CASE WHEN major > 0 THEN 'MAJOR' END, CASE WHEN critical > 0 THEN 'CRITICAL' END], lambda x: x IS NOT NULL)) AS rs FROM v), e AS (SELECT DISTINCT doc_id, unnest(rs) AS reason FROM r)
SELECT doc_id, string_agg(reason, ',' ORDER BY reason) AS reasons FROM e GROUP BY doc_id""")
def distinct_reasons(spark, sf_dir):
    reasons = F.array_compact(F.array(F.when(F.col("doc_id") % 5 == 0, "LEGAL_PAGE"), F.when(F.col("major") > 0, "MAJOR"), F.when(F.col("critical") > 0, "CRITICAL")))
    return _judged(spark, sf_dir).select("doc_id", F.explode(reasons).alias("reason")).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


@query(_SWISS + " SELECT 'F-' || lang || '-' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END AS finding_id, doc_id, segment_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, ord) AS n FROM v WHERE critical > 0)")
def finding_ids(spark, sf_dir):
    """Findings numbered within each locale, documents in order."""
    rows = reporting.numbered(_judged(spark, sf_dir).where("critical > 0").select("lang", "doc_id", "ord", "segment_id"), "lang", "doc_id", "ord")
    n = F.col("n").cast("string")
    return rows.select(F.concat(F.lit("F-"), "lang", F.lit("-"), F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)).alias("finding_id"), "doc_id", "segment_id")


@query(_SWISS + " SELECT doc_id, segment_id, critical FROM v WHERE critical > 0 ORDER BY critical DESC, doc_id, ord LIMIT 25")
def top_findings(spark, sf_dir):
    """The 25 segments with most critical findings; each task keeps 25 rows."""
    return _judged(spark, sf_dir).where("critical > 0").orderBy(F.desc("critical"), "doc_id", "ord").limit(25).select("doc_id", "segment_id", "critical")


@query("""WITH x AS (SELECT doc_id, regexp_extract_all(text, '[0-9]+') AS h FROM documents)
SELECT doc_id, CASE WHEN len(h) = 1 THEN h[1] ELSE len(h) || ' findings: ' || array_to_string(h[1:3], ' ') || CASE WHEN len(h) > 3 THEN ' …' ELSE '' END END AS note FROM x WHERE len(h) > 0""")
def check_notes(spark, sf_dir):
    """A check's note: the number of findings and the first three."""
    h = F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0))
    rows = table(spark, sf_dir, "documents").select("doc_id", h.alias("h")).where(F.size("h") > 0)
    note = F.concat(F.size("h").cast("string"), F.lit(" findings: "), F.array_join(F.slice("h", 1, 3), " "), F.when(F.size("h") > 3, " …").otherwise(""))
    return rows.select("doc_id", F.when(F.size("h") == 1, F.element_at("h", 1)).otherwise(note).alias("note"))


@query(r"""WITH x AS (SELECT doc_id, text, replace(text, '7', '8') AS target FROM documents),
a AS (SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]+')) AS k, 1 AS s, 0 AS t FROM x UNION ALL SELECT doc_id, unnest(regexp_extract_all(target, '[0-9]+')), 0, 1 FROM x),
g AS (SELECT doc_id, k, sum(s) AS s, sum(t) AS t FROM a GROUP BY ALL)
SELECT doc_id, sum(greatest(s - t, 0))::BIGINT AS missing, sum(greatest(t - s, 0))::BIGINT AS extra FROM g GROUP BY doc_id""")
def entity_match(spark, sf_dir):
    """What a target lost or made up of its source's figures, as multisets: each document against a copy whose sevens became eights."""
    docs = table(spark, sf_dir, "documents")
    figures = lambda text: docs.select("doc_id", F.explode(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0))).alias("k"))
    g = entities.match_counts(figures(F.col("text")), figures(F.replace("text", F.lit("7"), F.lit("8"))), ["doc_id"])
    return g.groupBy("doc_id").agg(F.sum("missing").alias("missing"), F.sum("extra").alias("extra"))


@query()
def extract_entities(spark, sf_dir):
    """Entities of every document, all kinds."""
    return entities.entity_rows(table(spark, sf_dir, "documents"))


@query()
def entity_counts(spark, sf_dir):
    return entities.entity_rows(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("raw").alias("distinct"))
