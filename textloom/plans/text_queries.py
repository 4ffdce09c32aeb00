"""Text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from .registry import SP, TOKEN, query, table

#: Texts with inline placeholders, made alike in both engines.
_MARKED = "replace(replace(replace(text, ' the ', ' <a1>the</a1> '), ' of ', ' of<br2/> '), ' and ', ' &lt;and&gt; ')"
_TARGET = "replace(replace(text, ' the ', ' <a1>the '), ' of ', ' of<br2/><br2/> ')"
_PLAIN = f"replace(replace(regexp_replace({_MARKED}, '{TOKEN}', '', 'g'), '&lt;', '<'), '&gt;', '>')"
_NORM = rf"trim(regexp_replace(text, '{SP}+', ' ', 'g'), ' ')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _marked():
    return F.expr(_MARKED)


@query("SELECT doc_id, substring(sha1(text), 1, 12) AS hash FROM documents")
def text_hash(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.text_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, CASE WHEN {_NORM} = '' THEN 0 ELSE length({_NORM}) - length(replace({_NORM}, ' ', '')) + 1 END AS words FROM documents")
def word_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id, length({_PLAIN}) AS chars FROM documents")
def char_length(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.char_length(_marked()).alias("chars"))


@query(rf"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[\x{{00ad}}\x{{200b}}\x{{2060}}\x{{feff}}]', '', 'g'), '{SP}+', ' ', 'g')) AS digest FROM documents")
def collapse_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.collapse_space(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, md5({_NORM}) AS digest FROM documents")
def normalize_space(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.normalize_space(F.col("text"))).alias("digest"))


@query(f"SELECT doc_id, len(regexp_extract_all({_MARKED}, '{TOKEN}')) AS tokens, md5(array_to_string(regexp_extract_all({_MARKED}, '{TOKEN}'), ',')) AS digest FROM documents")
def inline_tokens(spark, sf_dir):
    x = T.inline_tokens(_marked())
    return _docs(spark, sf_dir).select("doc_id", F.size(x).cast("long").alias("tokens"), F.md5(F.array_join(x, ",")).alias("digest"))


@query(f"SELECT doc_id, md5({_PLAIN}) AS digest FROM documents")
def plain_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.plain_text(_marked())).alias("digest"))


@query("SELECT doc_id, md5(replace(replace(text, '<', '&lt;'), '>', '&gt;')) AS digest FROM documents")
def escape_literal(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.escape_literal(F.col("text"))).alias("digest"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS digest FROM pages""")
def escape_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.escape_html_attr(F.col("html"))).alias("digest"))


_NAMES = "list_sort(list_transform(regexp_extract_all({0}, '" + TOKEN + "'), lambda t: (CASE WHEN contains(t, '/>') THEN 'self:' WHEN starts_with(t, '</') THEN 'close:' ELSE 'open:' END) || regexp_replace(t, '[</>]', '', 'g')))"


@query(f"SELECT doc_id, md5(array_to_string({_NAMES.format(_MARKED)}, ',')) AS digest FROM documents")
def tag_signature(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(F.array_join(T.signature(_marked()), ",")).alias("digest"))


@query(f"""WITH t AS (SELECT doc_id, {_NAMES.format(_MARKED)} AS a, {_NAMES.format(_TARGET)} AS b FROM documents),
x AS (SELECT doc_id, unnest(a) AS k, 1 AS n, 0 AS m FROM t UNION ALL SELECT doc_id, unnest(b), 0, 1 FROM t),
g AS (SELECT doc_id, k, sum(n) AS n, sum(m) AS m FROM x GROUP BY doc_id, k)
SELECT t.doc_id, coalesce(sum(greatest(n - m, 0)), 0)::BIGINT AS missing, coalesce(sum(greatest(m - n, 0)), 0)::BIGINT AS extra FROM t LEFT JOIN g USING (doc_id) GROUP BY t.doc_id""")
def tag_diff(spark, sf_dir):
    """Placeholders of the source that the target lost, and those it made up, counted as multisets in the row itself."""
    rows = _docs(spark, sf_dir).select("doc_id", T.signature(_marked()).alias("a"), T.signature(F.expr(_TARGET)).alias("b"))
    return rows.select("doc_id", F.size(T.multiset_minus(F.col("a"), F.col("b"))).cast("long").alias("missing"), F.size(T.multiset_minus(F.col("b"), F.col("a"))).cast("long").alias("extra"))


_FIRST = r"regexp_extract(text, '[\p{L}]+', 0)"


@query(f"""SELECT doc_id, CASE WHEN {_FIRST} = '' THEN 'ersatz' WHEN length({_FIRST}) > 1 AND {_FIRST} = upper({_FIRST}) AND {_FIRST} <> lower({_FIRST}) THEN 'ERSATZ'
WHEN substring({_FIRST}, 1, 1) = upper(substring({_FIRST}, 1, 1)) AND substring({_FIRST}, 1, 1) <> lower(substring({_FIRST}, 1, 1)) THEN 'Ersatz' ELSE 'ersatz' END AS word FROM documents""")
def match_case(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.match_case(F.regexp_extract("text", r"[\p{L}]+", 0), F.lit("ersatz")).alias("word"))


def _slug_sql(c: str) -> str:
    s = f"lower({c})"
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        s = f"replace({s}, '{a}', '{b}')"
    s = f"regexp_replace(translate({s}, '{T.MARKED}', '{T.PLAIN}'), '[''’`´]', '', 'g')"
    return f"regexp_replace(regexp_replace({s}, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


_TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'), ' ')"


@query(f"SELECT page_id, {_slug_sql(_TITLE)} AS slug FROM pages")
def slugify(spark, sf_dir):
    from ..functions.locales import UMLAUTS
    from ..operators.segments import page_title

    return table(spark, sf_dir, "pages").select("page_id", T.slugify(page_title(F.col("html")), UMLAUTS).alias("slug"))


@query("SELECT page_id, regexp_matches(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^.*/', ''), '^[a-z0-9]+(-[a-z0-9]+)*$') AS valid FROM pages")
def valid_slug(spark, sf_dir):
    last = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^.*/", "")
    return table(spark, sf_dir, "pages").select("page_id", T.is_slug(last).alias("valid"))


_LAST = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/]*', ''), '/+$', ''), '^.*/', '')"


@query(rf"SELECT page_id, lower(trim(regexp_replace(regexp_replace(url_decode({_LAST}), '(?i)\.[a-z0-9]{{2,5}}$', ''), '[-_+]+', ' ', 'g'), ' ')) AS words FROM pages")
def slug_words(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.slug_words(F.col("url")).alias("words"))


@query("""WITH t AS (SELECT doc_id, regexp_split_to_array(text, '[0-9]+') AS g, regexp_extract_all(text, '[0-9]+') AS h FROM documents),
x AS (SELECT doc_id, unnest(h) AS m, unnest(g[:len(h)]) AS gap, generate_subscripts(h, 1) AS i FROM t)
SELECT doc_id, (sum(length(gap) + length(m)) OVER w - length(m))::BIGINT AS start, (sum(length(gap) + length(m)) OVER w)::BIGINT AS "end", m AS match FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def match_spans(spark, sf_dir):
    """All numbers with their places: an array in each row, exploded, with no shuffle."""
    return _docs(spark, sf_dir).select("doc_id", F.explode_outer(T.match_spans(F.col("text"), "[0-9]+")).alias("s")).where("s IS NOT NULL").select("doc_id", "s.*")


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


_TAGS = "CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN lang || '-' || upper(lang) WHEN 1 THEN upper(lang) || '_at' WHEN 2 THEN lang || '-Latn-CH' WHEN 3 THEN lang WHEN 4 THEN 'x-default' END"


@query(f"""WITH t AS (SELECT doc_id, {_TAGS} AS tag FROM documents)
SELECT doc_id, tag, lower(split_part(replace(tag, '_', '-'), '-', 1)) AS language, nullif(upper(regexp_extract(replace(tag, '_', '-'), '^[A-Za-z]{{2,3}}(?:-[A-Za-z]{{4}})?-([A-Za-z]{{2}})(?:-|$)', 1)), '') AS region FROM t""")
def lang_region(spark, sf_dir):
    rows = _docs(spark, sf_dir).select("doc_id", F.expr(_TAGS).alias("tag"))
    return rows.select("doc_id", "tag", T.language_of(F.col("tag")).alias("language"), T.region_of(F.col("tag")).alias("region"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'seen [HYPOTHESIS]' ELSE event_type || ' [EVIDENCE: EV-' || user_id || ']' END AS note FROM events""")
def evidence_tag(spark, sf_dir):
    note = F.when(F.col("event_type") == "click", "seen [HYPOTHESIS]").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", T.ensure_tagged(note, T.evidence_tag(F.concat(F.lit("EV-"), F.col("user_id").cast("string")))).alias("note"))


def _redact_sql(c: str) -> str:
    for p in T.SECRETS:
        p = p.replace("'", "''")
        c = f"regexp_replace({c}, '{p}', '[REDACTED]', 'g')"
    return c


@query(f"SELECT doc_id, md5({_redact_sql('replace(text, $$secret phrase$$, $$[REDACTED]$$)')}) AS digest, contains({_redact_sql('text')}, '[REDACTED]') AS redacted FROM documents")
def redact(spark, sf_dir):
    x = T.redact(F.col("text"), ("secret phrase",))
    return _docs(spark, sf_dir).select("doc_id", F.md5(x).alias("digest"), F.contains(x, F.lit("[REDACTED]")).alias("redacted"))


@query(r"""SELECT doc_id, md5(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '\s*[\r\n]+\s*', ' ', 'g'), '\\([!-/:-@\[-`{-~])', '\\\\\1', 'g'), '&lt;|<', '\\<', 'g'), '|', '\|'), '[', '\['), ']', '\]')) AS digest FROM documents""")
def md_escape(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.escape_markdown(F.col("text"), cell=True, brackets=True)).alias("digest"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text WHEN doc_id % 3 = 1 THEN '-' || text ELSE text END AS c FROM documents),
g AS (SELECT doc_id, CASE WHEN regexp_matches(c, '^[=+\-@\t\r]') THEN ' ' || c ELSE c END AS c FROM t)
SELECT doc_id, md5(CASE WHEN length(c) > 32000 THEN substring(c, 1, 32000) || '… [truncated, ' || (length(c) - 32000) || ' more characters]' ELSE c END) AS digest FROM g""")
def formula_guard(spark, sf_dir):
    c = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), F.col("text"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("-"), F.col("text"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(T.clamp_cell(T.guard_formula(c))).alias("digest"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' UTC' AS shown FROM events")
def fmt_ts(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")).alias("shown"))


@query(r"SELECT page_id, len(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda u: regexp_matches(lower(regexp_replace(u, '[\x00-\x20\x{007f}]', '', 'g')), '^(javascript|vbscript|data):'))) AS unsafe, len(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS links FROM pages".replace('\\"', '"'))
def unsafe_links(spark, sf_dir):
    urls = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(F.filter(urls, T.unsafe_url)).cast("long").alias("unsafe"), F.size(urls).cast("long").alias("links"))


@query(r"""SELECT doc_id, len(list_filter(string_split(trim(regexp_replace(text, '\s+', ' ', 'g'), ' '), ' '), lambda x: length(x) <= 256 AND NOT regexp_matches(x, '(?i)^[("''\[<]*(https?://|www\.)') AND NOT regexp_matches(x, '^[^@]+@[^@]+\.[^@]+$')
 AND len(list_filter(regexp_split_to_array(x, '[^\p{L}\p{N}°³²µ%/''’-]+'), lambda t: regexp_matches(t, '^\p{L}{3,}$') AND NOT list_contains(['bar', 'kpa'], lower(t)))) > 0)) > 0 AS translatable FROM documents""")
def translatable(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.natural_language(F.col("text"), ("bar", "kPa")).alias("translatable"))


_W = rf"list_filter(list_transform(flatten(list_transform(list_filter(string_split({_NORM}, ' '), lambda x: x <> '' AND length(x) <= 256 AND NOT regexp_matches(x, '(?i)://|^www\.|@')), lambda x: regexp_split_to_array(x, '[^\p{{L}}\p{{N}}''’-]+'))), lambda x: regexp_replace(x, '^[''’-]+|[''’-]+$', '', 'g')), lambda w: length(w) BETWEEN 2 AND 64 AND regexp_matches(w, '^\p{{L}}+(?:[''’-]\p{{L}}+)*$'))"


@query(f"SELECT doc_id, len({_W}) AS words, md5(array_to_string({_W}, ' ')) AS digest FROM documents")
def letters_words(spark, sf_dir):
    w = T.letters_words(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(w).cast("long").alias("words"), F.md5(F.array_join(w, " ")).alias("digest"))


_F1 = r"""WITH p AS (SELECT c1.conv_id, c1.turn, c1.text AS a, c2.text AS b FROM conversations c1 JOIN conversations c2 ON c1.conv_id = c2.conv_id AND c2.turn = c1.turn + 1),
x AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(a), '[\p{L}\p{N}]+')) AS w, 1 AS n, 0 AS m FROM p UNION ALL SELECT conv_id, turn, unnest(regexp_extract_all(lower(b), '[\p{L}\p{N}]+')), 0, 1 FROM p),
g AS (SELECT conv_id, turn, w, sum(n) AS n, sum(m) AS m FROM x GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(least(n, m)) AS o, sum(n) AS n, sum(m) AS m FROM g GROUP BY ALL)
SELECT p.conv_id, p.turn, CASE WHEN coalesce(o, 0) = 0 THEN 0.0::DOUBLE ELSE floor(2.0::DOUBLE * o / (n + m) * 10000.0::DOUBLE + 0.5::DOUBLE) / 10000.0::DOUBLE END AS f1 FROM p LEFT JOIN s USING (conv_id, turn)"""


@query(_F1)
def token_f1(spark, sf_dir):
    """Each turn against the next one, as a back-translation is held against its source."""
    c = table(spark, sf_dir, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b"))
    return c.join(nxt, ["conv_id", "turn"]).select("conv_id", "turn", T.round_half_up(T.token_f1(F.col("text"), F.col("b")), 4).alias("f1"))
