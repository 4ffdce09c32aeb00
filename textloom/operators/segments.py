"""Documents to segments: text blocks, identifiers, hashes, translatability, page class and locale. Narrow plans: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import locales as L
from ..functions import text as T

#: Patterns that make a page a legal one, for its address and for its title.
LEGAL_URL = (
    r"(?i)(^|[/_.-])(privacy|privacyverklaring|privacybeleid|privacy-policy|privacy-statement|privacy-notice|datenschutz[a-z]*|impressum|agb|algemene-voorwaarden|voorwaarden|disclaimer|colofon"
    r"|terms|terms-and-conditions|terms-of-use|terms-of-service|legal|legal-notice|cookie|cookies|cookie-policy|gdpr|avg|informativa|note-legali|condizioni-generali)([/_.-]|$)"
)
LEGAL_TITLE = r"(?i)\b(privacy( policy| statement| notice)?|algemene voorwaarden|terms (and|&) conditions|terms of (use|service)|impressum|datenschutz\w*|cookie(beleid| policy| statement)|disclaimer|informativa)\b"


def text_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, n_blocks, block_type, text): blank lines part blocks, a block's lines join by spaces; a short first line alone is a heading."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\x{feff}", ""), "\r\n?", "\n")
    line = lambda x: F.trim(T.collapse_space(x))
    chunks = F.transform(F.split(clean, "\n[ \t]*\n"), lambda c: F.filter(F.transform(F.split(c, "\n"), line), lambda x: x != ""))
    chunks = F.filter(chunks, lambda c: F.size(c) > 0)
    rows = docs.select("doc_id", chunks.alias("chunks")).select("doc_id", F.size("chunks").cast("long").alias("n_blocks"), F.posexplode_outer("chunks").alias("pos", "lines")).where("pos IS NOT NULL")
    joined = F.array_join("lines", " ")
    heading = (F.col("pos") == 0) & (F.col("n_blocks") > 1) & (F.size("lines") == 1) & (F.length(joined) <= 80) & ~joined.rlike("[.!?:;,…]$")
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "n_blocks", F.when(heading, "heading").otherwise("paragraph").alias("block_type"), T.escape_literal(joined).alias("text"))


def line_segments(docs: DataFrame) -> DataFrame:
    """One paragraph for each line that isn't blank, for corpora whose lines are paragraphs: (doc_id, ord, segment_id, block_type, text, hash)."""
    rows = docs.select("doc_id", F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(T.collapse_space(x))), lambda x: x != "").alias("x"))
    rows = rows.select("doc_id", F.posexplode_outer("x").alias("pos", "text")).where("pos IS NOT NULL")
    return seal(rows.withColumn("block_type", F.lit("paragraph")))


def seal(blocks: DataFrame) -> DataFrame:
    """Blocks (doc_id, pos, block_type, text) with ord, segment_id and hash. Positions count all blocks of a document from 0, so no window is needed."""
    prefix = F.create_map(*(F.lit(x) for kv in L.PREFIXES.items() for x in kv))
    n = (F.col("pos") + 1).cast("string")
    number = F.when(F.length(n) < 3, F.lpad(n, 3, "0")).otherwise(n)
    return blocks.select("doc_id", (F.col("pos") + 1).cast("long").alias("ord"), F.concat_ws("-", F.element_at(prefix, F.col("block_type")), number).alias("segment_id"), "block_type", "text", T.text_hash(F.col("text")).alias("hash"))


def document_ids(segments: DataFrame, kind: str = "text") -> DataFrame:
    """(doc_id, doc_key): a key from the origin and every segment's id and hash, in order."""
    parts = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(":", "segment_id", "hash").alias("x")))).alias("p"))
    body = F.array_join(F.concat(F.array(F.lit(kind), F.col("doc_id").cast("string")), F.transform("p", lambda s: s["x"])), "\n")
    return parts.select("doc_id", F.concat(F.lit("doc-"), T.text_hash(body)).alias("doc_key"))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def title_head(title: Column) -> Column:
    """A title without the brand after a separator."""
    return F.trim(F.split(title, r"\s+[|–—·•-]\s+|\s*\|\s*")[0])


def usable_slug(slug: Column) -> Column:
    return (slug != "") & ~slug.rlike("^[0-9]+$") & ~slug.rlike("(?i)^(index|default|home|start|main)$")


def source_slug(url: Column, title: Column) -> Column:
    """Slug words: of the URL, else of the title's head, eight at most; null if neither is usable."""
    words = F.filter(F.split(F.lower(title_head(title)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    a, b = T.slug_words(url), F.array_join(F.slice(words, 1, 8), " ")
    return F.when(usable_slug(a), a).when(usable_slug(b), b)


def classify(url: Column, title: Column, h1: Column) -> tuple[Column, Column]:
    """(page_type, evidence): a legal address, then a legal title, then a legal heading; else content."""
    path = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), F.lit("+"), F.lit("%2B"))), url)
    hit = lambda c, p: F.regexp_replace(F.regexp_extract(c, p, 0), r"^[/_.-]+|[/_.-]+$", "")
    kind = F.when(path.rlike(LEGAL_URL) | title.rlike(LEGAL_TITLE) | h1.rlike(LEGAL_TITLE), "LEGAL").otherwise("CONTENT")
    why = F.when(path.rlike(LEGAL_URL), F.concat(F.lit("url:"), hit(path, LEGAL_URL))).when(title.rlike(LEGAL_TITLE), F.concat(F.lit("title:"), hit(title, LEGAL_TITLE))).when(h1.rlike(LEGAL_TITLE), F.concat(F.lit("h1:"), hit(h1, LEGAL_TITLE))).otherwise("none")
    return kind, why


def locale_tag(tag: Column) -> tuple[Column, Column]:
    """(language, region) of a locale tag; nulls for what is none."""
    t = F.trim(F.replace(tag, F.lit("_"), F.lit("-")))
    good = t.rlike(r"(?i)^[a-z]{2,3}(-|$)") & ~t.rlike(r"(?i)^x-")
    region = F.regexp_extract(t, r"(?i)^[a-z]{2,3}(?:-(?!x-)[a-z0-9]{3,8})*-([a-z]{2})(?:-|$)", 1)
    return F.when(good, F.lower(F.split_part(t, F.lit("-"), F.lit(1)))), F.when(good & (region != ""), F.upper(region))


def source_locale(lang: Column, html_lang: Column, url: Column) -> Column:
    """The page's own attribute if it agrees with the text, with the region that a country domain tells, else from the domain alone."""
    a_lang, a_region = locale_tag(html_lang)
    tld = F.lower(F.substring_index(F.regexp_extract(url, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1), ".", -1))
    hints = F.create_map(*(F.lit(x) for (a, b), r in L.REGION_HINTS.items() for x in (f"{a}|{b}", r)))
    hint = lambda x: F.try_element_at(hints, F.concat_ws("|", x, tld))
    whole = lambda x, r: F.when(r.isNotNull(), F.concat_ws("-", x, r)).when(x == "nl", "nl-NL").otherwise(F.concat(x, F.lit("-*")))
    agrees = a_lang.isNotNull() & ((lang == "und") | (a_lang == lang))
    return F.when(agrees, whole(a_lang, F.coalesce(a_region, hint(a_lang)))).when(lang == "und", "und").otherwise(whole(lang, hint(lang)))


def first_by(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rn") -> DataFrame:
    """The first row of each key: ranking is limited before the shuffle as well as after it."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) == 1).drop(name)
