"""One query for each corpus operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, embed, html_main, jaccard, lines, packing, pii, tokens, toxic, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_shards(_table(spark, sf_dir, "documents")).drop("shard")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(_table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxic.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"), "score", "predicted")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(_table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.duplicate_lines(_table(spark, sf_dir, "documents"), lines.a_fifth).drop("dh")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))[0].drop("url")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_packing, op2_token_shards, op3_personal_data, op4_embedding_dedup, op5_toxicity, op6_decontamination, op7_main_text, op8_line_dedup, op9_ngram_jaccard, op10_warc, pipeline)}
_LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: Classes of links (a, b), both ways, over nodes (id): the smallest id that each reaches.
_CLASSES = """reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT links.a, reach.c FROM reach JOIN links ON links.b = reach.id AND reach.c < links.a), classes AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""

ORACLE_SQL: dict[str, str] = {
    "op4_embedding_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings),
real AS (SELECT id, e FROM nodes WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT x.id AS a, y.id AS b FROM real x JOIN real y ON x.id <> y.id AND len(x.e) = len(y.e) AND list_cosine_similarity(x.e, y.e) >= 0.95), {_CLASSES}
SELECT nodes.id AS vec_id, (SELECT count(*) FROM links WHERE a = nodes.id) AS n_links, component_id, nodes.id = component_id AS kept FROM nodes JOIN classes USING (id)""",
    "op6_decontamination": rf"""WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOW.format('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array({_LOW.format('text')}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
k AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
t AS (SELECT item_id, k, i AS j, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM k)),
s AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, (SELECT DISTINCT k FROM k) WHERE len(w) >= k)),
m AS (SELECT doc_id, s.k, i, j, item_id FROM s JOIN t ON s.k = t.k AND s.win = t.win),
r AS (SELECT doc_id, item_id::VARCHAR AS id, min(i) - 1 AS p, count(*) + k - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, k, i - j ORDER BY i) AS g FROM m) GROUP BY doc_id, item_id, k, i - j, g),
l AS (SELECT doc_id, max(n) AS n, first(id ORDER BY n DESC, id, p) AS id, first(p ORDER BY n DESC, id, p) AS p FROM r GROUP BY doc_id),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(g.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(l.n, 0) AS longest_words, l.id AS longest_item_id, l.p AS longest_at, coalesce(h.n, 0) > 0 AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN l USING (doc_id)""",
    # The tables' pages have one layout, whose article SQL can cut out.
    "op7_main_text": r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '(?s)<article>(.*?)</article>', 1) AS t FROM pages),
p AS (SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(regexp_replace(replace(t, '<br>', ' '), '</?b>', '', 'g'), '</?(p|h1)>'), lambda x: trim(regexp_replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS x FROM a)
SELECT page_id, url, array_to_string(x, chr(10)) AS text, length(array_to_string(x, chr(10))) AS n_chars FROM p""",
    "op9_ngram_jaccard": rf"""WITH RECURSIVE nodes AS (SELECT doc_id AS id, list_filter(regexp_split_to_array({_LOW.format('text')}, '[ \x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM nodes WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id), o AS (SELECT x.id AS a, y.id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.id <> y.id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE 100 * o >= 85 * (na.n + nb.n - o)), {_CLASSES}
SELECT nodes.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM nodes JOIN classes USING (id) LEFT JOIN n USING (id)""",
    "op10_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages), f AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) || '00' AS h, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((instr('0123456789abcdef', substring(h, (5 * i) // 4 + 1, 1)) - 1) * 256 + (instr('0123456789abcdef', substring(h, (5 * i) // 4 + 2, 1)) - 1) * 16 + instr('0123456789abcdef', substring(h, (5 * i) // 4 + 3, 1)) - 1) // (1 << (7 - (5 * i) % 4)::INT)) % 32 + 1)::INT, 1)), '') AS payload_digest,
CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
}
