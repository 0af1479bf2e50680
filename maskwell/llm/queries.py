"""The operators' queries over whole tables, at production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwell.llm import chat, decontaminate, html_text, jpeg, language_id, mixing, near_dedup, quality, sharding, warc
from maskwell.llm._shared import crc_mod, table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(crc_mod("doc_id", 5) != 0)
    model = quality.train(labels.join(docs.select("doc_id"), "doc_id", "left_semi"), texts=docs)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.store_and_describe(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(crc_mod("doc_id", 4) != 2))
    found = language_id.identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotations(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).drop("text")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.round_trip(pages).drop("payload")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, num=85, den=100)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_quality, op3_media, op4_mixing, op5_language, op6_chat, op7_warc, op8_html, op9_near_dedup, op10_decontamination, pipeline,
    )
}


def _op1_sql() -> str:
    owners = "".join(f"{x:02x}" for x in sharding.lookup_table())
    return f"""
WITH t AS (SELECT '{owners}' AS owners),
s AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS} AS slot FROM documents)
SELECT doc_id, slot, ('0x' || substr(owners, 2 * slot::INT + 1, 2))::INT AS shard FROM s, t"""


_OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS key
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 3 / 2 AS budget,
         coalesce(sum(2 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS capped,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open
  FROM s WINDOW o AS (ORDER BY (2 * source_size)::DOUBLE / weight, source NULLS LAST)),
l AS (SELECT first((budget - capped) / open ORDER BY capped, (budget - capped) / open) FILTER ((budget - capped) / open * weight <= cap) AS level FROM r),
g AS (SELECT source, source_size, coalesce(least(cap::DOUBLE, level * weight), cap::DOUBLE) AS target FROM r, l),
p AS (
  SELECT d.*, source_size, target, floor(target)::BIGINT AS budget,
         (coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (budget // greatest(source_size, 1) * size + greatest(0, least(size, budget % greatest(source_size, 1) - before)))::BIGINT AS taken
FROM p"""

_OP6_SQL = r"""
WITH RECURSIVE lines AS (
  SELECT conv_id, turn, i, regexp_extract(x, '^(?:[ \t]*>)+') AS marks, x
  FROM (SELECT conv_id, turn, unnest(regexp_split_to_array(coalesce(text, ''), '\r?\n')) AS x,
               generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\r?\n'), 1) AS i FROM conversations)),
levels AS (
  SELECT conv_id, turn, i, length(regexp_replace(marks, '[ \t]', '', 'g')) AS level,
         regexp_replace(regexp_replace(substr(x, length(marks) + 1), '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS line FROM lines),
steps AS (
  SELECT *, CASE WHEN level IS DISTINCT FROM lag(level) OVER w THEN 1 ELSE 0 END AS fresh FROM levels WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
runs AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) AS ord FROM steps),
passages AS (
  SELECT conv_id, turn, ord, min(level) AS level,
         trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM runs GROUP BY ALL),
quotes AS (SELECT * FROM passages WHERE level > 0 AND norm <> ''),
units AS (
  SELECT conv_id, turn, norm FROM passages WHERE level = 0
  UNION ALL SELECT conv_id, turn, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') FROM levels WHERE level = 0
  UNION ALL SELECT conv_id, turn, trim(regexp_replace(lower(string_agg(line, ' ' ORDER BY i)), '[\x20\x09-\x0D]+', ' ', 'g'), ' ')
            FROM levels WHERE level = 0 GROUP BY conv_id, turn),
originals AS (SELECT conv_id, norm, min(turn) AS origin FROM units WHERE norm <> '' GROUP BY conv_id, norm),
found AS (SELECT q.*, origin FROM quotes q JOIN originals o USING (conv_id, norm) WHERE origin < turn),
links AS (
  SELECT conv_id, turn, first(origin ORDER BY level, ord, origin) AS reply_to, count(*) AS linked FROM found GROUP BY conv_id, turn),
walk AS (
  SELECT conv_id, turn, reply_to AS up, 1 AS depth FROM links
  UNION ALL SELECT w.conv_id, w.turn, l.reply_to, w.depth + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.turn = w.up),
roots AS (SELECT conv_id, turn, min(up) AS root_turn, max(depth) AS depth FROM walk GROUP BY conv_id, turn),
bodies AS (
  SELECT conv_id, turn, string_agg(line, chr(10) ORDER BY i) FILTER (level = 0) AS stripped, bool_or(level > 0) AS quoting FROM levels GROUP BY conv_id, turn),
counts AS (SELECT conv_id, turn, count(*) AS quotes FROM quotes GROUP BY conv_id, turn),
final AS (
  SELECT c.conv_id, c.turn, c.role,
         regexp_replace(regexp_replace(CASE WHEN quoting THEN coalesce(stripped, '') ELSE replace(coalesce(c.text, ''), chr(13) || chr(10), chr(10)) END,
           '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS content,
         coalesce(quotes, 0)::BIGINT AS quotes, coalesce(linked, 0)::BIGINT AS linked, reply_to, coalesce(root_turn, c.turn)::BIGINT AS root_turn,
         coalesce(depth, 0)::BIGINT AS depth
  FROM conversations c LEFT JOIN bodies USING (conv_id, turn) LEFT JOIN counts USING (conv_id, turn)
  LEFT JOIN links USING (conv_id, turn) LEFT JOIN roots USING (conv_id, turn))
SELECT *, '<|' || coalesce(role, 'user') || '|>' || chr(10) || content || '<|end|>' AS formatted FROM final"""

_OP7_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS head FROM p)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM head THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM head THEN head END AS refers_to
FROM h"""

_OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
n AS (SELECT doc_id, len(shingles)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT u, v FROM pairs JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * c >= 85 * (a.n + b.n - c)),
reach AS (SELECT u, v FROM links UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least_of AS (SELECT u, min(v) AS m FROM reach GROUP BY u)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m, n.doc_id)) AS component_id, n.doc_id <= coalesce(m, n.doc_id) AS kept
FROM n LEFT JOIN least_of ON u = n.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": _op1_sql(), "op4_mixing": _OP4_SQL, "op6_chat": _OP6_SQL, "op7_warc": _OP7_SQL, "op9_near_dedup": _OP9_SQL}
