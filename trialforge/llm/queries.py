"""Queries over the driver's tables, one per operator, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, fingerprint, katz, neardup, piece_bpe, quality, shard, substring, trie_tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op1_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, len(ws) AS n, ws, unnest(range(1, len(ws) - 33)) AS s FROM w WHERE len(ws) >= 35),
k AS (SELECT doc_id, s, hash(ws[s : s + 34]) AS h, md5(array_to_string(ws[s : s + 34], ' ')) AS m FROM g),
d AS (SELECT h, m FROM k GROUP BY h, m HAVING count(*) > 1),
hit AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS p FROM k JOIN d USING (h, m)),
l AS (SELECT doc_id, list(p) AS ps FROM hit GROUP BY doc_id),
o AS (SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.p) AS t FROM x ANTI JOIN hit ON x.doc_id = hit.doc_id AND x.p = hit.p GROUP BY x.doc_id)
SELECT o.doc_id, len(ws)::BIGINT AS n_words, len(ps)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM o LEFT JOIN kept ON o.doc_id = kept.doc_id
"""


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = piece_bpe.encode(docs, "text", "ids", "decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op9_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLES["op9_minhash_neardup"] = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS v FROM s),
c AS (SELECT v FROM x GROUP BY v HAVING count(*) > 1),
y AS (SELECT x.* FROM x JOIN c USING (v)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM y a JOIN y b ON a.v = b.v AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id
"""


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


ORACLES["op2_decontamination"] = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, sz, array_to_string(ws[s : s + sz - 1], ' ') AS t FROM (SELECT item_id, ws, least(len(ws), 13) AS sz, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) AS s FROM i WHERE len(ws) > 0)),
z AS (SELECT DISTINCT sz FROM g),
k AS (SELECT doc_id, sz, s, array_to_string(ws[s : s + sz - 1], ' ') AS t FROM (SELECT doc_id, ws, sz, unnest(range(1, len(ws) - sz + 2)) AS s FROM d, z WHERE len(ws) >= sz)),
h AS (SELECT doc_id, item_id, s, k.sz FROM k JOIN g ON k.t = g.t AND k.sz = g.sz),
p AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + sz)) AS p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN p ON d.doc_id = p.doc_id LEFT JOIN q ON d.doc_id = q.doc_id
"""


@query
def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint.fingerprints(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint.text_form(F.col("sketch")).alias("fingerprint"), fingerprint.text_form(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard.shards(table(spark, sf_dir, "documents"), [1.0] * 16, [1.0] * 17)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# CRC-32 in SQL: blocks of 256 bytes by a byte table, the blocks joined through the images of the 32 bits under 256 zero bytes
ORACLES["op10_sharding"] = r"""
WITH t AS (SELECT list(list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
z AS (SELECT list(list_reduce(list_concat([1::BIGINT << i], range(256)), lambda a, b: xor(a >> 8, t[1 + (a & 255)])) ORDER BY i) AS z FROM range(32) r(i), t),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, coalesce(doc_id::VARCHAR, chr(0) || 'null') AS key FROM documents),
h AS (SELECT k, hex(encode(text)) AS x, strlen(text) AS n FROM d),
c AS (SELECT k, j, substr(x, CASE WHEN j = 0 THEN 1 ELSE 1 + 2 * (n % 256 + (j - 1) * 256) END, CASE WHEN j = 0 THEN 2 * (n % 256) ELSE 512 END) AS x FROM (SELECT *, unnest(range(0, n // 256 + 1)) AS j FROM h)),
v AS (SELECT k, j, list_reduce(list_concat([CASE WHEN j = 0 THEN 4294967295 ELSE 0 END::BIGINT], list_transform(range(1, length(x), 2), lambda p: ('0x' || substr(x, p, 2))::BIGINT)), lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)])) AS v FROM c, t),
e AS (SELECT k, xor(4294967295, list_reduce(list(v ORDER BY j), lambda a, b: xor(b, list_aggregate(list_transform(range(0, 32), lambda i: ((a >> i) & 1) * z[i + 1]), 'bit_xor')))) AS text_crc32 FROM v, z GROUP BY k, z),
q AS (SELECT k, list_transform(range(0, 17), lambda s: ('0x' || substr(md5(key || '|' || s), 1, 15))::BIGINT) AS q FROM d),
o AS (SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, text_crc32, (list_position(q[1:16], list_max(q[1:16])) - 1)::INTEGER AS shard, (list_position(q, list_max(q)) - 1)::INTEGER AS grown_shard, md5(key) AS place FROM d JOIN e USING (k) JOIN q USING (k))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM o
"""


@query
def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return katz.scores(table(spark, sf_dir, "documents"), held_out)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_tokens.token_counts(table(spark, sf_dir, "documents"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# base32 of the digest: each letter is five bits, read out of two hexadecimal digits
ORACLES["op8_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
f AS (SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((((strpos('0123456789abcdef', substr(s, 1 + (5 * i // 4)::INTEGER, 1)) - 1) * 16 + greatest(strpos('0123456789abcdef', substr(s, 2 + (5 * i // 4)::INTEGER, 1)) - 1, 0)) >> (3 - 5 * i % 4)::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), posteriors=True)
