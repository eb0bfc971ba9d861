"""Registered queries: the function library."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import codec, digest
from lakeloom.registry import query, table

B64 = "rtrim(replace(replace(to_base64({0}), '+', '-'), '/', '_'), '=')"


@query("SELECT doc_id, CAST(('0x' || substr(sha256(text), 1, 16))::UBIGINT % 65536 AS BIGINT) AS h16, CAST(('0x' || substr(sha256(text), 1, 16))::UBIGINT % 9007199254740992 AS BIGINT) AS h53 FROM documents")
def hash_mod(spark, sf):
    data = F.encode("text", "utf-8")
    return table(spark, sf, "documents").select("doc_id", digest.hash_mod(data, 16).alias("h16"), digest.hash_mod(data, 53).alias("h53"))


@query(f"SELECT doc_id, {B64.format('unhex(sha256(text))')} AS url64, to_base64(unhex(sha256(text))) AS b64, sha256(text) AS hex FROM documents")
def byte_encodings(spark, sf):
    h = digest.sha(F.encode("text", "utf-8"))
    return table(spark, sf, "documents").select("doc_id", codec.base64url(h).alias("url64"), codec.encode_bytes(h, "base64").alias("b64"), codec.encode_bytes(h, "hex").alias("hex"))


VARINT = "CASE WHEN n < 128 THEN unhex(printf('%02X', n)) ELSE unhex(printf('%02X%02X', (n % 128) + 128, n // 128)) END"


@query(f"SELECT item_id, sha256(unhex('0103') || (SELECT {VARINT} FROM (SELECT strlen(text) AS n)) || encode(text)) AS framed, sha256(unhex('0101') || unhex(printf('%02X', length(item_id::VARCHAR))) || encode(item_id::VARCHAR) || unhex('00')) AS pair FROM benchmark")
def framed_digest(spark, sf):
    b = table(spark, sf, "benchmark").withColumn("none", F.lit(None).cast("string"))
    return b.select("item_id", digest.digest(b, "text", encoding="hex").alias("framed"), digest.digest(b, "item_id", "none", encoding="hex").alias("pair"))


@query("SELECT item_id, 'f01551220' || sha256(text) AS hex, 'u' || " + B64.format("unhex('01711220') || unhex(sha256(text))") + """ AS url64,
 'b' || list_aggregate(list_transform(range(0, 58), lambda i: substr('abcdefghijklmnopqrstuvwxyz234567', CAST(('0b' || substr(rpad(bits, 290, '0'), CAST(i * 5 + 1 AS BIGINT), 5))::BIGINT + 1 AS BIGINT), 1)), 'string_agg', '') AS b32
FROM (SELECT item_id, text, unhex('01551220' || sha256(text))::BIT::VARCHAR AS bits FROM benchmark)""")
def content_ids(spark, sf):
    data = F.encode("text", "utf-8")
    return table(spark, sf, "benchmark").select("item_id", digest.cid(data, base="base16").alias("hex"), digest.cid(data, "dag-cbor", base="base64url").alias("url64"), digest.cid(data).alias("b32"))


@query("SELECT item_id, 1 AS version, 'raw' AS codec, 'sha2-256' AS hash, " + B64.format("unhex(sha256(text))") + " AS digest, true AS same FROM benchmark")
def content_id_decode(spark, sf):
    data = F.encode("text", "utf-8")
    parts = table(spark, sf, "benchmark").select("item_id", digest.cid_decode(digest.cid(data)).alias("j"), digest.cid_decode(digest.cid(data, base="base58btc")).alias("k"))
    get = lambda c: F.get_json_object("j", f"$.{c}")
    return parts.select("item_id", get("version").cast("int").alias("version"), get("codec").alias("codec"), get("hashCode").alias("hash"), get("digest").alias("digest"), (F.col("j") == F.col("k")).alias("same"))


def leaves(spark, sf):
    o = table(spark, sf, "orders")
    salt = F.unhex(F.sha2(F.concat(F.lit("salt"), F.col("o_orderkey").cast("string")), 256))
    leaf = lambda n, v: F.struct(F.lit(n).alias("name"), v.cast("string").alias("value"), salt.alias("salt"))
    return o.select("o_orderkey", F.array(leaf("status", F.col("o_orderstatus")), leaf("cust", F.col("o_custkey")), leaf("prio", F.col("o_orderpriority"))).alias("leaves"))


def _leaf_sql(name: str, value: str) -> str:
    head = "0103" + f"{len('lakeloom/sd-leaf/v1'):02X}" + "lakeloom/sd-leaf/v1".encode().hex() + f"03{len(name):02X}" + name.encode().hex() + "03"
    return f"unhex(sha256(unhex('{head}') || unhex(printf('%02X', strlen({value}))) || encode({value}) || unhex('0520') || unhex(sha256('salt' || o_orderkey))))"


_SET_HEAD = "0103" + f"{len('lakeloom/sd-set/v1'):02X}" + "lakeloom/sd-set/v1".encode().hex()


@query(f"""SELECT o_orderkey, {B64.format(f"unhex(sha256(unhex('{_SET_HEAD}') || unhex('0520') || ds[1] || unhex('0520') || ds[2] || unhex('0520') || ds[3]))")} AS root, true AS verified, false AS forged
FROM (SELECT o_orderkey, list_sort([{_leaf_sql('status', 'o_orderstatus')}, {_leaf_sql('cust', 'o_custkey::VARCHAR')}, {_leaf_sql('prio', 'o_orderpriority')}]) AS ds FROM orders)""")
def set_commitments(spark, sf):
    """Commit to three salted attributes, open one, verify it; then verify with a changed value."""
    rows = leaves(spark, sf).withColumn("root", digest.set_commit(F.col("leaves"))).withColumn("d", digest.set_disclose(F.col("leaves"), ["status"]))
    forged = F.transform(F.col("d.disclosed"), lambda x: x.withField("value", F.lit("Z")))
    return rows.select("o_orderkey", "root", digest.set_verify(F.col("root"), F.col("d.disclosed"), F.col("d.hidden")).alias("verified"), digest.set_verify(F.col("root"), forged, F.col("d.hidden")).alias("forged"))


@query("""SELECT page_id, sha256(unhex('00') || encode(url)) AS c0, sha256(unhex('01') || unhex(substr(sha256('p' || page_id), 1, 1) || '0') || encode(url)) AS c1, sha256(unhex('02') || unhex(substr(sha256('p' || page_id), 1, 2)) || encode(url)) AS c2,
 substr(sha256(url), 1, 1) IN ('4', '5') AS covered FROM pages""")
def ring_coordinates(spark, sf):
    peer = F.encode(F.concat(F.lit("p"), F.col("page_id").cast("string")), "utf-8")
    topic = F.encode("url", "utf-8")
    return table(spark, sf, "pages").select("page_id", digest.ring_coord(topic).alias("c0"), digest.ring_coord(topic, 1, peer).alias("c1"), digest.ring_coord(topic, 2, peer).alias("c2"), digest.covers(F.sha2("url", 256), "010").alias("covered"))


@query("""WITH RECURSIVE f(page_id, u, i, h) AS (SELECT page_id, url, 0, 2166136261::BIGINT FROM pages UNION ALL
  SELECT page_id, u, i + 1, ((((xor(h, ascii(substr(u, i + 1, 1))::BIGINT) * 16777619::HUGEINT) % 4294967296) * 16777619::HUGEINT) % 4294967296)::BIGINT FROM f WHERE i < length(u))
SELECT page_id, h FROM f WHERE i = length(u)""")
def fnv_slots(spark, sf):
    return table(spark, sf, "pages").select("page_id", digest.fnv1a32(F.col("url")).alias("h"))


@query("""SELECT event_id, '{"a":' || event_id || ',"b":[' || CAST(json_extract(props, '$.k') AS VARCHAR) || ',' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || ']}' AS canonical FROM events""")
def canonical_json(spark, sf):
    text = F.concat(F.lit('{ "b": ['), F.get_json_object("props", "$.k"), F.lit(" , "), F.col("value").cast("string"), F.lit('], "a" : '), F.col("event_id").cast("string"), F.lit("}"))
    return table(spark, sf, "events").select("event_id", digest.canonical_json(text).alias("canonical"))


@query("SELECT l_orderkey, l_linenumber, l_quantity, CAST(l_discount AS VARCHAR) AS discount FROM lineitem WHERE l_discount > 0")
def number_texts(spark, sf):
    return table(spark, sf, "lineitem").where("l_discount > 0").select("l_orderkey", "l_linenumber", "l_quantity", codec.number_text(F.col("l_discount")).alias("discount"))


@query("SELECT count(*) AS n, 43 AS chars, true AS differ FROM supplier")
def random_tokens(spark, sf):
    t = table(spark, sf, "supplier").select(digest.random_bytes(256).alias("r"))
    return t.agg(F.count("*").alias("n"), F.max(F.length("r")).alias("chars"), (F.countDistinct("r") == F.count("*")).alias("differ"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS day FROM events")
def conversions(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.to_date("ts").alias("day"))


@query("SELECT user_id, CAST(('0x' || substr(sha256('u' || user_id), 1, 16))::UBIGINT % 1024 AS BIGINT) AS shard, CAST(1 << CAST(floor(log2(count(*))) AS INT) AS BIGINT) AS bucket FROM events GROUP BY user_id")
def sql_functions(spark, sf):
    digest.register_sql(spark)
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql("SELECT user_id, hash_mod(encode(concat('u', user_id), 'utf-8'), 10) AS shard, log_bucket(count(*)) AS bucket FROM events GROUP BY user_id")
