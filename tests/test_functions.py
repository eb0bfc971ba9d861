from __future__ import annotations

import base64
import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import codec, digest
from lakeloom.operators import matching


def one(spark, column, **values):
    kinds = {bool: "boolean", int: "long", float: "double", str: "string", bytes: "binary"}
    row = tuple(values.values()) or (0,)
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x long"
    return spark.createDataFrame([row], schema).select(column.alias("r")).first()["r"]


def test_content_id_of_hello_world(spark):
    text = "bafkreifzjut3te2nhyekklss27nh3k72ysco7y32koao5eei66wof36n5e"
    assert one(spark, digest.cid(F.col("b")), b=b"hello world") == text
    parts = digest.decode_cid(text)
    assert parts["version"] == 1 and parts["codec"] == "raw" and parts["hashCode"] == "sha2-256"
    for base in ("base16", "base58btc", "base64url"):
        assert digest.decode_cid(one(spark, digest.cid(F.col("b"), base=base), b=b"hello world")) == parts
    long = one(spark, digest.cid(F.col("b"), hash_name="sha2-512"), b=b"hello world")
    assert digest.decode_cid(long)["hashCode"] == "sha2-512"
    for bad in ("", "q123", "b!!", "f00"):
        with pytest.raises(ValueError):
            digest.decode_cid(bad)


def test_digest_fields(spark):
    frame = spark.createDataFrame([(2, 2.0, "a", None, True, b"\x01", 0.5)], "i long, d double, s string, n string, b boolean, x binary, h double")
    assert frame.select(digest.digest(frame, "i") == digest.digest(frame, "d")).first()[0]
    expected = b"\x01" + b"\x01\x012" + b"\x03\x01a" + b"\x00" + b"\x04\x01" + b"\x05\x01\x01" + b"\x02\x030.5"
    got = frame.select(digest.digest(frame, "i", "s", "n", "b", "x", "h", encoding="hex")).first()[0]
    assert got == hashlib.sha256(expected).hexdigest()
    nan = spark.createDataFrame([(float("nan"),)], "d double")
    with pytest.raises(Exception, match="not finite"):
        nan.select(digest.digest(nan, "d")).collect()


def test_number_text(spark):
    for x, text in {0.5: "0.5", -1.25: "-1.25", 1e-7 * 1.5: "1.5e-7", 1.5e-6: "0.0000015", 123456789.25: "123456789.25", 0.1 + 0.2: "0.30000000000000004", 12345678.9: "12345678.9"}.items():
        assert one(spark, codec.number_text(F.col("x")), x=x) == text


def test_varint(spark):
    for n, hexed in {0: "00", 127: "7F", 128: "8001", 300: "AC02", 16384: "808001", 2**31: "8080808008"}.items():
        assert one(spark, F.hex(codec.varint(F.col("n"))), n=n) == hexed


def test_hash_mod(spark):
    full = int.from_bytes(hashlib.sha256(b"hello").digest()[:8], "big")
    for bits in (1, 16, 53):
        assert one(spark, digest.hash_mod(F.col("b"), bits), b=b"hello") == full % 2**bits
    with pytest.raises(ValueError):
        digest.hash_mod(F.col("b"), 54)


LEAVES = "array<struct<name:string,value:string,salt:binary>>"


def test_set_commitment(spark):
    leaves = [("a", "1", b"s1"), ("b", None, b"s2"), ("c", "3", b"s3")]
    df = spark.createDataFrame([(leaves,), (leaves[::-1],), ([],)], f"l {LEAVES}").withColumn("root", digest.set_commit(F.col("l")))
    roots = [r["root"] for r in df.collect()]
    assert roots[0] == roots[1] != roots[2]
    opened = df.withColumn("d", digest.set_disclose(F.col("l"), ["a", "zzz"]))
    check = lambda root, hidden="d.hidden": opened.select(digest.set_verify(root, F.col("d.disclosed"), F.col(hidden) if isinstance(hidden, str) else hidden)).collect()
    assert all(r[0] for r in check(F.col("root")))
    assert not any(r[0] for r in check(F.lit("x")))
    assert not check(F.col("root"), F.slice("d.hidden", 1, 1))[0][0]
    assert not check(F.col("root"), F.array(F.lit("*")))[0][0]
    for bad in ([("a", "1", b""),], [("a", "1", b"s"), ("a", "2", b"t")]):
        with pytest.raises(Exception, match="set commitment"):
            spark.createDataFrame([(bad,)], f"l {LEAVES}").select(digest.set_commit(F.col("l"))).collect()


@settings(max_examples=15, deadline=None)
@given(st.binary(max_size=40))
def test_base64url_round_trip(spark, data):
    text = one(spark, codec.base64url(F.col("b")), b=data)
    assert text == base64.urlsafe_b64encode(data).decode().rstrip("=")
    assert one(spark, codec.decode_text(F.col("t")), t=text) == data


def test_buckets_and_decisions(spark):
    rows = {0: 0, 1: 1, 7: 4, 8: 8, 300: 256, 2**30: 2**30}
    got = spark.createDataFrame([(k,) for k in rows], "n long").select("n", matching.log_bucket(F.col("n")).alias("b")).collect()
    assert {r["n"]: r["b"] for r in got} == rows
    lit = F.lit
    expected = matching.expected_matches(lit(90), lit(1.0), lit(10_000))
    factor = matching.contention(lit(90), lit(4), lit(3.0), 4.0)
    r = spark.range(1).select(expected.alias("e"), factor.alias("f"), matching.hang_out(lit(6), lit(8), expected, factor).alias("d")).first()
    assert r["e"] == pytest.approx(15.0) and r["f"] == pytest.approx(1.1333, abs=1e-3) and r["d"] == "hangOut"
    u = spark.createDataFrame([(0.0,), (-1.0,), (float("nan"),), (1.0,), (0.5,), (1e-9,), (8.0,)], "u double")
    assert [r[0] for r in u.select(matching.utilisation_bucket(F.col("u"))).collect()] == [0, 0, 0, 7, 6, 0, 7]
    caps = spark.createDataFrame([(["a", "b"], 5.0), (None, None)], "c array<string>, b double")
    m = lambda **k: [r[0] for r in caps.select(matching.matches_capabilities(F.col("c"), F.col("b"), **k)).collect()]
    assert m() == [True, True]
    assert m(must=["a"]) == [True, False]
    assert m(must_not=["b"]) == [False, True]
    assert m(min_budget=5.0) == [True, False]


def test_canonical_json_and_prefix(spark):
    assert one(spark, digest.canonical_json(F.col("t")), t='{ "b": [1, {"d":1,"c":null}], "a": "é" }') == '{"a":"é","b":[1,{"c":null,"d":1}]}'
    assert one(spark, digest.covers(F.col("h"), "1010"), h="a0")
    assert not one(spark, digest.covers(F.col("h"), "1011"), h="a0")
    assert one(spark, digest.fnv1a32(F.col("t")), t="a") == (((0x811C9DC5 ^ 97) * 0x01000193 % 2**32) * 0x01000193) % 2**32


def test_canonical_numbers_and_keys():
    from lakeloom.functions.digest import canonical_text, number_form

    forms = {1.0: "1", -0.0: "0", 1e-7: "1e-7", 1.5e-7: "1.5e-7", 1e-6: "0.000001", 123456.75: "123456.75", 1e20: "100000000000000000000", 1e21: "1e+21", -2.5e25: "-2.5e+25", 5e-324: "5e-324", 0.1: "0.1", 2.0**53: "9007199254740992"}
    assert {x: number_form(x) for x in forms} == forms
    with pytest.raises(ValueError):
        number_form(float("inf"))
    assert canonical_text({"b": [1.0, None, True, "é\n"], "a": {"\U0001f600": 2.5, "\uffff": 0.0}}) == '{"a":{"\U0001f600":2.5,"\uffff":0},"b":[1,null,true,"é\\n"]}'
