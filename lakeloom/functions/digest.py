"""Content addressing: framed digests, identifiers (CID), set commitments, shard hashes, ring coordinates.

All are column expressions on the JVM's SHA-2, but for a few short helpers on identifiers in base 58.
"""

from __future__ import annotations

import base64
import json
import os
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DataType, DecimalType, DoubleType, FloatType, IntegralType, StringType

from .codec import base64url, byte, encode_bytes, from_base64url, number_text, varint

# The frame's version and tags, multiformats codes and alphabets.
VERSION = "01"
TAGS = {"null": "00", "int": "01", "real": "02", "text": "03", "bool": "04", "blob": "05", "json": "06"}
CODECS = {"raw": 0x55, "dag-cbor": 0x71}
HASHES = {"sha2-256": (0x12, 256), "sha2-512": (0x13, 512)}
BASE32 = "abcdefghijklmnopqrstuvwxyz234567"
#: Domains of set commitments are this and /sd-leaf/v1 or /sd-set/v1; give another to match roots made elsewhere.
NAMESPACE = "lakeloom"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _framed(tag: str, payload: Column) -> Column:
    return F.concat(F.unhex(F.lit(TAGS[tag])), varint(F.octet_length(payload)), payload)


def encode_field(value: Column, kind: DataType, is_json: bool = False) -> Column:
    """tag, length and payload of a field; null is a bare tag. Whole doubles are encoded as integers."""
    text = lambda c: F.encode(c.cast("string"), "utf-8")
    if isinstance(kind, BooleanType):
        out = F.concat(F.unhex(F.lit(TAGS["bool"])), byte(value.cast("int")))
    elif isinstance(kind, (IntegralType, DecimalType)):
        out = _framed("int", text(value))
    elif isinstance(kind, (DoubleType, FloatType)):
        value = value.cast("double")
        bad = F.isnan(value) | (F.abs(value) == float("inf"))
        whole = value == F.floor(value)
        out = F.when(bad, F.raise_error(F.lit("digest: a number that is not finite"))).when(whole, _framed("int", text(F.when(whole & ~bad, value).cast("decimal(38,0)")))).otherwise(_framed("real", text(number_text(value))))
    elif isinstance(kind, BinaryType):
        out = _framed("blob", value)
    elif isinstance(kind, StringType):
        out = _framed("json" if is_json else "text", text(value))
    else:
        raise TypeError(f"digest: fields of type {kind.simpleString()} are not supported; give canonical JSON text")
    return F.when(value.isNull(), F.unhex(F.lit(TAGS["null"]))).otherwise(out)


def encode_fields(fields: Sequence[tuple[Column, DataType]]) -> Column:
    return F.concat(F.unhex(F.lit(VERSION)), *[encode_field(c, t) for c, t in fields])


def sha(data: Column, bits: int = 256) -> Column:
    return F.unhex(F.sha2(data, bits))


def digest(df, *columns: str, algorithm: str = "sha256", encoding: str = "base64url") -> Column:
    """Digest of columns of df in order, by their types. Nulls are data; distinct tuples are encoded apart."""
    bits = {"sha256": 256, "sha512": 512}[algorithm]
    return encode_bytes(sha(encode_fields([(F.col(c), df.schema[c].dataType) for c in columns]), bits), encoding)


def _base32(data: Column, size: int) -> Column:
    """Base 32 without padding of `size` bytes: five bytes are eight digits."""
    groups = -(-size // 5)
    text = F.rpad(F.hex(data), groups * 10, "0")
    digits = [F.lpad(F.lower(F.conv(F.substring(text, i * 10 + 1, 10), 16, 32)), 8, "0") for i in range(groups)]
    return F.substring(F.translate(F.concat(*digits), "0123456789abcdefghijklmnopqrstuv", BASE32), 1, -(-size * 8 // 5))


@F.pandas_udf(StringType())
def _base58(data: pd.Series) -> pd.Series:
    def one(b: bytes | None) -> str | None:
        if b is None:
            return None
        n, out = int.from_bytes(b, "big"), ""
        while n:
            n, r = divmod(n, 58)
            out = BASE58[r] + out
        return "1" * (len(b) - len(b.lstrip(b"\0"))) + out

    return data.map(one)


def cid_v1(digest_bytes: Column, hash_name: str, codec: str = "raw", base: str = "base32") -> Column:
    """Identifier of a digest that exists already; its length has to be that of the hash."""
    code, bits = HASHES[hash_name]
    size = bits // 8
    head = F.unhex(F.lit(f"01{CODECS[codec]:02x}{code:02x}{size:02x}"))
    checked = F.when(F.octet_length(digest_bytes) == size, digest_bytes).otherwise(F.when(digest_bytes.isNotNull(), F.raise_error(F.lit(f"cid: the digest is not {size} bytes long")).cast("binary")))
    data = F.concat(head, checked)
    forms = {"base32": lambda d: F.concat(F.lit("b"), _base32(d, size + 4)), "base16": lambda d: F.concat(F.lit("f"), F.lower(F.hex(d))), "base64url": lambda d: F.concat(F.lit("u"), base64url(d)), "base58btc": lambda d: F.concat(F.lit("z"), _base58(d))}
    return forms[base](data)


def cid(data: Column, codec: str = "raw", hash_name: str = "sha2-256", base: str = "base32") -> Column:
    return cid_v1(sha(data, HASHES[hash_name][1]), hash_name, codec, base)


def decode_cid(text: str) -> dict:
    """version, codec, hashCode and digest (base64url). ValueError where the text is no identifier."""
    if len(text) == 46 and text.startswith("Qm"):
        data, version = _from58(text), 0
    else:
        body = text[1:]
        if text[:1] == "b":
            data = base64.b32decode(body.upper() + "=" * (-len(body) % 8))
        elif text[:1] == "f":
            data = bytes.fromhex(body)
        elif text[:1] == "u":
            data = base64.urlsafe_b64decode(body + "=" * (-len(body) % 4))
        elif text[:1] == "z":
            data = _from58(body)
        else:
            raise ValueError("cid: unknown base")
        version = data[0] if data else -1
        if version != 1 or len(data) < 4:
            raise ValueError("cid: not version 1")
        data = data[1:]
    codec = 0x70 if version == 0 else data[0]
    code, size, rest = (data[0], data[1], data[2:]) if version == 0 else (data[1], data[2], data[3:])
    if len(rest) != size:
        raise ValueError("cid: wrong length")
    names, hashes = {v: k for k, v in CODECS.items()}, {v[0]: k for k, v in HASHES.items()}
    return {"version": version, "codec": names.get(codec, codec), "hashCode": hashes.get(code, code), "digest": base64.urlsafe_b64encode(rest).decode().rstrip("=")}


def _from58(text: str) -> bytes:
    n = 0
    for ch in text:
        n = n * 58 + BASE58.index(ch)
    return b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes(-(-n.bit_length() // 8), "big")


@F.pandas_udf(StringType())
def cid_decode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else json.dumps(decode_cid(t), separators=(",", ":")))


def hash_mod(data: Column, bits: int) -> Column:
    """The first eight bytes of SHA-256, big-endian, modulo 2^bits (1 to 53)."""
    if not 1 <= bits <= 53:
        raise ValueError("hash_mod: bits must be 1 to 53")
    low = F.conv(F.substring(F.sha2(data, 256), 3, 14), 16, 10).cast("long")  # the 56 low bits of the 64
    return low.bitwiseAND(F.lit((1 << bits) - 1))


def leaf_digest(name: Column, value: Column, salt: Column, namespace: str = NAMESPACE) -> Column:
    """Digest of a salted leaf with a text value; an empty or missing salt is an error."""
    salted = F.when(F.octet_length(F.coalesce(salt, F.unhex(F.lit("")))) > 0, salt).otherwise(F.raise_error(F.lit("set commitment: a leaf without salt")).cast("binary"))
    text, blob = StringType(), BinaryType()
    return sha(encode_fields([(F.lit(f"{namespace}/sd-leaf/v1"), text), (name, text), (value, text), (salted, blob)]))


def _set_root(digests: Column, encoding: str, namespace: str) -> Column:
    body = F.aggregate(F.array_sort(digests), encode_fields([(F.lit(f"{namespace}/sd-set/v1"), StringType())]), lambda acc, d: F.concat(acc, _framed("blob", d)))
    return encode_bytes(sha(body), encoding)


def set_commit(leaves: Column, encoding: str = "base64url", namespace: str = NAMESPACE) -> Column:
    """Root over an array of (name, value, salt). Leaves are sorted by digest; a repeated name is an error."""
    names = F.transform(leaves, lambda x: x["name"])
    root = _set_root(F.transform(leaves, lambda x: leaf_digest(x["name"], x["value"], x["salt"], namespace)), encoding, namespace)
    return F.when(F.size(F.array_distinct(names)) == F.size(names), root).otherwise(F.when(leaves.isNotNull(), F.raise_error(F.lit("set commitment: duplicate leaf name")).cast("string")))


def set_disclose(leaves: Column, reveal: Sequence[str], namespace: str = NAMESPACE) -> Column:
    """struct(disclosed leaves, digests of the hidden ones)."""
    known = F.array(*map(F.lit, reveal)) if reveal else F.array().cast("array<string>")
    shown = F.filter(leaves, lambda x: F.array_contains(known, x["name"]))
    hidden = F.transform(F.filter(leaves, lambda x: ~F.array_contains(known, x["name"])), lambda x: base64url(leaf_digest(x["name"], x["value"], x["salt"], namespace)))
    return F.struct(shown.alias("disclosed"), hidden.alias("hidden"))


def set_verify(root: Column, disclosed: Column, hidden: Column, encoding: str = "base64url", namespace: str = NAMESPACE) -> Column:
    """Whether disclosed leaves and hidden digests make up the root; malformed input is false."""
    sound = F.forall(disclosed, lambda x: x["name"].isNotNull() & (F.octet_length(F.coalesce(x["salt"], F.unhex(F.lit("")))) > 0)) & F.forall(hidden, lambda h: F.coalesce(h.rlike("^[A-Za-z0-9_-]+$"), F.lit(False)))
    kept = F.filter(disclosed, lambda x: F.octet_length(F.coalesce(x["salt"], F.unhex(F.lit("")))) > 0)
    opened = F.transform(kept, lambda x: leaf_digest(x["name"], x["value"], x["salt"], namespace))
    closed = F.transform(F.filter(hidden, lambda h: h.rlike("^[A-Za-z0-9_-]+$")), from_base64url)
    return F.coalesce(sound & (_set_root(F.concat(opened, closed), encoding, namespace) == root), F.lit(False))


def ring_coord(topic: Column, depth: int = 0, peer: Column | None = None, fanout_bits: int = 4) -> Column:
    """SHA-256 ring coordinate (hex) of a topic at a depth: H(0, topic), or H(depth, prefix bits of H(peer), topic)."""
    if depth == 0:
        return F.sha2(F.concat(F.unhex(F.lit("00")), topic), 256)
    if depth * fanout_bits % 4:
        raise ValueError("whole hexadecimal digits only")
    digits = depth * fanout_bits // 4
    prefix = F.rpad(F.substring(F.sha2(peer, 256), 1, digits), digits + digits % 2, "0")
    return F.sha2(F.concat(F.unhex(F.lit(f"{depth:02x}")), F.unhex(prefix), topic), 256)


def covers(coordinate_hex: Column, prefix_bits: str) -> Column:
    """Whether the first bits of a hexadecimal coordinate are prefix_bits; an empty prefix covers all."""
    if not prefix_bits:
        return F.lit(True)
    digits = -(-len(prefix_bits) // 4)
    head = F.lpad(F.conv(F.substring(coordinate_hex, 1, digits), 16, 2), digits * 4, "0")
    return F.substring(head, 1, len(prefix_bits)) == prefix_bits


def fnv1a32(text: Column) -> Column:
    """FNV-1a over the two bytes of each UTF-16 unit (texts of the basic plane)."""
    step = lambda h, b: (h.bitwiseXOR(b) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF))
    units = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(units, F.lit(0x811C9DC5).cast("long"), lambda h, c: step(step(h, c.bitwiseAND(F.lit(255))), F.shiftright(c, 8).bitwiseAND(F.lit(255))))


def number_form(x: float) -> str:
    """The text of a finite double as ECMAScript writes it."""
    if x != x or x in (float("inf"), float("-inf")):
        raise ValueError("canonical JSON: a number that is not finite")
    if x == 0:
        return "0"
    mantissa, _, exponent = f"{abs(x)!r}".partition("e")
    whole, _, part = mantissa.partition(".")
    led = whole + part
    digits = led.strip("0")
    point = len(whole) + int(exponent or 0) - (len(led) - len(led.lstrip("0")))  # digits before the point
    k, sign = len(digits), "-" if x < 0 else ""
    if k <= point <= 21:
        return sign + digits + "0" * (point - k)
    if 0 < point <= 21:
        return f"{sign}{digits[:point]}.{digits[point:]}"
    if -6 < point <= 0:
        return f"{sign}0.{'0' * -point}{digits}"
    return f"{sign}{digits[0]}{'.' if k > 1 else ''}{digits[1:]}e{'+' if point > 0 else '-'}{abs(point - 1)}"


def canonical_text(value: object) -> str:
    """JSON with keys in UTF-16 order and no spaces."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_text(k)}:{canonical_text(value[k])}" for k in sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_text, value)) + "]"
    if isinstance(value, float):
        return number_form(value)
    return json.dumps(value, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no spaces, all numbers as doubles; those that are not finite are an error."""
    return text.map(lambda t: None if t is None else canonical_text(json.loads(t, parse_int=float)))


def random_bytes(bits: int = 256, encoding: str = "base64url") -> Column:
    """ceil(bits / 8) random bytes for each row."""
    size = -(-bits // 8)
    draw = F.pandas_udf(lambda ids: ids.map(lambda _: os.urandom(size)), BinaryType()).asNondeterministic()
    return encode_bytes(draw(F.monotonically_increasing_id()), encoding)


def register_sql(spark) -> None:
    """The functions of fixed arity as SQL functions of a session."""
    for text in (
        "hash_mod(data BINARY, bits INT) RETURNS BIGINT RETURN CAST(conv(substr(sha2(data, 256), 3, 14), 16, 10) AS BIGINT) & (shiftleft(1L, bits) - 1)",
        "log_bucket(n BIGINT) RETURNS BIGINT RETURN CASE WHEN n >= 1 THEN shiftleft(1L, length(bin(n)) - 1) ELSE 0L END",
        "base64url(data BINARY) RETURNS STRING RETURN rtrim('=', translate(base64(data), '+/', '-_'))",
        "cid_hex(data BINARY) RETURNS STRING RETURN concat('f01551220', sha2(data, 256))",
        "topic_coord(topic STRING) RETURNS STRING RETURN sha2(concat(X'00', encode(topic, 'utf-8')), 256)",
    ):
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    spark.udf.register("cid_decode", cid_decode)
    spark.udf.register("canonical_json", canonical_json)
