"""Bytes and text: encodings, varints and number text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def base64url(data: Column) -> Column:
    return F.rtrim(F.translate(F.base64(data), "+/", "-_"), F.lit("="))


def from_base64url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def encode_bytes(data: Column, encoding: str = "base64url") -> Column:
    """base64url, base64, hex or bytes."""
    forms = {"base64url": base64url, "base64": F.base64, "hex": lambda d: F.lower(F.hex(d)), "bytes": lambda d: d}
    return forms[encoding](data)


def decode_text(text: Column, encoding: str = "base64url") -> Column:
    """Bytes of a text; null gives no bytes."""
    forms = {"base64url": from_base64url, "base64": F.unbase64, "hex": F.unhex, "utf8": lambda t: F.encode(t, "utf-8")}
    return F.coalesce(forms[encoding](text), F.unhex(F.lit("")))


def byte(value: Column) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2, "0"))


def varint(n: Column) -> Column:
    """Unsigned LEB128 of 0 to 2^35 - 1."""
    n = n.cast("long")
    parts = lambda k: [byte(F.shiftright(n, 7 * i).bitwiseAND(127).bitwiseOR(F.lit(128 if i < k - 1 else 0))) for i in range(k)]
    out = F.concat(*parts(5))
    for k in (4, 3, 2, 1):
        out = F.when(n < 1 << (7 * k), F.concat(*parts(k))).otherwise(out)
    return out


def number_text(x: Column) -> Column:
    """The shortest decimal text of a double that is not a whole number, as ECMAScript writes it."""
    raw = F.abs(x).cast("string")
    mantissa, exponent = F.split(raw, "E")[0], F.coalesce(F.get(F.split(raw, "E"), F.lit(1)).cast("int"), F.lit(0))
    whole, part = F.split(mantissa, "\\.")[0], F.split(mantissa, "\\.")[1]
    led = F.concat(whole, part)
    digits = F.rtrim(F.ltrim(led, F.lit("0")), F.lit("0"))
    point = F.length(whole) + exponent - (F.length(led) - F.length(F.ltrim(led, F.lit("0"))))  # digits before the point
    k = F.length(digits)
    zeros = lambda n: F.repeat(F.lit("0"), F.greatest(n, F.lit(0)))
    scientific = F.concat(
        F.substring(digits, 1, 1), F.when(k > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), k))).otherwise(""),
        F.lit("e"), F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"),
    )
    plain = (
        F.when((k <= point) & (point <= 21), F.concat(digits, zeros(point - k)))
        .when((point > 0) & (point <= 21), F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, k)))
        .when((point > -6) & (point <= 0), F.concat(F.lit("0."), zeros(-point), digits))
        .otherwise(scientific)
    )
    return F.concat(F.when(x < 0, "-").otherwise(""), plain)
