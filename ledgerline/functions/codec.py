"""Cursor tokens, identifiers, charges and byte codecs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.schema import EVENT_ENVELOPE, IDENTIFIER_BYTES, RECORD_CHARGE

U64 = "decimal(20,0)"


def accounted_bytes(event_id: Column, schema_id: Column, payload: Column) -> Column:
    """What an event is charged against page and queue budgets."""
    return (F.octet_length(payload) + F.octet_length(event_id) + F.octet_length(schema_id) + F.lit(EVENT_ENVELOPE)).cast("long")


def stored_bytes(event_id: Column, schema_id: Column, payload: Column) -> Column:
    return accounted_bytes(event_id, schema_id, payload) + F.lit(RECORD_CHARGE)


def valid_identifier(name: Column) -> Column:
    """1 to 256 bytes of UTF-8; null is not valid."""
    return F.coalesce(F.octet_length(name).between(1, IDENTIFIER_BYTES), F.lit(False))


def fixed_hex(number: Column, digits: int) -> Column:
    """A number below 2**63 as lower-case hexadecimal with leading zeros."""
    return F.lpad(F.lower(F.hex(number)), digits, "0")


def wide_hex(number: Column) -> Column:
    """A decimal(20,0) below 2**64 as 16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.conv(number.cast("string"), 10, 16)), 16, "0")


def big_endian(number: Column) -> Column:
    """Eight bytes whose order is the number's order."""
    return F.unhex(fixed_hex(number, 16))


def from_big_endian(raw: Column) -> Column:
    return F.when(F.octet_length(raw) == 8, F.conv(F.hex(raw), 16, 10).cast(U64))


def encode_token(stream_id: Column, incarnation: Column, offset: Column, wide: bool = False) -> Column:
    """esc_ and, in hexadecimal: version 01, flags 00, two bytes of length, the id, 16 bytes of incarnation, 8 of offset."""
    name = F.encode(stream_id, "UTF-8")
    tail = wide_hex(offset) if wide else fixed_hex(offset, 16)
    return F.concat(F.lit("esc_0100"), fixed_hex(F.octet_length(name).cast("long"), 4), F.lower(F.hex(name)), F.lower(F.hex(incarnation)), tail)


def decode_token(token: Column) -> Column:
    """Struct of error, stream_id, incarnation (hex) and offset (decimal(20,0)); the first failing check names the error.

    Bytes are looked at in order, so a wrong version shows before a bad digit that follows it.
    """
    raw = F.decode(F.encode(token, "UTF-8"), "ISO-8859-1")  # a character for each byte
    body = F.substring(raw, 5, 1 << 20)
    part = lambda at, n: F.substr(body, F.lit(at) if isinstance(at, int) else at, F.lit(n) if isinstance(n, int) else n)
    spelled = lambda x: x.rlike(r"^[0-9a-f]*\z")
    declared = F.when(spelled(part(5, 4)), F.conv(part(5, 4), 16, 10).cast("int"))
    size = F.octet_length(token)
    digits, rest = part(9, declared * 2), part(F.lit(9) + declared * 2, 48)
    name = F.when(spelled(digits), F.unhex(digits))
    text = F.try_validate_utf8(name.cast("string"))
    error = (
        F.when(token.isNull() | (size < 62) | (size > 572) | (size % 2 != 0), "InvalidLength")
        .when(~raw.startswith("esc_"), "InvalidPrefix")
        .when(~spelled(part(1, 2)), "InvalidEncoding")
        .when(part(1, 2) != "01", "UnsupportedVersion")
        .when(~spelled(part(3, 2)), "InvalidEncoding")
        .when(part(3, 2) != "00", "UnsupportedFlags")
        .when(declared.isNull(), "InvalidEncoding")
        .when(F.length(body) != 8 + declared * 2 + 48, "InvalidLength")
        .when(~declared.between(1, IDENTIFIER_BYTES), "InvalidStreamId")
        .when(~spelled(digits), "InvalidEncoding")
        .when(text.isNull() | (F.encode(text, "UTF-8") != name), "InvalidStreamId")
        .when(~spelled(rest), "InvalidEncoding")
    )
    good = error.isNull()
    return F.struct(
        error.alias("error"),
        F.when(good, text).alias("stream_id"),
        F.when(good, F.substring(rest, 1, 32)).alias("incarnation"),
        F.when(good, F.conv(F.substring(rest, 33, 16), 16, 10).cast(U64)).alias("offset"),
    )


def digest(raw: Column) -> Column:
    """SHA-256 as lower-case hexadecimal."""
    return F.sha2(raw, 256)


def valid_digest_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-f]{64}\z"), F.lit(False))


def batch_id(bootstrap_id: Column, after: Column) -> Column:
    """The first 16 bytes of SHA-256 over the bootstrap's id and the position it follows."""
    return F.substring(F.unhex(digest(F.concat(bootstrap_id, big_endian(after)))), 1, 16)


def framer_checkpoint(line_start: Column, next_byte: Column, item: Column, partial: Column, finished: Column) -> Column:
    """State of a newline framer: a mark, three numbers of eight bytes, and the unfinished line."""
    mark = F.when(finished, F.lit("NLCF1")).otherwise(F.lit("NLCP1"))
    return F.concat(F.encode(mark, "UTF-8"), big_endian(line_start), big_endian(next_byte), big_endian(item), partial)


def ordered_bytes(offset: Column, raw: Column) -> Column:
    """An aggregate: byte strings of a group, concatenated in order of offset."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(offset.alias("o"), raw.alias("b")))), lambda x: x["b"])
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def bounded_text(text: Column, most: int) -> Column:
    """The longest prefix of at most so many bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, most - k).cast("string")) for k in range(min(4, most + 1))]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*cuts, F.lit("")))
