"""Schema-driven decoding and encoding of packed structures, as column expressions.

A structure is a list of fields (name, type). Types: u8, u16, u24, u32, u64, i8, i16, i32, i64, fourcc, bytes:N; one24 (a
24-bit number stored less one), zero:N (reserved bytes that must be zero), const:HEX (bytes that must be these),
flags:HEX (one byte without bits outside the mask), and last of all counted:T (a 32-bit count and that many T) or rest:T
(as many T as there are; what is left over is ignored) for T a number type or fourcc. A type may also be a list of fields
of fixed size, which becomes a struct, and ("counted", fields) or ("rest", fields) an array of structs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binary import be_u64, be_uint, fourcc, le_u64, le_uint

Kind = str | Sequence
Fields = Sequence[tuple[str, Kind]]
SIZES = {"u8": 1, "u16": 2, "u24": 3, "u32": 4, "u64": 8, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "fourcc": 4, "one24": 3}

#: Layouts of both formats.
FTYP: Fields = (("major_brand", "fourcc"), ("minor_version", "u32"), ("compatible_brands", "rest:fourcc"))
STCO: Fields = (("version_and_flags", "const:00000000"), ("entries", "counted:u32"))
CO64: Fields = (("version_and_flags", "const:00000000"), ("entries", "counted:u64"))
FULL_BOX: Fields = (("version", "u8"), ("flags", "u24"))
CHUNK: Fields = (("name", "fourcc"), ("len", "u32"))
WEBP: Fields = (("signature", "const:57454250"),)
VP8X: Fields = (("flags", "flags:3E"), ("reserved", "zero:3"), ("canvas_width", "one24"), ("canvas_height", "one24"))
ALPH: Fields = (("flags", "flags:1D"),)
ANIM: Fields = (("background_color", "u32"), ("loop_count", "u16"))
ANMF: Fields = (("x", "u24"), ("y", "u24"), ("width", "one24"), ("height", "one24"), ("duration", "u24"), ("flags", "flags:03"))


def _array(kind: Kind) -> tuple[str, Kind] | None:
    """(counted or rest, type of the elements) of an array's type."""
    what, arg = kind.split(":", 1) if isinstance(kind, str) and ":" in kind else kind if not isinstance(kind, str) and len(kind) == 2 else ("", "")
    return (what, arg) if what in ("counted", "rest") else None


def size_of(kind: Kind) -> int:
    """Bytes of a type of fixed size; of a last array: the least it takes."""
    if array := _array(kind):
        return 4 if array[0] == "counted" else 0
    if not isinstance(kind, str):
        if any(_array(k) for _, k in kind):
            raise ValueError("an inner structure has a fixed size")
        return sum(size_of(k) for _, k in kind)
    if kind in SIZES:
        return SIZES[kind]
    name, _, arg = kind.partition(":")
    return {"bytes": lambda: int(arg), "zero": lambda: int(arg), "const": lambda: len(arg) // 2, "flags": lambda: 1}[name]()


def _value(data: Column, pos: Column, kind: str, big: bool) -> Column:
    if kind == "fourcc":
        return fourcc(data, pos)
    if kind == "one24":
        return _value(data, pos, "u24", big) + 1
    if kind.startswith("bytes:"):
        return F.substring(data, pos, F.lit(size_of(kind)))
    n = size_of(kind)
    if n == 8:
        v = (be_u64 if big else le_u64)(data, pos)
        return v if kind == "u64" else F.when(v >= F.lit(str(1 << 63)).cast("decimal(20,0)"), v - F.lit(str(1 << 64)).cast("decimal(20,0)")).otherwise(v).cast("bigint")
    v = (be_uint if big else le_uint)(data, pos, n)
    return v if kind[0] != "i" else F.when(v >= 1 << (8 * n - 1), v - (1 << 8 * n)).otherwise(v)


def _part(data: Column, pos: Column, kind: Kind, big: bool) -> tuple[list[Column], Column | None]:
    """(faults, value) of a type of fixed size; what must have one content has no value."""
    if not isinstance(kind, str):
        faults, values, at = [], [], 0
        for name, inner in kind:
            wrong, value = _part(data, pos + F.lit(at), inner, big)
            faults += wrong
            values += [] if value is None else [value.alias(name)]
            at += size_of(inner)
        return faults, F.struct(*values) if values else F.struct(F.lit(True).alias("ok"))
    what, _, arg = kind.partition(":")
    if what in ("zero", "const"):
        want = arg.upper() if what == "const" else "00" * int(arg)
        return [F.when(F.hex(F.substring(data, pos, F.lit(size_of(kind)))) != want, "InvalidInput")], None
    if what == "flags":
        byte = be_uint(data, pos, 1).cast("int")
        return [F.when(byte.bitwiseAND(F.lit(0xFF ^ int(arg, 16))) != 0, "InvalidInput")], byte
    return [], _value(data, pos, kind, big)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used. What it gives is never computed anew either: as it
    isn't a plain struct, Spark doesn't copy it to each place that takes a field of it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def decode(data: Column, fields: Fields, big: bool = True, truncated: str = "TruncatedBox") -> Column:
    """Struct(code, value): value is a struct of the fields, or null with the code of the first fault.

    A field that is cut by the end gives `truncated`; a constant, reserved byte or flag that doesn't fit, and bytes after
    the last field, give InvalidInput. Null data counts as empty.
    """
    return _let(F.coalesce(data, F.lit(b"")), lambda d: _decoded(d, fields, big, truncated))


def _decoded(data: Column, fields: Fields, big: bool, truncated: str) -> Column:
    faults, values, at = [], [], 1
    for name, kind in fields:
        n, pos = size_of(kind), F.lit(at)
        faults.append(F.when(F.length(data) < at + n - 1, truncated))
        if array := _array(kind):
            what, arg = array
            width, first = size_of(arg), at + n
            there = F.floor((F.length(data) - (first - 1)) / width)
            count = be_uint(data, pos, 4) if what == "counted" else there
            if what == "counted":
                faults += [F.when(count * width >= 1 << 32, "InvalidInput"), F.when(F.length(data) - (first - 1) < count * width, truncated), F.when(F.length(data) - (first - 1) > count * width, "InvalidInput")]
            indices = F.when((count > 0) & (count <= there), F.sequence(F.lit(0), count.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
            element = lambda i: _part(data, i * width + F.lit(first), arg, big)  # noqa: B023, E731  it is the last field
            if not isinstance(arg, str) and element(F.lit(0))[0]:
                faults.append(F.when(F.exists(indices, lambda i: F.coalesce(*element(i)[0]).isNotNull()), "InvalidInput"))  # noqa: B023
            values.append(F.transform(indices, lambda i: element(i)[1]).alias(name))  # noqa: B023
            break
        wrong, value = _part(data, pos, kind, big)
        faults += wrong
        values += [] if value is None else [value.alias(name)]
        at += n
    else:
        faults.append(F.when(F.length(data) > at - 1, "InvalidInput"))
    value = F.struct(*values) if values else F.struct(F.lit(True).alias("ok"))
    return _let(F.coalesce(*faults), lambda code: F.struct(code.alias("code"), F.when(code.isNull(), value).alias("value")))


def _number(v: Column, n: int, big: bool, signed: bool = False) -> Column:
    """Hex of n bytes of a number; negative ones in two's complement."""
    digits = F.conv(v.cast("decimal(20,0)").cast("string"), 10, 16) if n > 7 and not signed else F.hex(v.cast("bigint"))
    full = F.right(F.lpad(digits, 16, "0"), F.lit(2 * n))
    return full if big else F.concat(*[F.substring(full, 2 * k + 1, 2) for k in reversed(range(n))])


def _hex(v: Column, kind: Kind, big: bool) -> Column:
    if not isinstance(kind, str):
        return F.concat(F.lit(""), *[_hex(v if k.startswith(("zero:", "const:")) else v[name], k, big) if isinstance(k, str) else _hex(v[name], k, big) for name, k in kind])
    what, _, arg = kind.partition(":")
    if what in ("zero", "const"):
        return F.lit(arg.upper() if what == "const" else "00" * int(arg))
    if what == "flags":
        return _number(v, 1, big)
    if kind == "fourcc":
        return F.hex(F.encode(F.rpad(v, 4, " "), "ISO-8859-1"))
    if kind.startswith("bytes:"):
        return F.hex(v)
    return _number(v - 1 if kind == "one24" else v, size_of(kind), big, kind[0] == "i")


def _each(kind: Kind, big: bool) -> Callable[[Column], Column]:
    return lambda v: _hex(v, kind, big)


def encode(value: Column, fields: Fields, big: bool = True) -> Column:
    """The bytes of a struct of the fields: decode's inverse. A null struct gives null."""
    parts = []
    for name, kind in fields:
        if array := _array(kind):
            if array[0] == "counted":
                parts.append(_number(F.size(value[name]), 4, big))
            parts.append(F.array_join(F.transform(value[name], _each(array[1], big)), ""))
        else:
            parts.append(_hex(value, [(name, kind)], big))
    return F.when(value.isNotNull(), F.unhex(F.concat(F.lit(""), *parts)))


def box_header(data_len: Column, code: Column, uuid: Column | None = None) -> Column:
    """The header of a box with that many payload bytes: 32-bit size where it fits, else 64-bit."""
    extra = F.lit(0) if uuid is None else F.when(uuid.isNotNull(), 16).otherwise(0)
    name = F.hex(F.encode(F.rpad(code, 4, " "), "ISO-8859-1"))
    tail = F.lit("") if uuid is None else F.coalesce(F.hex(uuid), F.lit(""))
    n = data_len.cast("decimal(20,0)")
    return F.unhex(F.when(n + extra + 8 < 1 << 32, F.concat(_number(n + extra + 8, 4, True), name, tail)).otherwise(F.concat(F.lit("00000001"), name, _number(n + extra + 16, 8, True), tail)))


def box_type(kind: int | str | bytes | UUID) -> tuple[str, bytes | None]:
    """(four-character code, UUID's bytes) of a box type given as a number, text, bytes or UUID."""
    if isinstance(kind, UUID):
        return "uuid", kind.bytes
    raw = kind.to_bytes(4) if isinstance(kind, int) else kind.encode("latin-1") if isinstance(kind, str) else kind
    if len(raw) > 4:
        raise ValueError(f"a box type has four bytes: {kind!r}")
    return raw.ljust(4).decode("latin-1"), None


def box(payload: Column, kind: int | str | bytes | UUID) -> Column:
    """A box of any payload; its header has the size that the payload asks for."""
    code, uuid = box_type(kind)
    return F.concat(box_header(F.length(payload), F.lit(code), None if uuid is None else F.lit(uuid)), payload)


def encode_box(value: Column, kind: int | str | bytes | UUID, fields: Fields) -> Column:
    """The box of a struct of the fields: decode_box's inverse. A null struct gives null."""
    return box(encode(value, fields), kind)


def decode_box(data: Column, kind: int | str | bytes | UUID, fields: Fields) -> Column:
    """Struct(code, value) of a box of that type, header included, as decode gives it for the payload.

    Cut headers and payloads give TruncatedBox; another type, a size below the header's and bytes after the box give
    InvalidInput. A size of zero reaches to the end.
    """
    return _let(F.coalesce(data, F.lit(b"")), lambda d: _decoded_box(d, kind, fields))


def _decoded_box(data: Column, kind: int | str | bytes | UUID, fields: Fields) -> Column:
    code, uuid = box_type(kind)
    wide = be_uint(data, 1, 4) == 1
    head = F.when(wide, 16).otherwise(8) + F.lit(0 if uuid is None else 16)
    there = F.length(data)
    size = F.when(be_uint(data, 1, 4) == 0, there.cast("decimal(20,0)")).when(wide, be_u64(data, 9)).otherwise(be_uint(data, 1, 4).cast("decimal(20,0)"))
    same = fourcc(data, F.lit(5)) == code
    if uuid is not None:
        same = same & (F.substring(data, head - 15, F.lit(16)) == F.lit(uuid))
    fault = F.when(there < 8, "TruncatedBox").when(fourcc(data, F.lit(5)) != code, "InvalidInput").when(there < head, "TruncatedBox").when(~same | (size < head), "InvalidInput").when(size > there, "TruncatedBox").when(size < there, "InvalidInput")
    inner = decode(F.substring(data, head + 1, F.greatest(there - head, F.lit(0))), fields)
    both = F.struct(fault.alias("fault"), inner.alias("inner"))
    return _let(both, lambda b: F.struct(F.coalesce(b["fault"], b["inner"]["code"]).alias("code"), F.when(b["fault"].isNull(), b["inner"]["value"]).alias("value")))


def checked_add(value: Column, by: Column, bits: int) -> Column:
    """value + by as an unsigned number of that many bits, null where it doesn't fit."""
    total = value.cast("decimal(30,0)") + by.cast("decimal(30,0)")
    return F.when(total.between(F.lit(0), F.lit(str((1 << bits) - 1)).cast("decimal(30,0)")), total).cast("decimal(20,0)")
