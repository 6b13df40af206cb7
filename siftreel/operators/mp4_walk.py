"""The MP4 box walk: from a seekable stream of bytes to a table of boxes.

Only headers, the first ftyp's payload and moov payloads are read; everything else is skipped, so a file that is much
larger than memory can be walked. The walk decides nothing: where it can't go on it stops, and the rules over its result
(operators.mp4) say why. Chunk offsets are moved in place in the moov payload, so a moov of any size takes its own bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from decimal import Decimal
from io import BytesIO
from typing import BinaryIO, NamedTuple

import numpy as np
import pyarrow as pa

U64_MAX = 2**64 - 1
#: Bytes of ftyp payload and, by default, of moov payload that are read at most.
FTYP_LIMIT, METADATA_LIMIT = 1024, 1 << 30

#: The path on which chunk offset tables lie below moov.
PATH = (b"trak", b"mdia", b"minf", b"stbl")


class Box(NamedTuple):
    ord: int
    pos: int
    header_len: int
    size: int | None  # None: to the end of the file
    kind: str  # eof, u32 or u64
    type: bytes
    uuid: bytes | None

    @property
    def data_len(self) -> int | None:
        return None if self.size is None else self.size - self.header_len


class Invalid(Exception):
    def __init__(self, code: str, arg: str | None = None, detail: str | None = None):
        super().__init__(code, arg, detail)
        self.code, self.arg, self.detail = code, arg, detail


def shown(code: bytes) -> str:
    """A four-character code for messages: trimmed text, hex if it isn't UTF-8."""
    try:
        return code.decode().strip()
    except UnicodeDecodeError:
        return f"0x{code.hex()}"


def header(raw: bytes, ord: int = 0, pos: int = 0) -> Box:
    """The box header at the start of raw; at most 32 bytes of it count."""
    if len(raw) >= 8 and (first := int.from_bytes(raw[:4])) > 1 and (code := raw[4:8]) != b"uuid":  # most of them
        return Box(ord, pos, 8, first, "u32", code, None)

    def take(a: int, b: int) -> bytes:
        if len(raw) < b:
            raise Invalid("TruncatedBox", None, f"header of {b} bytes at least, {len(raw)} are there")
        return raw[a:b]

    first, code, at = int.from_bytes(take(0, 4)), take(4, 8), 8
    size, kind = (None, "eof") if first == 0 else (first, "u32")
    if first == 1:
        size, kind, at = int.from_bytes(take(8, 16)), "u64", 16
    uuid = take(at, at + 16) if code == b"uuid" else None
    return Box(ord, pos, at + 16 * (uuid is not None), size, kind, code, uuid)


def children(raw: bytes, at: int, end: int) -> list[tuple[Box, int, int]]:
    """Boxes inside raw[at:end], placed by their offset in raw, and where the payload of each starts and ends."""
    out = []
    while at < end:
        box = header(raw[at : min(at + 32, end)], len(out), at)
        start, stop = at + box.header_len, end if box.size is None else at + box.size
        if stop < start:
            raise Invalid("InvalidInput", None, f"size {box.size} of {shown(box.type)} is less than its header's {box.header_len} bytes")
        if stop > end:
            raise Invalid("TruncatedBox", None, f"payload of {shown(box.type)} is {box.data_len} bytes, {end - start} are there")
        out.append((box, start, stop))
        at = stop
    return out


def _one(boxes: list[tuple[Box, int, int]], code: bytes) -> tuple[Box, int, int]:
    found = [x for x in boxes if x[0].type == code]
    if len(found) > 1:
        raise Invalid("InvalidBoxLayout", None, f"{len(found)} boxes {shown(code)} where one may be")
    if not found:
        raise Invalid("MissingRequiredBox", shown(code), f"no {shown(code)} box")
    return found[0]


def _table(moov: bytes, at: int, end: int, trail: list[tuple[bytes, int]]) -> tuple[int, int, int]:
    """(offset of the first entry in the moov payload, entries, bytes of an entry) of the chunk offsets of a sample table
    whose boxes are moov[at:end]."""
    inside = children(moov, at, end)
    kinds = {box.type for box, _, _ in inside}
    if {b"stco", b"co64"} <= kinds:
        raise Invalid("InvalidBoxLayout", None, "stco and co64 in one sample table")
    code, width = (b"stco", 4) if b"stco" in kinds else (b"co64", 8)
    box, at, end = _one(inside, code)
    trail.append((code, box.pos))
    there = end - at
    for most in (1, 4, 8):  # version, flags, count
        if there < most:
            raise Invalid("TruncatedBox", None, f"version, flags and count take 8 bytes, {there} are there")
        if most < 8 and any(moov[at : at + most]):
            raise Invalid("InvalidInput", None, f"version and flags are {moov[at : min(at + 4, end)].hex()}, not 00000000")
    n = int.from_bytes(moov[at + 4 : at + 8])
    if n * width == there - 8 < 1 << 32:
        return at + 8, n, width
    counted = f"{n} entries of {width} bytes, {there - 8} bytes are there"
    if n * width < 1 << 32 and there - 8 < n * width:
        raise Invalid("TruncatedBox", None, counted)
    raise Invalid("InvalidInput", None, counted)


def tables(moov: bytes, trail: list[tuple[bytes, int]]) -> list[tuple[int, int, int]]:
    """The chunk offset table of each trak, in file order; the first fault in that order is raised.

    trail: gets the boxes that were gone into last, as (type, offset in moov).
    """
    traks = [x for x in children(moov, 0, len(moov)) if x[0].type == PATH[0]]
    if not traks:
        raise Invalid("MissingRequiredBox", shown(PATH[0]), f"no {shown(PATH[0])} box")
    out = []
    for box, at, end in traks:
        trail[:] = [(PATH[0], box.pos)]
        for code in PATH[1:]:
            box, at, end = _one(children(moov, at, end), code)
            trail.append((code, box.pos))
        out.append(_table(moov, at, end, trail))
    return out


#: Bytes of a free box's header, and the longest padding.
PAD_HEADER, MOST_PAD = 8, 2**32 - 1 - 8
#: Boxes that are skipped anywhere; the first two even before ftyp.
SKIPPED = (b"free", b"skip", b"meta", b"meco")
ALLOWED = (b"mdat", b"moov", *SKIPPED)


def walk(f: BinaryIO, length: int, limit: int = METADATA_LIMIT, mdat_size: int | None = None, every: bool = True, inner: bool = True) -> dict:
    """Boxes of the file's top level, whether a last header is cut, the ftyp's payload, and what each moov holds.

    every: list all boxes; else those that break no rule and bound nothing are left out once another follows, and the walk
    ends with the first that breaks one, so a file of millions of small boxes takes no memory. No verdict changes.
    inner: read what moov boxes hold; else none of them is gone into (with every only).
    """
    boxes: list[Box] = []
    ftyp, moov, moovs, pos, cut = None, None, [], 0, False
    first_mdat = stop = None

    def silent(last: Box, box: Box) -> bool:
        if last.type == b"mdat":
            return last.ord != first_mdat
        return last.type in SKIPPED or last.type == box.type == b"moov" and last.ord != stop

    def wrong(box: Box) -> bool:
        if box.type == b"ftyp":
            return ftyp is None or any([b.type == b"ftyp" for b in boxes[:-1]])
        if ftyp is None and box.type not in SKIPPED[:2] or box.type not in ALLOWED:
            return True
        return stop is not None if box.type == b"mdat" else box.type == b"moov" and (not moovs or moovs[-1]["ord"] != box.ord or moovs[-1]["code"] is not None)

    while pos < length:
        f.seek(pos)
        try:
            box = header(f.read(32), len(boxes), pos)
        except Invalid:
            cut = True
            break
        if not every:
            while boxes and silent(boxes[-1], box):
                if boxes.pop().type == b"moov":
                    moovs.pop()
            if box.ord != len(boxes):
                box = box._replace(ord=len(boxes))
        if box.type == b"mdat" and box.size is None and mdat_size is not None:
            box = box._replace(size=mdat_size, kind="u32")
        boxes.append(box)
        if box.type == b"mdat" and first_mdat is None:
            first_mdat = box.ord
        if box.type == b"moov" and first_mdat is not None and stop is None:
            stop = box.ord
        if box.size is not None and box.size < box.header_len:
            break
        end = length if box.size is None else pos + box.size
        if end > U64_MAX:
            break
        there = length - pos - box.header_len
        n = there if box.size is None else box.data_len
        if box.type == b"ftyp" and ftyp is None and n <= min(there, FTYP_LIMIT):
            f.seek(pos + box.header_len)
            ftyp = f.read(n)
        if inner and box.type == b"moov" and n <= min(there, limit):
            f.seek(pos + box.header_len)
            moov, fault, trail = f.read(n), None, []
            try:
                found = tables(moov, trail)
            except Invalid as e:
                found, fault = [], e
            why = {"code": fault and fault.code, "arg": fault and fault.arg, "detail": fault and fault.detail, "stack": fault and [f"{shown(code)}@{pos + box.header_len + at}" for code, at in trail]}
            moovs.append({"ord": box.ord, **why, "tables": [{"at": a, "n": k, "width": w} for a, k, w in found]})
        if not every and wrong(box):
            break
        pos = end
    return {"length": length, "boxes": boxes, "cut": cut, "ftyp": ftyp, "moov": moov, "moovs": moovs}


#: Up to as many chunk offsets of a table are moved one by one, which takes less time than an array of them.
SMALL = 64


def moved(w: dict) -> dict:
    """A walk with what the rewriting of its metadata takes, where moov lies behind the media: gap, the bytes between new
    metadata and media; moved, by how much chunk offsets change; outside, whether one then leaves its field; and moov with
    the offsets moved. The first three are null and moov is as it was where nothing is to be rewritten."""
    out = w | {"gap": None, "moved": None, "outside": None}
    media = next((b for b in w["boxes"] if b.type == b"mdat"), None)
    last = next((b for b in reversed(w["boxes"]) if b.type == b"moov"), None)
    if media is None or last is None or last.pos < media.pos or w["ftyp"] is None or not w["moovs"] or w["moovs"][-1]["ord"] != last.ord or w["moovs"][-1]["code"] is not None:
        return out
    gap = media.pos - (len(w["ftyp"]) + 8 + len(w["moov"]) + 8)
    by = 0 if gap == 0 or PAD_HEADER <= gap <= MOST_PAD else -gap
    out |= {"gap": gap, "moved": by, "outside": False}
    if not by or abs(by) >= 1 << 31:
        return out
    raw = bytearray(w["moov"])
    moov = np.frombuffer(raw, np.uint8) if any(t["n"] > SMALL for t in w["moovs"][-1]["tables"]) else None
    for t in w["moovs"][-1]["tables"]:
        if 0 < t["n"] <= SMALL:
            form, top = struct.Struct(f">{t['n']}{'I' if t['width'] == 4 else 'Q'}"), 2 ** (8 * t["width"]) - 1
            numbers = [e + by for e in form.unpack_from(raw, t["at"])]
            if min(numbers) < 0 or max(numbers) > top:
                out["outside"], numbers = True, [e & top for e in numbers]
            form.pack_into(raw, t["at"], *numbers)
        elif t["n"]:
            entries, top = moov[t["at"] : t["at"] + t["n"] * t["width"]].view(f">u{t['width']}"), 2 ** (8 * t["width"]) - 1
            out["outside"] |= int(entries.min()) + by < 0 or int(entries.max()) + by > top
            entries += np.array(by & top, entries.dtype)  # modulo the field's size
    return out | {"moov": raw}


BOX_SQL = "struct<ord int, pos decimal(20,0), header_len int, size decimal(20,0), kind string, type string, uuid binary>"
WALK_TYPES = {
    "length": "decimal(20,0)", "boxes": f"array<{BOX_SQL}>", "cut": "boolean", "ftyp": "binary", "moov": "binary",
    "moovs": "array<struct<ord int, code string, arg string, detail string, stack array<string>, tables array<struct<at int, n int, width int>>>>", "gap": "decimal(20,0)", "moved": "decimal(20,0)", "outside": "boolean",
}
WALK_SQL = ", ".join(f"{c} {t}" for c, t in WALK_TYPES.items())
_BOX = pa.struct([("ord", pa.int32()), ("pos", pa.decimal128(20)), ("header_len", pa.int32()), ("size", pa.decimal128(20)), ("kind", pa.string()), ("type", pa.string()), ("uuid", pa.binary())])
_MOOV = pa.struct([("ord", pa.int32()), ("code", pa.string()), ("arg", pa.string()), ("detail", pa.string()), ("stack", pa.list_(pa.string())), ("tables", pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("width", pa.int32())])))])
_TYPES = {"length": pa.decimal128(20), "boxes": pa.list_(_BOX), "cut": pa.bool_(), "ftyp": pa.binary(), "moov": pa.binary(), "moovs": pa.list_(_MOOV), "gap": pa.decimal128(20), "moved": pa.decimal128(20), "outside": pa.bool_()}


def plain(w: dict) -> dict:
    """A walk as nested dictionaries of values that Spark takes for WALK_SQL."""
    boxes = [b._asdict() | {"pos": Decimal(b.pos), "size": None if b.size is None else Decimal(b.size), "type": b.type.decode("latin-1")} for b in w["boxes"]]
    numbers = {c: None if w[c] is None else Decimal(w[c]) for c in ("length", "gap", "moved") if c in w}
    return w | numbers | {"boxes": boxes, "moov": None if w["moov"] is None else bytes(w["moov"])}


def _decimals(x: list[int | None]) -> pa.Array:
    try:
        return pa.array(x, pa.int64()).cast(pa.decimal128(20))
    except (OverflowError, pa.ArrowInvalid):  # over 63 bits
        return pa.array([None if v is None else Decimal(v) for v in x], pa.decimal128(20))


def columns(walks: list[dict], only: list[str]) -> list[pa.Array]:
    """Columns of the walks in Arrow, in the order of only."""
    return [_boxes(walks) if c == "boxes" else _decimals([w[c] for w in walks]) if _TYPES[c] == pa.decimal128(20) else pa.array([w[c] for w in walks], _TYPES[c]) for c in only]


def _boxes(walks: list[dict]) -> pa.Array:
    boxes = [b for w in walks for b in w["boxes"]]
    ends = [0]
    for w in walks:
        ends.append(ends[-1] + len(w["boxes"]))
    ord, pos, header_len, size, kind, code, uuid = (list(x) for x in zip(*boxes, strict=True)) if boxes else ([] for _ in range(7))
    fields = [pa.array(ord, pa.int32()), _decimals(pos), pa.array(header_len, pa.int32()), _decimals(size), pa.array(kind, pa.string()), pa.array([c.decode("latin-1") for c in code], pa.string()), pa.array(uuid, pa.binary())]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_BOX)))


#: Files and bytes of metadata that go out together.
FILES, BYTES = 1_000, 16 << 20


def kernel(kept: list[str], content: str, limit: int, mdat_size: int | None, every: bool = True, only: list[str] | None = None):
    """A mapInArrow kernel: the kept columns as they are, and those of moved(walk), or only some of them. A null content is
    an empty file."""
    only = list(_TYPES) if only is None else only
    move = not {"moov", "gap", "moved", "outside"}.isdisjoint(only)
    inner = move or "moovs" in only or not every

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            start, walks, held, data = 0, [], 0, b[content]
            for k in range(b.num_rows):
                raw = data[k].as_py() or b""
                w = walk(BytesIO(raw), len(raw), limit, mdat_size, every, inner)
                walks.append(moved(w) if move else w | {"moov": None})
                held += len(walks[-1]["moov"] or b"") + ("content" in kept) * len(raw)
                if len(walks) == FILES or held > BYTES or k == b.num_rows - 1:
                    part = b.slice(start, len(walks))
                    yield pa.RecordBatch.from_arrays([*[part[c] for c in kept], *columns(walks, only)], [*kept, *only])
                    start, walks, held = k + 1, [], 0

    return run


def zero_kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow kernel over (path, content): the boxes of each file with zero bytes for mdat payloads."""
    for b in it:
        start, out, held, data = 0, [], 0, b["content"]
        for k in range(b.num_rows):
            raw = data[k].as_py() or b""
            parts = []
            for box in walk(BytesIO(raw), len(raw), 0, None, inner=False)["boxes"]:
                end = len(raw) if box.size is None else min(box.pos + box.size, len(raw))
                if box.type == b"mdat":
                    parts += [raw[box.pos : box.pos + box.header_len], bytes(max(0, end - box.pos - box.header_len))]
                else:
                    parts.append(raw[box.pos : end])
            out.append(b"".join(parts))
            held += len(out[-1])
            if len(out) == FILES or held > BYTES or k == b.num_rows - 1:
                yield pa.RecordBatch.from_arrays([b["path"].slice(start, len(out)), pa.array(out, pa.binary())], ["path", "content"])
                start, out, held = k + 1, [], 0
