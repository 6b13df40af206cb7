"""Small builders of media bytes for tests."""


def box(code, data=b"", *, size=None, wide=False, until_eof=False, uuid=b""):
    code = code.encode() if isinstance(code, str) else code
    n = 8 + 8 * wide + len(uuid) + len(data) if size is None else size
    first = 0 if until_eof else 1 if wide else n
    return first.to_bytes(4) + code + (n.to_bytes(8) if wide else b"") + uuid + data


def ftyp(major=b"isom", brands=(b"isom",), **kw):
    return box("ftyp", major + bytes(4) + b"".join(brands), **kw)


def co(entries, width=4, version=0, count=None):
    n = len(entries) if count is None else count
    return box("stco" if width == 4 else "co64", version.to_bytes(4) + n.to_bytes(4) + b"".join(e.to_bytes(width) for e in entries))


def moov(*tables, drop=None, traks=1, **kw):
    if drop == "trak":
        return box("moov", box("mvhd", bytes(4)), **kw)
    inner = b"".join(tables)
    for name in ("stbl", "minf", "mdia", "trak"):
        inner = b"" if drop == name else box(name, {"stbl": box("stsd", b"x"), "trak": box("tkhd", bytes(3))}.get(name, b"") + inner)
    return box("moov", box("mvhd", bytes(4)) + inner * traks, **kw)


def chunk(name, data=b"", *, size=None, pad=b"\0"):
    n = len(data) if size is None else size
    return name.encode().ljust(4) + n.to_bytes(4, "little") + data + (pad if n % 2 else b"")


def riff(*chunks, name=b"RIFF", kind=b"WEBP", size=None, after=b""):
    body = kind + b"".join(chunks)
    return name + (len(body) if size is None else size).to_bytes(4, "little") + body + after


def bits(*fields):
    """(value, bits) pairs, least significant bit first."""
    out = at = 0
    for value, n in fields:
        out |= value << at
        at += n
    return out.to_bytes((at + 7) // 8, "little")


def vp8l(data=bytes.fromhex("888808"), w=1, h=1, version=0, signature=0x2F):
    return bytes([signature]) + bits((w - 1, 14), (h - 1, 14), (0, 1), (version, 3)) + data


def vp8x(flags=0, w=1, h=1, reserved=bytes(3)):
    return chunk("VP8X", bytes([flags]) + reserved + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))


ICCP_FLAG, ALPH_FLAG, EXIF_FLAG, XMP_FLAG, ANIM_FLAG = 0x20, 0x10, 0x08, 0x04, 0x02
ANIM = chunk("ANIM", bytes(6))
VP8 = chunk("VP8 ", bytes(24))
VP8L = chunk("VP8L", vp8l())
ALPH = chunk("ALPH", b"\x01" + bytes.fromhex("888808"))


def anmf(*chunks, flags=0):
    return chunk("ANMF", bytes(15) + bytes([flags]) + b"".join(chunks))
