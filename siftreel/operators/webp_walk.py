"""The WebP container: chunks in nested scopes, and the grammar that says which may follow which."""

from __future__ import annotations

from typing import NamedTuple

from .vp8l import U32_MAX, Fault, check_image

#: The longest file, and the chunks that the format knows.
MOST = 2**32 - 1 - 2
KNOWN = (b"ALPH", b"ANIM", b"ANMF", b"EXIF", b"ICCP", b"VP8 ", b"VP8L", b"VP8X", b"XMP ")
#: Bits of the VP8X, ALPH and ANMF flags.
ICCP, ALPHA, EXIF, XMP, ANIMATED = 0x20, 0x10, 0x08, 0x04, 0x02
VP8X_FLAGS, ALPH_FLAGS, ANMF_FLAGS, LOSSLESS = 0x3E, 0x1D, 0x03, 0x01


def name_of(code: bytes) -> str:
    try:
        return code.decode().strip()
    except UnicodeDecodeError:
        return f"0x{code.hex()}"


class Canvas(NamedTuple):
    flags: int
    width: int
    height: int


class Scope:
    """Chunks one after another in content[at:end]. A scope may end past the real end of the content: headers, bodies that
    are read and padding are then truncated, but a body that is skipped isn't missed."""

    def __init__(self, content: bytes, at: int, end: int | None, log: list | None, depth: int = 0, trail: list | None = None):
        self.content, self.at, self.log, self.depth = content, at, log, depth
        self.trail: list[tuple[bytes, int]] = [] if trail is None else trail  # the chunks gone into, the outermost first
        self.end = len(content) if end is None else end
        self.name: bytes | None = None
        self.left = self.pad = 0
        self.peeked: bytes | None = None

    def _settle(self) -> None:
        """Read the padding of a chunk whose body is used up."""
        if self.name is not None and not self.left and self.pad:
            if self.at >= min(self.end, len(self.content)):
                raise Fault("TruncatedChunk", None, f"no padding byte at {self.at}")
            zero = self.content[self.at] == 0
            self.at += 1
            self.pad = 0
            if not zero:
                raise Fault("InvalidInput", None, f"the padding byte at {self.at - 1} is not zero")

    def more(self) -> bool:
        self._settle()
        return self.peeked is not None or bool(self.left) or self.at < min(self.end, len(self.content))

    def _header(self) -> bytes:
        raw = self.content[self.at : min(self.at + 8, self.end)]
        if len(raw) < 8:
            raise Fault("TruncatedChunk", None, f"a header of 8 bytes at {self.at}, {len(raw)} are there")
        return raw

    def _unread(self) -> Fault:
        return Fault("InvalidInput", None, f"{self.left} bytes too many in {name_of(self.name or b'')}")

    def peek(self) -> bytes | None:
        self._settle()
        if self.peeked is None:
            if self.left:
                raise self._unread()
            if not self.more():
                return None
            self.peeked = self._header()
        return self.peeked[:4]

    def any(self) -> bytes:
        """The next chunk's name; its body may then be read."""
        self._settle()
        if self.peeked is None:
            if self.left:
                raise self._unread()
            if not self.more():
                raise Fault("InvalidChunkLayout", None, f"a chunk is expected at {self.at}")
        raw, self.peeked = self.peeked or self._header(), None
        self.name, self.left = raw[:4], int.from_bytes(raw[4:], "little")
        self.pad = self.left & 1
        if self.log is not None:
            self.log.append({"depth": self.depth, "pos": self.at, "name": raw[:4].decode("latin-1"), "len": self.left})
        self.trail[self.depth :] = [(self.name, self.at)]
        self.at += 8
        return self.name

    def one(self, name: bytes) -> None:
        self._settle()
        if self.peeked is None and not self.left and not self.more():
            raise Fault("MissingRequiredChunk", name_of(name), f"{name_of(name)} is expected at {self.at}")
        if self.any() != name:
            raise Fault("InvalidChunkLayout", None, f"expected {name_of(name)}, found {name_of(self.name or b'')}")

    def read(self, n: int) -> bytes:
        self._settle()
        if self.left < n:
            raise Fault("TruncatedChunk", None, f"{n} bytes are needed, the chunk has {self.left} left")
        data = self.content[self.at : min(self.at + n, self.end)]
        if len(data) < n:
            raise Fault("TruncatedChunk", None, f"{n} bytes are needed at {self.at}, {len(data)} are there")
        self.at += n
        self.left -= n
        return data

    def body(self) -> bytes:
        """What is left of the chunk, as far as it is there; it counts as read only when skipped."""
        return self.content[self.at : min(self.at + self.left, self.end)]

    def skip(self) -> None:
        self._settle()
        if self.depth and self.left > max(0, self.end - self.at):
            raise Fault("TruncatedChunk", None, f"{self.left} bytes at {self.at} reach beyond the {self.end} of the chunk around")
        self.at += self.left
        self.left = 0

    def inside(self) -> Scope:
        """A scope over the chunk's body; the chunk counts as read as far as the inner scope got."""
        end = self.at + self.left
        return Scope(self.content, self.at, min(end, self.end) if self.depth else end, self.log, self.depth + 1, self.trail)

    def up_to(self, inner: Scope) -> None:
        self.left -= inner.at - self.at
        self.at = inner.at


def _lossless(scope: Scope, canvas: Canvas | None) -> None:
    head = scope.read(5)
    if head[0] != 0x2F:
        raise Fault("InvalidInput", None, f"signature 0x{head[0]:02x}, not 0x2f")
    v = int.from_bytes(head[1:], "little")
    width, height, version = 1 + (v & 0x3FFF), 1 + (v >> 14 & 0x3FFF), v >> 29
    if version:
        raise Fault("UnsupportedVp8lVersion", str(version), f"version {version}, only 0 is known")
    if canvas and (width, height) != (canvas.width, canvas.height):
        raise Fault("InvalidInput", None, f"an image of {width} x {height} on a canvas of {canvas.width} x {canvas.height}")
    check_image(scope.body(), width, height)
    scope.skip()


def _alpha(scope: Scope, canvas: Canvas) -> None:
    flags = scope.read(1)[0]
    if flags & ~ALPH_FLAGS:
        raise Fault("InvalidInput", None, f"flags 0x{flags:02x}, only bits of 0x{ALPH_FLAGS:02x} are known")
    if flags & LOSSLESS:
        check_image(scope.body(), canvas.width, canvas.height)
    scope.skip()


def _image(scope: Scope, canvas: Canvas, alpha: bool) -> None:
    name = scope.any()
    if name == b"VP8 ":
        scope.skip()
    elif name == b"VP8L" and not alpha:
        _lossless(scope, canvas)
    else:
        raise Fault("InvalidChunkLayout", None, f"expected VP8{'' if alpha else ' or VP8L'}, found {name_of(name)}")


def _rest(scope: Scope, unknown: bool) -> None:
    while scope.more():
        name = scope.any()
        if name in KNOWN:
            raise Fault("InvalidChunkLayout", None, f"{name_of(name)} where only unknown chunks may be")
        if not unknown:
            raise Fault("UnsupportedChunk", name_of(name), "unknown chunks are not allowed")
        scope.skip()


def _still(scope: Scope, canvas: Canvas) -> None:
    alpha = bool(canvas.flags & ALPHA)
    if alpha:
        scope.one(b"ALPH")
        _alpha(scope, canvas)
    if not scope.more():
        raise Fault("MissingRequiredChunk", "VP8", f"an image is expected at {scope.at}")
    _image(scope, canvas, alpha)


def _animated(scope: Scope, canvas: Canvas, unknown: bool) -> None:
    scope.one(b"ANIM")
    scope.read(6)
    if scope.peek() != b"ANMF":
        raise Fault("MissingRequiredChunk", "ANMF", f"a frame is expected at {scope.at}")
    while scope.peek() == b"ANMF":
        scope.one(b"ANMF")
        flags = scope.read(16)[15]
        if flags & ~ANMF_FLAGS:
            raise Fault("InvalidInput", None, f"flags 0x{flags:02x}, only bits of 0x{ANMF_FLAGS:02x} are known")
        frame = scope.inside()
        alpha = bool(canvas.flags & ALPHA) and frame.peek() == b"ALPH"
        if alpha:
            frame.one(b"ALPH")
            _alpha(frame, canvas)
        _image(frame, canvas, alpha)
        _rest(frame, unknown)
        scope.up_to(frame)


def _extended(scope: Scope, unknown: bool) -> None:
    raw = scope.read(10)
    width, height = (1 + int.from_bytes(raw[a : a + 3], "little") for a in (4, 7))
    if raw[0] & ~VP8X_FLAGS or any(raw[1:4]) or width * height > U32_MAX:
        raise Fault("InvalidInput", None, f"flags 0x{raw[0]:02x} of 0x{VP8X_FLAGS:02x}, reserved bytes {raw[1:4].hex()}, canvas of {width} x {height}")
    canvas = Canvas(raw[0], width, height)
    if canvas.flags & ICCP:
        scope.one(b"ICCP")
        scope.skip()
    if canvas.flags & ANIMATED:
        _animated(scope, canvas, unknown)
    else:
        _still(scope, canvas)
    for flag, name in ((EXIF, b"EXIF"), (XMP, b"XMP ")):
        if canvas.flags & flag:
            scope.one(name)
            scope.skip()


def check(content: bytes, unknown: bool = False, log: list | None = None, trail: list | None = None) -> None:
    """Raises Fault if the file isn't a valid WebP file. log: gets every chunk header that was read; trail: the (name,
    offset) of the chunk read last and of those around it, the outermost first."""
    trail = [] if trail is None else trail
    file = Scope(content, 0, None, log, 0, trail)
    file.one(b"RIFF")
    size = file.left
    kind = file.read(4)
    if kind != b"WEBP":
        raise Fault("InvalidInput", None, f"expected WEBP, found {name_of(kind)}")
    if size + 8 > MOST:
        raise Fault("InvalidInput", None, f"a file of {size + 8} bytes, at most {MOST} are allowed")
    scope = file.inside()
    name = scope.any()
    if name == b"VP8 ":
        scope.skip()
    elif name == b"VP8L":
        _lossless(scope, None)
    elif name == b"VP8X":
        _extended(scope, unknown)
    else:
        raise Fault("InvalidChunkLayout", None, f"expected VP8, VP8L or VP8X, found {name_of(name)}")
    _rest(scope, unknown)
    file.up_to(scope)
    if file.more():
        trail.clear()
        raise Fault("InvalidInput", None, f"bytes after the file's end at {file.at}")


def verdict(content: bytes | None, unknown: bool = False, log: list | None = None) -> tuple[str | None, str | None]:
    """(code, arg) of the first fault, or nulls. A null content is an empty file."""
    return report(content, unknown, log)[:2]


def report(content: bytes | None, unknown: bool = False, log: list | None = None) -> tuple[str | None, str | None, str | None, list[str] | None]:
    """verdict's, what was found and what may be, and the chunk read last after those around it, as name@offset."""
    trail: list[tuple[bytes, int]] = []
    try:
        check(content or b"", unknown, log, trail)
    except Fault as e:
        return e.code, e.arg, e.detail, [f"{name_of(name)}@{at}" for name, at in trail]
    return None, None, None, None
