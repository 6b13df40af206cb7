"""Lossless WebP bit streams: transforms, prefix codes and entropy-coded sub-images.

The checks follow the bit stream up to the codes of the main image, whose pixels aren't decoded. Sub-images are followed
entry by entry without keeping pixels.
"""

from __future__ import annotations

from collections.abc import Callable


class Fault(Exception):
    def __init__(self, code: str, arg: str | None = None, detail: str | None = None):
        super().__init__(code, arg, detail)
        self.code, self.arg, self.detail = code, arg, detail


#: Fixed values of the format. Distances of short back references: (dx, dy) for codes from 1.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Order in which the lengths of the code-length code are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, COLOR, SUBTRACT_GREEN, INDEXING = range(4)
GREEN, OTHER, DISTANCE = 256 + 24, 256, 40
U32_MAX = 2**32 - 1


class Bits:
    """Least significant bit first; reading past the end is a truncated chunk."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def read(self, n: int) -> int:
        if self.at + n > self.end:
            raise Fault("TruncatedChunk", None, f"{n} bits are needed at bit {self.at} of {self.end}")
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        out = int.from_bytes(self.data[first:last], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        return out


class Code:
    """A prefix code, read by table: longest code length, and symbol and length for every pattern of that many bits."""

    def __init__(self, lengths: dict[int, int]):
        """lengths: code length by symbol; codes are given in order of (length, symbol)."""
        used = sorted((n, s) for s, n in lengths.items() if n)
        if len(used) == 1 and used[0][0] == 1:
            self.longest, self.table = 0, [(used[0][1], 0)]
            return
        if not used or sum(1 << (15 - n) for n, _ in used) != 1 << 15:  # empty, incomplete or oversubscribed
            raise Fault("InvalidVp8lPrefixCode", None, f"lengths of {len(used)} symbols leave codes over or give some twice")
        self.longest = used[-1][0]
        self.table: list[tuple[int, int]] = [(0, 0)] * (1 << self.longest)
        code = last = 0
        for n, s in used:
            code <<= n - last
            last = n
            step = int(f"{code:0{n}b}"[::-1], 2)
            for k in range(step, 1 << self.longest, 1 << n):
                self.table[k] = (s, n)
            code += 1

    def read(self, bits: Bits) -> int:
        if not self.longest:
            return self.table[0][0]
        at = bits.at
        window = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.longest) - 1)
        symbol, n = self.table[window]
        bits.at = at + n
        if bits.at > bits.end:
            raise Fault("TruncatedChunk", None, f"a code of {n} bits at bit {at} of {bits.end}")
        return symbol


def _single(symbol: int) -> Code:
    return Code({symbol: 1})


def prefix_code(bits: Bits, alphabet: int) -> Code:
    if bits.read(1):  # one or two symbols
        two, wide = bits.read(1), bits.read(1)
        first = bits.read(8 if wide else 1)
        if not two:
            return _single(first)
        second = bits.read(8)
        code = _single(first)
        code.longest, code.table = 1, [(first, 1), (second, 1)]
        return code
    lengths = dict.fromkeys(range(19), 0)
    for k in range(4 + bits.read(4)):
        if k >= len(LENGTH_ORDER):
            break
        lengths[LENGTH_ORDER[k]] = bits.read(3)
    by_length = Code(lengths)
    reads = alphabet
    if bits.read(1):
        reads = min(2 + bits.read(2 + 2 * bits.read(3)), 2**16 - 1)
    if reads > alphabet:
        raise Fault("InvalidInput", None, f"{reads} code lengths for an alphabet of {alphabet}")
    out: list[int] = []
    last = 8
    for _ in range(reads):
        if len(out) == alphabet:
            break
        symbol = by_length.read(bits)
        if symbol < 16:
            length, times = symbol, 1
        elif symbol == 16:
            length, times = last, 3 + bits.read(2)
        elif symbol == 17:
            length, times = 0, 3 + bits.read(3)
        else:
            length, times = 0, 11 + bits.read(7)
        last = length or last
        if len(out) + times > alphabet:
            raise Fault("InvalidVp8lPrefixCode", None, f"a run of {times} code lengths after {len(out)} of {alphabet}")
        out += [length] * times
    return Code(dict(enumerate(out)))


def code_group(bits: Bits, cache: int) -> tuple[Code, ...]:
    """Green, red, blue, alpha and distance."""
    return tuple(prefix_code(bits, n) for n in (GREEN + cache, OTHER, OTHER, OTHER, DISTANCE))


def color_cache(bits: Bits) -> int:
    """Entries of the colour cache; 0 without one."""
    if not bits.read(1):
        return 0
    order = bits.read(4)
    if not 1 <= order <= 11:
        raise Fault("InvalidInput", None, f"a colour cache of order {order}, 1 to 11 are allowed")
    return 1 << order


def lz77(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    if symbol > 39:
        raise Fault("InvalidInput", None, f"length or distance symbol {symbol}, at most 39 are allowed")
    extra = (symbol - 2) >> 1
    return min(U32_MAX, ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1)


def sub_image(bits: Bits, width: int, height: int, seen: Callable[[int, int], None]) -> None:
    """Follow an entropy-coded image; seen gets the red and green of every literal entry."""
    cache = color_cache(bits)
    green, red, blue, alpha, distance = code_group(bits, cache)
    n, at = min(U32_MAX, width * height), 0
    same_color = not (green.longest or red.longest or blue.longest or alpha.longest)
    while at < n:
        symbol = green.read(bits)
        if symbol < 256:
            r = red.read(bits)
            blue.read(bits)
            alpha.read(bits)
            seen(r, symbol)
            at = n if same_color else at + 1  # codes without bits finish the image at once
        elif symbol < GREEN:
            length = lz77(bits, symbol - 256)
            far = lz77(bits, distance.read(bits))
            if far <= len(NEAR):
                dx, dy = NEAR[far - 1]
                far = max(1, dx + dy * width)
            else:
                far -= len(NEAR)
            if far > at or length > n - at:
                raise Fault("InvalidInput", None, f"{length} pixels from {far} back at pixel {at} of {n}")
            at += length
        else:
            if symbol - GREEN >= cache:
                raise Fault("InvalidInput", None, f"colour {symbol - GREEN} of a cache of {cache}")
            at = n if not green.longest else at + 1


def _blocks(n: int, order: int) -> int:
    return -(-n >> order) if n >= 0 else 0


def _predictor(_: int, green: int) -> None:
    if green > 13:
        raise Fault("InvalidInput", None, f"predictor {green}, at most 13 are allowed")


def check_image(data: bytes, width: int, height: int) -> None:
    """Raises Fault if the bit stream of an image of that size isn't valid."""
    bits, done = Bits(data), set()
    while bits.read(1):
        kind, narrow = bits.read(2), width
        if kind in (PREDICTOR, COLOR):
            order = 2 + bits.read(3)
            sub_image(bits, _blocks(width, order), _blocks(height, order), _predictor if kind == PREDICTOR else lambda *_: None)
        elif kind == INDEXING:
            colors = 1 + bits.read(8)
            sub_image(bits, colors, 1, lambda *_: None)
            narrow = _blocks(width, 3 if colors <= 2 else 2 if colors <= 4 else 1 if colors <= 16 else 0)
        if kind in done:
            raise Fault("InvalidInput", None, f"transform {kind} a second time")
        done.add(kind)
        width = narrow
    cache, groups = color_cache(bits), [0]
    if bits.read(1):
        order = 2 + bits.read(3)

        def seen(red: int, green: int) -> None:
            groups[0] = max(groups[0], red << 8 | green)

        sub_image(bits, _blocks(width, order), _blocks(height, order), seen)
    for _ in range(groups[0] + 1):
        code_group(bits, cache)
