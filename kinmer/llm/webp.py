"""Lossless WebP (VP8L): a decoder of the whole format and an encoder for byte payloads.

`decode` reads any VP8L image: prefix codes with and without an entropy image, LZ77 back-references
with the short-distance map, colour cache, and the inverse of the predictor, cross-colour,
subtract-green and palette transforms. Bits are read least significant first.

`encode` stores a payload as a grey image, a sample a byte: a palette lists the payload's bytes by
frequency, so one of a few fixed prefix codes over ranks suits any script, and passages that repeat
become back-references. A colour cache, predictors and cross-colour never pay for palette indices of
text: the encoder doesn't write them.

`decode_many` decodes a batch in step, up to four literals of every image at a time, where only one
channel carries bits; back-references are then resolved in order, and the palette is looked up. Any
other image of the batch goes through `decode`.
"""

from __future__ import annotations

import bisect
import functools
import heapq
import itertools
import struct
from dataclasses import dataclass

import numpy as np

MAX_SIDE = 1 << 14
#: Pixels in the least row of a payload's image, one a byte.
WIDTH = 192
#: Most payload bytes in one image; a longer payload is several images in a row.
MAX_PAYLOAD = MAX_SIDE // WIDTH * WIDTH * MAX_SIDE
#: Bytes that repeat at least, and at most, in a back-reference, and how far back.
LEAST_COPY, MOST_COPY, FAR = 12, 4096, 1 << 19
#: Payload bytes searched for repeats and packed at once.
CHUNK = 1 << 20

# Fixed values of the format: order in which code-length code lengths are stored.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
# Fixed values of the format: the 120 nearest pixels as (x to the left, y up), in order of distance code.
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
CACHE_HASH = 0x1E35A7BD
GREEN, RED, BLUE, ALPHA, DISTANCE = range(5)
#: Place of green in a decoded pixel.
GREEN_SAMPLE = 1


class BitReader:
    """Bits of a byte string, least significant first; reading past the end is an error."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.size, self.at = data, 8 * len(data), at

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        got = self.peek(n)
        self.at += n
        if self.at > self.size:
            raise ValueError("the image ends early")
        return got


    def follows(self, value: int, n: int) -> bool:
        """Whether the next n bits are these."""
        byte = self.at >> 3
        got = int.from_bytes(self.data[byte : byte + (n >> 3) + 2], "little") >> (self.at & 7)
        return self.at + n <= self.size and got & ((1 << n) - 1) == value

    def taken(self, start: int) -> int:
        """The bits read since `start`."""
        got = int.from_bytes(self.data[start >> 3 : (self.at >> 3) + 1], "little") >> (start & 7)
        return got & ((1 << (self.at - start)) - 1)


class BitWriter:
    def __init__(self) -> None:
        self.value, self.at = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.at
        self.at += n

    def bytes(self) -> bytes:
        return self.value.to_bytes((self.at + 7) // 8, "little")


class PrefixCode:
    """A canonical prefix code as one lookup table: `table[next bits] = symbol << 4 | length`."""

    def __init__(self, lengths: list[int]):
        used = [(n, s) for s, n in enumerate(lengths) if n]
        self.bits = max((n for n, _ in used), default=0)
        self.largest = max((s for _, s in used), default=0)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.codes: dict[int, tuple[int, int]] = {}
        if len(used) == 1:
            self.bits, self.flat, self.table = 0, 0, np.array([used[0][1] << 4], np.int32)
            self.codes[used[0][1]] = (0, 0)
            return
        code = last = 0
        for n, s in sorted(used):
            code <<= n - last
            last = n
            turned = int(f"{code:0{n}b}"[::-1], 2)
            self.table[turned :: 1 << n] = s << 4 | n
            self.codes[s] = (turned, n)
            code += 1
        if used and code != 1 << last:
            raise ValueError("not a complete prefix code")
        self.flat = self.bits if all(n == self.bits for n, _ in used) else None

    @functools.cached_property
    def entries(self) -> list[int]:
        return self.table.tolist()

    def read(self, bits: BitReader) -> int:
        entry = int(self.table[bits.peek(self.bits)])
        bits.read(entry & 15)
        return entry >> 4


#: Codes read before, by alphabet: (their description's bits, how many, the code). A description ends itself.
_codes_seen: dict[int, list[tuple[int, int, PrefixCode]]] = {}
MOST_SEEN = 24


def _read_code(bits: BitReader, alphabet: int) -> PrefixCode:
    seen = _codes_seen.setdefault(alphabet, [])
    for value, n, code in seen:
        if bits.follows(value, n):
            bits.at += n
            return code
    start = bits.at
    code = _parse_code(bits, alphabet)
    if len(seen) < MOST_SEEN:
        seen.append((bits.taken(start), bits.at - start, code))
    return code


def _parse_code(bits: BitReader, alphabet: int) -> PrefixCode:
    if bits.read(1):
        lengths = [0] * 256
        both = bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if both:
            lengths[bits.read(8)] = 1
        return PrefixCode(lengths)
    own = [0] * 19
    for k in CODE_LENGTH_ORDER[: 4 + bits.read(4)]:
        own[k] = bits.read(3)
    meta = PrefixCode(own)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    lengths, last = [], 8
    while len(lengths) < alphabet and left:
        left -= 1
        s = meta.read(bits)
        if s < 16:
            lengths.append(s)
            last = s or last
        elif s == 16:
            lengths += [last] * (3 + bits.read(2))
        else:
            lengths += [0] * (3 + bits.read(3) if s == 17 else 11 + bits.read(7))
    if len(lengths) > alphabet:
        raise ValueError("too many code lengths")
    return PrefixCode(lengths)


@dataclass
class Header:
    """What precedes an image's pixels."""

    width: int
    height: int
    transforms: list[tuple]
    coded_width: int
    cache_bits: int
    group_bits: int
    groups_of: np.ndarray | None
    groups: list[list[PrefixCode]]


def _parts(side: int, bits: int) -> int:
    return (side + (1 << bits) - 1) >> bits


def _extra(bits: BitReader, symbol: int) -> int:
    """The value of a length or distance symbol."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.read(more) + 1


def _read_header(bits: BitReader) -> Header:
    if bits.read(8) != 0x2F:
        raise ValueError("not a VP8L image")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    transforms, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise ValueError("a transform is given twice")
        if kind < 2:
            size = bits.read(3) + 2
            transforms.append((kind, size, _read_image(bits, _parts(coded, size), _parts(height, size), False)))
        elif kind == 2:
            transforms.append((kind, 0, None))
        else:
            n = bits.read(8) + 1
            palette = _read_image(bits, n, 1, False).view(np.uint8).reshape(n, 4)
            palette = np.cumsum(palette, axis=0, dtype=np.uint8).view(np.uint32).ravel()
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, pack, palette, coded))
            coded = _parts(coded, pack)
    return _read_codes(bits, width, height, coded, transforms, True)


def _read_codes(bits: BitReader, width: int, height: int, coded: int, transforms: list, whole: bool) -> Header:
    cache_bits = bits.read(4) if bits.read(1) else 0
    group_bits, groups_of, n = 0, None, 1
    if whole and bits.read(1):
        group_bits = bits.read(3) + 2
        groups_of = (_read_image(bits, _parts(coded, group_bits), _parts(height, group_bits), False) >> 8) & 0xFFFF
        groups_of = groups_of.reshape(-1, _parts(coded, group_bits))
        n = int(groups_of.max()) + 1
    sizes = (256 + 24 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    groups = [[_read_code(bits, size) for size in sizes] for _ in range(n)]
    return Header(width, height, transforms, coded, cache_bits, group_bits, groups_of, groups)


def _read_image(bits: BitReader, width: int, height: int, whole: bool) -> np.ndarray:
    return _read_pixels(bits, _read_codes(bits, width, height, width, [], whole))


def _read_flat(bits: BitReader, codes: list[PrefixCode], total: int) -> np.ndarray | None:
    """Pixels of codes that each have one length, so that a pixel has as many bits as any other; None otherwise."""
    if any(code.flat is None for code in codes[:ALPHA + 1]) or codes[GREEN].largest > 255:
        return None
    each = sum(code.bits for code in codes[: ALPHA + 1])
    if bits.at + total * each > bits.size:
        raise ValueError("the image ends early")
    byte = bits.at >> 3
    some = np.frombuffer(bits.data[byte : byte + (total * each + 14) // 8 + 1], np.uint8)
    rows = np.unpackbits(some, bitorder="little")[bits.at & 7 :][: total * each].reshape(total, each)
    out, at = np.zeros(total, np.uint32), 0
    for code, shift in zip(codes, (8, 16, 0, 24)):
        if not code.bits:
            out |= np.uint32(int(code.table[0]) >> 4 << shift)
            continue
        value = rows[:, at : at + code.bits].astype(np.int64) @ (1 << np.arange(code.bits, dtype=np.int64))
        out |= (code.table[value] >> 4).astype(np.uint32) << np.uint32(shift)
        at += code.bits
    bits.at += total * each
    return out


def _read_pixels(bits: BitReader, head: Header) -> np.ndarray:
    """Entropy-coded pixels as uint32 ARGB, in row order."""
    width, total = head.coded_width, head.coded_width * head.height
    if not head.cache_bits and head.groups_of is None and (flat := _read_flat(bits, head.groups[0], total)) is not None:
        return flat
    out, cache, cached = [0] * total, [0] * (1 << head.cache_bits), 0
    shift, at = 32 - head.cache_bits, 0

    def remember(upto: int) -> None:
        nonlocal cached
        for k in range(cached, upto):
            cache[(CACHE_HASH * out[k] & 0xFFFFFFFF) >> shift] = out[k]
        cached = upto

    while at < total:
        if head.groups_of is None:
            codes = head.groups[0]
        else:
            codes = head.groups[head.groups_of[(at // width) >> head.group_bits, (at % width) >> head.group_bits]]
        s = codes[GREEN].read(bits)
        if s < 256:
            red, blue, alpha = codes[RED].read(bits), codes[BLUE].read(bits), codes[ALPHA].read(bits)
            out[at] = alpha << 24 | red << 16 | s << 8 | blue
            at += 1
        elif s < 280:
            length = _extra(bits, s - 256)
            back = _extra(bits, codes[DISTANCE].read(bits))
            if back > 120:
                back -= 120
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > at or at + length > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            if s - 280 >= 1 << head.cache_bits or not head.cache_bits:
                raise ValueError("no such entry in the colour cache")
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _average(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) >> 1


def _predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The format's 14 predictors over the samples (int32) of one pixel."""
    if mode == 0 or mode > 13:
        return np.array([0, 0, 0, 255], np.int32)  # B, G, R, A
    if mode <= 4:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode <= 10:
        pair = ((left, top_left), (left, top), (top_left, top), (top, top_right))
        return _average(*pair[mode - 6]) if mode < 10 else _average(_average(left, top_left), _average(top, top_right))
    if mode == 11:
        near_left, near_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if near_left < near_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    mean = _average(left, top)
    return np.clip(mean + np.trunc((mean - top_left) / 2).astype(np.int32), 0, 255)


def _undo_predictor(px: np.ndarray, size: int, modes: np.ndarray, width: int) -> np.ndarray:
    rows = px.view(np.uint8).reshape(-1, width, 4).astype(np.int32)
    modes = ((modes >> 8) & 0xFF).reshape(-1, _parts(width, size))
    black = np.array([0, 0, 0, 255], np.int32)
    for y in range(len(rows)):
        for x in range(width):
            if x == 0:
                guess = black if y == 0 else rows[y - 1, 0]
            elif y == 0:
                guess = rows[0, x - 1]
            else:
                # Right of the last column the format continues with the current row's first pixel.
                right = rows[y - 1, x + 1] if x + 1 < width else rows[y, 0]
                guess = _predict(int(modes[y >> size, x >> size]), rows[y, x - 1], rows[y - 1, x], rows[y - 1, x - 1], right)
            rows[y, x] = (rows[y, x] + guess) & 255
    return rows.astype(np.uint8).reshape(-1, 4).view(np.uint32).ravel()


def _undo_cross_colour(px: np.ndarray, size: int, tables: np.ndarray, width: int) -> np.ndarray:
    height = len(px) // width
    y, x = np.divmod(np.arange(len(px)), width)
    table = tables.reshape(_parts(height, size), _parts(width, size))[y >> size, x >> size]
    by = table.view(np.uint8).reshape(-1, 4).view(np.int8).astype(np.int32)  # green to red, green to blue, red to blue
    out = px.copy().view(np.uint8).reshape(-1, 4)
    green = out[:, 1].view(np.int8).astype(np.int32)
    red = (out[:, 2].astype(np.int32) + ((by[:, 0] * green) >> 5)) & 255
    blue = out[:, 0].astype(np.int32) + ((by[:, 1] * green) >> 5)
    blue = (blue + ((by[:, 2] * red.astype(np.uint8).view(np.int8).astype(np.int32)) >> 5)) & 255
    out[:, 2], out[:, 0] = red, blue
    return out.reshape(-1).view(np.uint32)


def _undo_palette(px: np.ndarray, pack: int, palette: np.ndarray, width: int, coded: int) -> np.ndarray:
    index = ((px >> 8) & 0xFF).reshape(-1, coded)
    if pack:
        each = 8 >> pack
        shifts = np.arange(0, 8, each, dtype=np.uint32)
        index = ((index[:, :, None] >> shifts) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros(256, np.uint32)  # an index past the palette is transparent black
    table[: len(palette)] = palette
    return table[index.ravel()]


def _undo(px: np.ndarray, head: Header) -> np.ndarray:
    width = head.coded_width
    for kind, size, data, *more in reversed(head.transforms):
        if kind == 0:
            px = _undo_predictor(px, size, data, width)
        elif kind == 1:
            px = _undo_cross_colour(px, size, data, width)
        elif kind == 2:
            part = px.copy().view(np.uint8).reshape(-1, 4)
            part[:, 0] += part[:, 1]
            part[:, 2] += part[:, 1]
            px = part.reshape(-1).view(np.uint32)
        else:
            px = _undo_palette(px, size, data, more[0], width)
            width = more[0]
    return px


def _stream(file: bytes) -> bytes:
    """The VP8L chunk of a simple WebP file."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    return file[20 : 20 + int.from_bytes(file[16:20], "little")]


def split_files(media: bytes) -> list[bytes]:
    """The images stored one after the other; an over-long payload has more than one."""
    out, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        out.append(media[at : at + size])
        at += size
    return out


def decode(file: bytes) -> np.ndarray:
    """(height, width, 4) uint8 samples in the order B, G, R, A."""
    bits = BitReader(_stream(file))
    head = _read_header(bits)
    return _undo(_read_pixels(bits, head), head).view(np.uint8).reshape(head.height, head.width, 4)


def code_lengths(weights: list[int]) -> list[int]:
    """Lengths of an optimal prefix code for positive weights; zero weights get none."""
    heap = [(w, i, (s,)) for i, (s, w) in enumerate((s, w) for s, w in enumerate(weights) if w)]
    lengths, n = [0] * len(weights), len(heap)
    heapq.heapify(heap)
    while len(heap) > 1:
        (a, _, x), (b, _, y) = heapq.heappop(heap), heapq.heappop(heap)
        for s in x + y:
            lengths[s] += 1
        n += 1
        heapq.heappush(heap, (a + b, n, x + y))
    return lengths


def _limited_lengths(weights: list[float], most: int) -> list[int]:
    """`code_lengths` with none over `most`: small weights are raised until it holds."""
    floor = 0.0
    while True:
        lengths = code_lengths([max(w, floor) if w else 0 for w in weights])
        if max(lengths) <= most:
            return lengths
        floor = max(2 * floor, sum(weights) / 2 ** (most + 2))


def _put_code(out: BitWriter, lengths: list[int]) -> None:
    """The description of a code of more than two symbols: its lengths, runs of them by symbols 16 to 18."""
    tokens: list[tuple[int, int, int]] = []
    for value, run in itertools.groupby(lengths):
        n = len(list(run))
        if value:
            tokens.append((value, 0, 0))
            n -= 1
        while n:
            if value and n >= 3:
                tokens.append((16, min(n, 6) - 3, 2))
                n -= min(n, 6)
            elif not value and n >= 11:
                tokens.append((18, min(n, 138) - 11, 7))
                n -= min(n, 138)
            elif not value and n >= 3:
                tokens.append((17, n - 3, 3))
                n = 0
            else:
                tokens.append((value, 0, 0))
                n -= 1
    tally = [0] * 19
    for t, _, _ in tokens:
        tally[t] += 1
    own = _limited_lengths(tally, 7)
    if sum(map(bool, own)) == 1:
        own[own.index(max(own))] = 1
    order = [own[k] for k in CODE_LENGTH_ORDER]
    count = max(4, max(k + 1 for k, n in enumerate(order) if n))
    out.put(0, 1)
    out.put(count - 4, 4)
    for n in order[:count]:
        out.put(n, 3)
    out.put(0, 1)
    codes = PrefixCode(own).codes
    for t, extra, n in tokens:
        out.put(*codes[t])
        out.put(extra, n)


def _prefix(value: int) -> tuple[int, int, int]:
    """(symbol, extra bits, their value) of a length or distance of at least 1: the inverse of `_extra`."""
    if value <= 4:
        return value - 1, 0, 0
    n = (value - 1).bit_length() - 1
    return 2 * n + ((value - 1) >> (n - 1) & 1), n - 1, (value - 1) & ((1 << (n - 1)) - 1)


#: A code with the one symbol 0 and no bits: (bits, their count).
ONE_SYMBOL = (0b0001, 4)
#: Most bits of a literal or length, so that four literals often fit in a window of WINDOW bits.
MOST_BITS, WINDOW = 13, 16
#: Down to so many images they are decoded in step, the last ones one by one.
ALONE = 12


@dataclass(frozen=True)
class Profile:
    """A fixed code over ranks of bytes, and lengths of copies if it has any, as written and as read."""

    turned: np.ndarray
    lengths: np.ndarray
    description: tuple[int, int]
    copies: bool


@functools.cache
def distance_code() -> tuple[PrefixCode, tuple[int, int]]:
    out = BitWriter()
    lengths = _limited_lengths([8] * 4 + [2] * 8 + [8] * 16 + [1] * 12, 7)
    _put_code(out, lengths)
    return PrefixCode(lengths), (out.value, out.at)


@functools.cache
def profiles() -> list[Profile]:
    """Codes for ranks whose frequency falls fast, as in one alphabet, or slowly, as in bytes of many; each with and without copies."""
    told = []
    for fall, flat in itertools.product((8.0, 14.0, 24.0, 48.0), (1e-4, 1e-3)):
        ranks = np.exp(-np.arange(256) / fall) / fall + flat / 4
        for share in (0.0, 0.04):
            copies = [share / 24 * (3 if 5 <= k <= 12 else 0.5) for k in range(24)]
            lengths = _limited_lengths([*ranks.tolist(), *copies], MOST_BITS)
            out = BitWriter()
            _put_code(out, lengths)
            for _ in (256, 256, 256):
                out.put(*ONE_SYMBOL)
            out.put(*(distance_code()[1] if share else ONE_SYMBOL))
            codes = PrefixCode(lengths).codes
            turned = np.array([codes.get(k, (0, 0))[0] for k in range(280)], np.uint64)
            told.append(Profile(turned, np.array(lengths, np.int64), (out.value, out.at), share > 0))
    return told


@functools.cache
def _costs(copies: bool) -> tuple[list[Profile], np.ndarray]:
    some = [p for p in profiles() if p.copies == copies]
    return some, np.stack([p.lengths[:256] for p in some])


@functools.cache
def _palette_code() -> tuple[int, int]:
    """Codes of a palette's steps: 8 bits of green, one of alpha (0 or 255)."""
    out = BitWriter()
    _put_code(out, [8] * 256 + [0] * 24)
    out.put(*ONE_SYMBOL)
    out.put(*ONE_SYMBOL)
    out.put(0b11111111_0_0_11, 12)  # a simple code: two symbols, 0 in one bit, 255 in eight
    out.put(*ONE_SYMBOL)
    return out.value, out.at


_REVERSED = np.array([int(f"{k:08b}"[::-1], 2) for k in range(256)])


def _shape_of(size: int) -> tuple[int, int]:
    """(width, height) of the image of a payload, a positive multiple of 192 bytes."""
    rows = size // WIDTH
    wide = -(-rows // MAX_SIDE)
    return WIDTH * wide, -(-rows // wide)


def repeats(data: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, distance) of passages of at least LEAST_COPY bytes that stand earlier, in order, none overlapping."""
    n = len(data) - LEAST_COPY + 1
    if n < 2:
        return []
    wide = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (n + 4,), (1,))
    mixed = wide[:n] * np.uint64(0x9E3779B97F4A7C15) ^ wide[4:] * np.uint64(0xC2B2AE3D27D4EB4F)
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1])
    if not len(same):
        return []
    before = np.full(n, -1, np.int64)
    before[order[same + 1]] = order[same]
    starts = np.flatnonzero(before >= 0)
    sources = before[starts].tolist()
    starts = starts.tolist()
    out, k, body = [], 0, data.tobytes()
    while k < len(starts):
        at, source = starts[k], sources[k]
        most = min(MOST_COPY, len(data) - at)
        step = 32
        length = 0
        while length < most:
            a, b = body[at + length : at + min(most, length + step)], body[source + length : source + min(most, length + step)]
            if a != b:
                length += next(i for i, (x, y) in enumerate(zip(a, b)) if x != y)
                break
            length += len(a)
            step *= 4
        if length >= LEAST_COPY and at - source <= FAR:
            out.append((at, length, at - source))
            k = bisect.bisect_left(starts, at + length, k + 1)
        else:
            k += 1
    return out


@functools.cache
def _near_codes(width: int) -> dict[int, int]:
    """Distance -> its short code, the least of several."""
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(NEAR, 1):
        out.setdefault(max(1, x + y * width), k)
    return out


def _pack(value: np.ndarray, bits: np.ndarray, at: int) -> tuple[bytes, int]:
    """Values of at most 57 bits each, one after the other from bit `at` of the first byte: (bytes, bits in all and `at`)."""
    after = np.cumsum(bits) + at
    begin = after - bits
    word, low = begin >> 6, (begin & 63).astype(np.uint64)
    out = np.zeros(int(after[-1] >> 6) + 2, np.uint64)
    edge = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out[word[edge]] = np.bitwise_or.reduceat(value << low, edge)
    over = np.flatnonzero((begin & 63) + bits > 64)
    out[word[over] + 1] |= value[over] >> (np.uint64(64) - low[over])
    return out.tobytes()[: (int(after[-1]) + 7) >> 3], int(after[-1])


def encode(payload: bytes) -> bytes:
    """WebP files, one for each MAX_PAYLOAD bytes, whose green samples are the payload's bytes; rows past its end are spaces."""
    return b"".join(_encode_image(payload[k : k + MAX_PAYLOAD]) for k in range(0, len(payload), MAX_PAYLOAD))


def _encode_image(payload: bytes) -> bytes:
    width, height = _shape_of(len(payload))
    data = np.frombuffer(payload.ljust(width * height, b" "), np.uint8)
    tally = np.bincount(data, minlength=256)
    # Bytes by frequency; at least 17, since fewer would be packed into shared pixels.
    palette = np.argsort(-tally, kind="stable")[: max(17, np.count_nonzero(tally))]
    rank = np.zeros(256, np.int64)
    rank[palette] = np.arange(len(palette))

    copies = [(start + at, n, far) for start in range(0, len(data), CHUNK) for at, n, far in repeats(data[start : start + CHUNK])]
    literal = np.ones(len(data), bool)
    for at, n, _ in copies:
        literal[at : at + n] = False
    counts = np.bincount(rank[data[literal]], minlength=256)
    some, lengths = _costs(bool(copies))
    profile = some[int((lengths @ counts).argmin())]

    stream = BitWriter()
    stream.put(0x2F | (width - 1) << 8 | (height - 1) << 22 | 1 << 36, 40)
    stream.put(1 | 3 << 1 | (len(palette) - 1) << 3, 11)
    stream.put(0, 1)
    stream.put(*_palette_code())
    steps = _REVERSED[np.diff(palette, prepend=0) & 255].astype(np.uint64)
    steps[0] |= np.uint64(1 << 8)  # alpha steps from 0 to 255 once
    packed, n = _pack(steps, np.full(len(steps), 9, np.int64), 0)
    stream.put(int.from_bytes(packed, "little"), n)
    stream.put(0, 3)
    stream.put(*profile.description)

    symbol = rank[data]
    value, bits = profile.turned[symbol], profile.lengths[symbol]
    if copies:
        keep = literal
        distances, near = distance_code()[0].codes, _near_codes(width)
        for at, n, far in copies:
            s, s_bits, s_extra = _prefix(n)
            d, d_bits, d_extra = _prefix(near.get(far, far + 120))
            code, size = int(profile.turned[256 + s]), int(profile.lengths[256 + s])
            for part, part_bits in ((s_extra, s_bits), distances[d], (d_extra, d_bits)):
                code |= part << size
                size += part_bits
            keep[at], value[at], bits[at] = True, code, size
        value, bits = value[keep], bits[keep]
    body, at = bytearray(stream.bytes()), stream.at
    for start in range(0, len(value), CHUNK):
        fresh, end = _pack(value[start : start + CHUNK], bits[start : start + CHUNK], at & 7)
        if at & 7:
            body[-1] |= fresh[0]
            fresh = fresh[1:]
        body += fresh
        at += end - (at & 7)
    odd = len(body) & 1
    riff = struct.pack("<4sI8sI", b"RIFF", 12 + len(body) + odd, b"WEBPVP8L", len(body))
    return riff + bytes(body) + b"\0" * odd


def samples(file: bytes) -> np.ndarray:
    """(height, width) uint8: the green samples of an image."""
    return decode(file)[:, :, GREEN_SAMPLE]


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """`samples` of each file. Images in which only green carries bits, with one set of codes, go in step."""
    streams = [_stream(f) for f in files]
    readers = [BitReader(s) for s in streams]
    heads = [_read_header(r) for r in readers]
    out: list[np.ndarray | None] = [None] * len(files)
    together: dict[tuple[int, int], list[int]] = {}
    for k, head in enumerate(heads):
        codes = head.groups[0]
        bare = not head.cache_bits and head.groups_of is None and not any(c.bits for c in codes[RED:DISTANCE])
        palette = not head.transforms or len(head.transforms) == 1 and head.transforms[0][:2] == (3, 0)
        if bare and palette and codes[GREEN].bits <= MOST_BITS:
            together.setdefault((id(codes[GREEN]), id(codes[DISTANCE])), []).append(k)
    for members in together.values():
        done = _in_step([streams[k] for k in members], [readers[k].at for k in members], [heads[k] for k in members])
        for k, px in zip(members, done):
            out[k] = px
    return [samples(f) if px is None else px for f, px in zip(files, out)]


def _lookup(code: PrefixCode) -> np.ndarray:
    """For each WINDOW bits: up to four literals (32 bits), their bits (8) and number (3), and a mark where a copy comes first."""
    table, mask = code.table.astype(np.int64), (1 << code.bits) - 1
    window = np.arange(1 << WINDOW, dtype=np.int64)
    used, count, out = np.zeros_like(window), np.zeros_like(window), np.zeros_like(window)
    going = np.ones(len(window), bool)
    for k in range(4):
        entry = table[(window >> used) & mask]
        literal = entry >> 4 < 256
        fits = used + (entry & 15) <= WINDOW
        if k == 0:
            out[~literal] |= 1 << 43
        going &= literal & fits
        out[going] |= (entry[going] >> 4) << 8 * k
        used[going] += entry[going] & 15
        count[going] += 1
    return out | used << 32 | count << 40


_lookups: dict[int, tuple[PrefixCode, np.ndarray, list[int]]] = {}


def _lookup_of(code: PrefixCode) -> tuple[np.ndarray, list[int]]:
    kept = _lookups.get(id(code))
    if kept is None or kept[0] is not code:
        if len(_lookups) >= MOST_SEEN:
            _lookups.clear()
        table = _lookup(code)
        kept = _lookups[id(code)] = code, table, table.tolist()
    return kept[1:]


def _in_step(streams: list[bytes], begins: list[int], heads: list[Header]) -> list[np.ndarray | None]:
    """The green samples of each stream; None where it isn't a whole image."""
    green, distance = heads[0].groups[0][GREEN], heads[0].groups[0][DISTANCE]
    table, single, single_mask = _lookup_of(green)[0], green.table.astype(np.int64), np.int64((1 << green.bits) - 1)
    far_table, far_mask = distance.table.astype(np.int64), np.int64((1 << distance.bits) - 1)
    sizes = np.array([h.width * h.height for h in heads])
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    lengths = np.array([len(s) for s in streams])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    windows = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (len(data) - 8,), (1,))
    last = np.int64(len(data) - 16)
    first = np.concatenate([[0], np.cumsum(sizes + 4)[:-1]])  # four bytes apart: literals are written by fours
    buffer = np.zeros(int(sizes.sum()) + 4 * len(sizes) + 8, np.uint8)
    fours = np.lib.stride_tricks.as_strided(buffer[:4].view("<u4"), (len(buffer) - 4,), (1,))
    at, place = 8 * starts + np.array(begins), first.copy()
    limit, end, who = 8 * (starts + lengths), first + sizes, np.arange(len(sizes))
    fine = np.ones(len(sizes), bool)
    copies: list[tuple[np.ndarray, ...]] = []
    mask, seven = np.int64((1 << WINDOW) - 1), np.int64(7)
    while len(who) > ALONE:
        window = windows[at >> 3].view(np.int64) >> (at & seven)
        entry = table[window & mask]
        fours[place] = entry.astype(np.uint32)
        at += (entry >> 32) & 255
        place += (entry >> 40) & 7
        marked = entry >> 43
        if marked.any():
            odd = marked.nonzero()[0]
            size, far, used = _copies(window[odd], single, single_mask, far_table, far_mask, windows, at[odd], last)
            copies.append((who[odd], place[odd], size, far))
            at[odd] += used
            place[odd] += size
            bad = (size <= 0) | (place[odd] > end[odd])
            fine[who[odd[bad]]] = False
            place[odd[bad]] = end[odd[bad]]
        stays = (place < end) & (at < limit)
        if not stays.all():
            short = (place < end) & (at >= limit)
            fine[who[short]] = False
            over = at - limit > WINDOW
            fine[who[over]] = False
            at, place, limit, end, who = at[stays], place[stays], limit[stays], end[stays], who[stays]
    if len(who):
        told = []
        for k, *state in zip(*(c.tolist() for c in (who, at, limit, place, end))):
            own = _alone(data, memoryview(buffer), green, distance, *state)
            fine[k] &= own is not None
            told += [(k, *c) for c in own or ()]
        if told:
            copies.append(tuple(np.array(c, np.int64) for c in zip(*told)))
    if copies:
        _resolve(copies, buffer, first, fine, [h.coded_width for h in heads])
    out: list[np.ndarray | None] = []
    for k, head in enumerate(heads):
        px = buffer[first[k] : first[k] + sizes[k]]
        if fine[k] and head.transforms:
            colours = np.zeros(256, np.uint8)
            palette = head.transforms[0][2]
            colours[: len(palette)] = (palette >> 8) & 0xFF
            px = colours[px]
        out.append(px.reshape(head.height, head.width) if fine[k] else None)
    return out


def _alone(
    data: np.ndarray, body: memoryview, green: PrefixCode, distance: PrefixCode, at: int, limit: int, place: int, end: int
) -> list[tuple[int, int, int]] | None:
    """The rest of one image, as `_in_step` does it: its (place, length, distance code) of copies, None if it breaks off."""
    table, single = _lookup_of(green)[1], green.entries
    far_table, single_mask, far_mask = distance.entries, (1 << green.bits) - 1, (1 << distance.bits) - 1
    blob, copies, base = data[at >> 3 : (limit >> 3) + 16].tobytes(), [], at & ~7
    at, limit = at - base, limit - base
    while place < end:
        if at >= limit:
            return None
        window = int.from_bytes(blob[at >> 3 : (at >> 3) + 10], "little") >> (at & 7)
        entry = table[window & 0xFFFF]
        if entry >> 43:
            part = single[window & single_mask]
            bits = BitReader(blob, at + (part & 15))
            if (part >> 4) - 256 >= 24:
                return None
            size = _extra(bits, (part >> 4) - 256)
            part = far_table[bits.peek(distance.bits) & far_mask]
            bits.at += part & 15
            copies.append((place, size, _extra(bits, part >> 4)))
            at = bits.at
            place += size
        else:
            body[place : place + 4] = (entry & 0xFFFFFFFF).to_bytes(4, "little")
            at += entry >> 32 & 255
            place += entry >> 40 & 7
    return copies if place - end < 4 and at - limit <= WINDOW else None


def _copies(window, single, single_mask, far_table, far_mask, windows, at, last):  # noqa: ANN001, ANN202
    """(length, distance code, bits used) of the back-references that begin at these windows."""
    entry = single[window & single_mask]
    used, symbol = entry & 15, (entry >> 4) - 256
    size, more = _values(symbol, window >> used)
    used = used + more
    where = at + used
    window = windows[np.minimum(where >> 3, last)].view(np.int64) >> (where & 7)
    entry = far_table[window & far_mask]
    far, more = _values(entry >> 4, window >> (entry & 15))
    return np.where(symbol < 24, size, 0), far, used + (entry & 15) + more


def _values(symbol: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`_extra` of many symbols: (values, extra bits)."""
    more = np.where(symbol < 4, 0, (symbol - 2) >> 1)
    value = np.where(symbol < 4, symbol, ((2 + (symbol & 1)) << more) + (window & ((np.int64(1) << more) - 1)))
    return value + 1, more


def _resolve(copies: list[tuple[np.ndarray, ...]], buffer: np.ndarray, first: np.ndarray, fine: np.ndarray, widths: list[int]) -> None:
    """Carry out the back-references of all images, each image's in order."""
    who, place, size, far = (np.concatenate(c) for c in zip(*copies))
    near = np.array(NEAR)
    width = np.array(widths)[who]
    short = near[np.minimum(far, len(NEAR)) - 1]
    far = np.where(far > len(NEAR), far - len(NEAR), np.maximum(1, short[:, 0] + short[:, 1] * width))
    fine[who[far > place - first[who]]] = False
    order = np.argsort(place, kind="stable")
    body = memoryview(buffer)
    for k, at, n, back in zip(*(c[order].tolist() for c in (who, place, size, far))):
        if not fine[k]:
            continue
        if back >= n:
            body[at : at + n] = body[at - back : at - back + n]
        else:
            buffer[at : at + n] = np.resize(buffer[at - back : at], n)
