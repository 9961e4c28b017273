"""Progressive JPEG in numpy, many images at a time.

Coefficients are arrays of blocks (rows) by zigzag position (64 columns). Entropy-coded data is read in lanes, the stretches between
restart markers: every step decodes one symbol of each lane at once, so an image with restart markers, or a
batch of images, costs few numpy calls for each coefficient. Decoding handles spectral selection and successive approximation
(first and refining scans of DC and AC, end-of-band runs), any Huffman tables, 8 bits, sampling factors, restart intervals.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np

U = np.uint64


def zigzag() -> np.ndarray:
    """Natural position (8 * row + column) of each zigzag position."""
    return np.array(sorted(range(64), key=lambda p: (p // 8 + p % 8, p // 8 if (p // 8 + p % 8) % 2 else p % 8)))


def inverse_transform() -> np.ndarray:
    """Matrix from 64 coefficients in zigzag order to 64 samples, times 2 ** 13 in whole numbers, so that sums are exact in any order."""
    k = np.arange(8)
    basis = np.cos((2 * k[None] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, 0.125**0.5, 0.5)[:, None]
    both = np.einsum("ux,vy->uvxy", basis, basis).reshape(64, 64)
    return np.rint(both[zigzag()] * 2**13)


INVERSE = inverse_transform()


def canonical(lengths: dict[int, int]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A DHT body, and code and length by symbol, for code lengths by symbol."""
    order = sorted(lengths, key=lambda s: (lengths[s], s))
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in order:
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], sizes[s] = code, last
        code += 1
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return counts + bytes(order), codes, sizes


@functools.lru_cache(maxsize=64)
def lookup(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Symbol and code length by the next 16 bits, and the table's name."""
    symbol, size, at, k = np.zeros(65536, np.int64), np.zeros(65536, np.int64), 0, 0
    for n in range(1, 17):
        for _ in range(counts[n - 1]):
            symbol[at : at + (1 << (16 - n))], size[at : at + (1 << (16 - n))] = symbols[k], n
            at, k = at + (1 << (16 - n)), k + 1
    return symbol, size, counts + symbols


#: The encoder's tables, by rule: short codes for what bytes of text need, 12 bits for the rest.
DC_TABLE = canonical({s: 4 for s in range(12)})
AC_TABLE = canonical({s: 4 for s in range(1, 9)} | {0x00: 5} | {(r << 4) | s: 12 for r in range(16) for s in range(11) if (r or s > 8) and (r, s) != (0, 0)})


@dataclass
class Scan:
    components: tuple[int, ...]
    first: int
    last: int
    high: int
    low: int
    tables: tuple = ()  # (symbol, size) for each component: of DC where first is 0, else of AC
    interval: int = 0
    data: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))


@dataclass
class Image:
    width: int
    height: int
    sampling: tuple[tuple[int, int], ...]
    quant: tuple
    scans: list[Scan]
    comment: bytes = b""


def grids(image: Image) -> list[tuple[int, int, int]]:
    """(rows, columns, first row of `coefficients`) of each component's blocks, padded to whole MCUs."""
    h, v = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    across, down = -(-image.width // (8 * h)), -(-image.height // (8 * v))
    out, at = [], 0
    for x, y in image.sampling:
        out.append((down * y, across * x, at))
        at += down * y * across * x
    return out


def order_of(image: Image, components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    """Blocks in the order of a scan, their components' places in it, and the blocks of an MCU. Not to be written to: small pictures of one shape share them."""
    small = image.width * image.height <= MOST_SHARED
    return (shared_order if small else order)(image.width, image.height, image.sampling, components)


def order(width: int, height: int, sampling: tuple[tuple[int, int], ...], components: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, int]:
    h, v = max(s[0] for s in sampling), max(s[1] for s in sampling)
    g = grids(Image(width, height, sampling, (), []))
    if len(components) == 1:
        (x, y), (_, columns, at) = sampling[components[0]], g[components[0]]
        rows, wide = -(-height * y // (8 * v)), -(-width * x // (8 * h))
        blocks = at + (np.arange(rows)[:, None] * columns + np.arange(wide)).reshape(-1)
        return blocks, np.zeros(len(blocks), np.int64), 1
    across, down = -(-width // (8 * h)), -(-height // (8 * v))
    parts, which = [], []
    for k, c in enumerate(components):
        (x, y), (_, columns, at) = sampling[c], g[c]
        my, mx, by, bx = np.ix_(np.arange(down), np.arange(across), np.arange(y), np.arange(x))
        parts.append((at + (my * y + by) * columns + mx * x + bx).reshape(down * across, -1))
        which += [k] * (x * y)
    return np.concatenate(parts, 1).reshape(-1), np.tile(which, down * across), len(which)


#: Pixels of a picture whose order is held, and how many orders are (a picture has up to four).
MOST_SHARED = 1 << 18
shared_order = functools.lru_cache(maxsize=1024)(order)


def parse(stream: bytes) -> Image:
    raw = np.frombuffer(stream, np.uint8)
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    marks = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7)) & (after != 0xFF)]
    at, quant, huffman, interval, image = 2, {}, {}, 0, None
    while True:
        kind, size = stream[at + 1], struct.unpack(">H", stream[at + 2 : at + 4])[0] if stream[at + 1] != 0xD9 else 0
        body = stream[at + 4 : at + 2 + size]
        at += 2 + size
        if kind == 0xD9:
            return image
        if kind == 0xDB:
            while body:
                quant[body[0] & 15], body = np.frombuffer(body[1:65], np.uint8).astype(np.int64), body[65:]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huffman[body[0]], body = lookup(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif kind == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            _, height, width, n = struct.unpack(">BHHB", body[:6])
            specs = [body[6 + 3 * k : 9 + 3 * k] for k in range(n)]
            names = [s[0] for s in specs]
            image = Image(width, height, tuple((s[1] >> 4, s[1] & 15) for s in specs), tuple(quant[s[2]] for s in specs), [], comment)
        elif kind == 0xDA:
            n = body[0]
            first, last, bits = body[1 + 2 * n :]
            use = [body[2 + 2 * k] >> 4 if first == 0 else 0x10 | body[2 + 2 * k] & 15 for k in range(n)]
            stop = int(marks[np.searchsorted(marks, at)])
            tables = tuple(huffman[t] for t in use) if not (first == 0 and bits >> 4) else ()
            image.scans.append(Scan(tuple(names.index(body[1 + 2 * k]) for k in range(n)), first, last, bits >> 4, bits & 15, tables, interval, raw[at:stop]))
            at = stop


class Bits:
    """Lanes of one scan of several images: a window on 33 bits or more at any bit."""

    def __init__(self, parts: list[np.ndarray]) -> None:
        raw = np.concatenate([*parts, np.zeros(1, np.uint8)])
        ff = np.flatnonzero(raw[:-1] == 0xFF)
        after = raw[ff + 1]
        restart, stuffed = ff[(after >= 0xD0) & (after <= 0xD7)], ff[after == 0]
        keep = np.ones(len(raw), bool)
        keep[restart] = keep[restart + 1] = keep[stuffed + 1] = False
        ends = np.cumsum([len(p) for p in parts])
        cuts = np.sort(np.concatenate([restart, ends - np.array([len(p) for p in parts])]))
        self.start = (np.cumsum(keep) - keep)[cuts] * 8  # the first bit of each lane, image after image
        self.lanes = np.diff(np.searchsorted(cuts, np.concatenate([[0], ends]), "left"))
        held = np.concatenate([raw[keep], np.zeros(8, np.uint8)]).astype(U)
        self.window = held[:-4] << U(56) | held[1:-3] << U(48) | held[2:-2] << U(40) | held[3:-1] << U(32) | held[4:] << U(24)

    def peek(self, at: np.ndarray) -> np.ndarray:
        return self.window[at >> 3] << (at & 7).astype(U)


def signed(extra: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(extra < (1 << np.maximum(size - 1, 0)), extra - (1 << size) + 1, extra)


def field_of(x: np.ndarray, skip: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`size` bits after `skip` bits; 0 where size is 0."""
    return np.where(size > 0, ((x << skip.astype(U)) >> (64 - np.maximum(size, 1)).astype(U)).astype(np.int64), 0)


def decode(images: list[Image]) -> list[np.ndarray]:
    """Coefficients of each image: blocks of all components by zigzag position. Images of one shape of scans go together."""
    totals = [sum(r * c for r, c, _ in grids(i)) for i in images]
    bases = np.cumsum([0, *totals])
    coefficients = np.zeros((bases[-1], 64), np.int64)
    groups: dict[tuple, list[int]] = {}
    for k, i in enumerate(images):
        groups.setdefault((i.sampling, tuple((s.components, s.first, s.last, s.high, s.low, tuple(t[2] for t in s.tables)) for s in i.scans)), []).append(k)
    for members in groups.values():
        for n, scan in enumerate(images[members[0]].scans):
            some = [images[k].scans[n] for k in members]
            order, which, begin, end = [], [], [], []
            at = 0
            for k, s in zip(members, some, strict=True):
                o, w, mcu = order_of(images[k], s.components)
                step = s.interval * mcu or len(o)
                begin.append(at + np.arange(0, len(o), step))
                end.append(at + np.minimum(np.arange(step, len(o) + step, step), len(o)))
                order.append(o + bases[k])
                which.append(w)
                at += len(o)
            bits = Bits([s.data for s in some])
            run = (dc_refine if scan.high else dc_first) if scan.first == 0 else (ac_refine if scan.high else ac_first)
            run(coefficients, scan, np.concatenate(order), np.concatenate(which), bits, bits.start.copy(), np.concatenate(begin), np.concatenate(end))
    return [coefficients[a:b] for a, b in zip(bases, bases[1:], strict=False)]


def dc_first(out, scan, order, which, bits, at, block, end) -> None:
    before = np.zeros((len(at), len(scan.components)), np.int64)
    symbols, sizes = np.stack([t[0] for t in scan.tables]), np.stack([t[1] for t in scan.tables])
    lane = np.arange(len(at))
    while len(lane):
        c = which[block]
        x = bits.peek(at)
        code = (x >> U(48)).astype(np.int64)
        size, skip = symbols[c, code], sizes[c, code]
        before[lane, c] += signed(field_of(x, skip, size), size)
        out[order[block], 0] = before[lane, c] << scan.low
        at, block = at + skip + size, block + 1
        go = block < end
        lane, at, block, end = lane[go], at[go], block[go], end[go]


def dc_refine(out, scan, order, which, bits, at, block, end) -> None:
    while len(at):
        out[order[block], 0] |= (bits.peek(at) >> U(63)).astype(np.int64) << scan.low
        at, block = at + 1, block + 1
        go = block < end
        at, block, end = at[go], block[go], end[go]


def ac_first(out, scan, order, which, bits, at, block, end) -> None:
    symbols, sizes, _ = scan.tables[0]
    flat, k = out.reshape(-1), np.full(len(at), scan.first)
    while len(at):
        x = bits.peek(at)
        code = (x >> U(48)).astype(np.int64)
        symbol, skip = symbols[code], sizes[code]
        run, size = symbol >> 4, symbol & 15
        ends = (size == 0) & (run < 15)
        n = np.where(ends, run, size)
        extra = field_of(x, skip, n)
        k = k + run
        put = size > 0
        flat[order[block[put]] * 64 + k[put]] = signed(extra, size)[put] << scan.low
        at = at + skip + n
        over = ends | (k >= scan.last)
        block = block + np.where(ends, (1 << run) + extra, over)
        k = np.where(over, scan.first, k + 1)
        if over.any() and not (go := block < end).all():
            at, block, end, k = at[go], block[go], end[go], k[go]


def ac_refine(out, scan, order, which, bits, at, block, end) -> None:
    symbols, sizes, _ = scan.tables[0]
    flat, one = out.reshape(-1), 1 << scan.low
    k, run, new, band = np.full(len(at), scan.first), np.full(len(at), -1), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    while len(at):
        if (need := np.flatnonzero((run < 0) & (band == 0))).size:
            x = bits.peek(at[need])
            code = (x >> U(48)).astype(np.int64)
            symbol, skip = symbols[code], sizes[code]
            r, s = symbol >> 4, symbol & 15
            ends = (s == 0) & (r < 15)
            n = np.where(ends, r, s)
            extra = field_of(x, skip, n)
            band[need] = np.where(ends, (1 << r) + extra, 0)
            run[need] = np.where(ends, -1, r)
            new[need] = np.where(s > 0, np.where(extra > 0, one, -one), 0)
            at[need] += skip + n
        spot = order[block] * 64 + k
        value = flat[spot]
        old = value != 0
        bit = (bits.peek(at) >> U(63)).astype(np.int64) * old
        placed = ~old & (band == 0) & (run == 0)
        flat[spot] = np.where(old, value + np.where(bit & ((np.abs(value) & one) == 0), np.sign(value) * one, 0), np.where(placed, new, value))
        at = at + old
        run = np.where(~old & (band == 0), run - 1, run)
        k = k + 1
        over = k > scan.last
        band, block, k = band - (over & (band > 0)), block + over, np.where(over, scan.first, k)
        if over.any() and not (go := block < end).all():
            at, block, end, k, run, new, band = (v[go] for v in (at, block, end, k, run, new, band))


def rgb(image: Image, coefficients: np.ndarray) -> np.ndarray:
    """The picture in full resolution: (height, width, 3) bytes. Chroma is upsampled by repetition."""
    h, v = max(s[0] for s in image.sampling), max(s[1] for s in image.sampling)
    planes = []
    for (x, y), (rows, columns, at), q in zip(image.sampling, grids(image), image.quant, strict=True):
        samples = (coefficients[at : at + rows * columns] * q).astype(np.float64) @ INVERSE
        plane = np.clip((samples.astype(np.int64) + 2**12 >> 13) + 128, 0, 255).astype(np.int32).reshape(rows, columns, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, columns * 8)
        planes.append(np.repeat(np.repeat(plane, v // y, 0), h // x, 1)[: image.height, : image.width])
    y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
    # the usual conversion, in 16ths of a bit's 12
    red, green, blue = y + (5743 * cr + 2048 >> 12), y - (1410 * cb + 2925 * cr - 2048 >> 12), y + (7258 * cb + 2048 >> 12)
    return np.clip(np.stack([red, green, blue], 2), 0, 255).astype(np.uint8)


# --- encoding


def packed(value: np.ndarray, size: np.ndarray, lane: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of tokens in order, each lane from a whole byte and filled with ones: (bytes, bytes of each lane)."""
    used = np.bincount(lane, size, lanes).astype(np.int64)
    wide = (used + 7) >> 3
    fill = wide * 8 - used
    last = np.searchsorted(lane, np.arange(lanes), "right")
    value, size, lane = (np.insert(a, last, b) for a, b in ((value, (1 << fill) - 1), (size, fill), (lane, np.arange(lanes))))
    in_lane = np.cumsum(size) - size
    first = np.searchsorted(lane, np.arange(lanes))
    start = np.cumsum(wide) - wide
    at = in_lane - in_lane[first][lane] + start[lane] * 8
    word, shift = at >> 5, 64 - (at & 31) - size  # a token spans two words of 32 bits at most
    both = value.astype(U) << shift.astype(U)
    out = np.zeros(int(wide.sum() // 4) + 3, U)
    high, low = both >> U(32), both & U(0xFFFFFFFF)
    heads = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[heads]] += np.add.reduceat(high, heads)
    out[word[heads] + 1] += np.add.reduceat(low, heads)
    return out.astype(">u4").view(np.uint8)[: int(wide.sum())], wide


def scan_bytes(value, size, lane, lanes_of: np.ndarray) -> list[bytes]:
    """The entropy-coded data of each image, whose lanes follow one another: stuffed, with restart markers between lanes."""
    raw, wide = packed(value, size, lane, int(lanes_of.sum()))
    stuffed = (raw == 0xFF).astype(np.int64)
    start = np.cumsum(wide) - wide
    lane_of = np.repeat(np.arange(len(wide)), wide)
    first_lane = np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    number = np.arange(len(wide)) - first_lane  # of a lane in its image
    ahead = np.cumsum(number > 0)  # restart markers so far
    at = np.arange(len(raw)) + np.cumsum(stuffed) - stuffed + 2 * ahead[lane_of]
    out = np.zeros(len(raw) + int(stuffed.sum()) + 2 * int((number > 0).sum()), np.uint8)
    out[at] = raw
    lane_at = at[start]
    marked = number > 0
    out[lane_at[marked] - 2], out[lane_at[marked] - 1] = 0xFF, 0xD0 + (number[marked] - 1) % 8
    heads = np.append(lane_at[np.cumsum(lanes_of) - lanes_of], len(out))
    return [out[a:b].tobytes() for a, b in zip(heads, heads[1:], strict=False)]


def bit_length(x: np.ndarray) -> np.ndarray:
    return np.frexp(x.astype(np.float32))[1].astype(np.int64)


def amplitude(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.where(v < 0, v + (1 << size) - 1, v)


def dc_tokens(dc: np.ndarray, luma: int, low: int):
    """First scan of DC, one MCU (row: `luma` blocks, Cb, Cr) a lane."""
    v = dc >> low
    difference = v.copy()
    difference[:, 1:luma] -= v[:, : luma - 1]
    size = bit_length(np.abs(difference))
    _, codes, lengths = DC_TABLE
    return (codes[size] << size | amplitude(difference, size)).reshape(-1), (lengths[size] + size).reshape(-1), np.repeat(np.arange(len(dc)), dc.shape[1])


def ac_tokens(band: np.ndarray, low: int):
    """First scan of a band, a block a lane."""
    v = np.sign(band) * (np.abs(band) >> low)
    rest = (v[:, -1:] == 0).astype(v.dtype)
    lane, k = np.nonzero(np.concatenate([v, rest], 1))
    end = k == band.shape[1]
    before = np.where(np.diff(lane, prepend=-1) > 0, -1, np.concatenate([[-1], k[:-1]]))
    run = np.where(end, 0, k - before - 1)
    value = np.where(end, 0, v[lane, np.minimum(k, band.shape[1] - 1)])
    size = bit_length(np.abs(value))
    _, codes, lengths = AC_TABLE
    symbol = np.where(end, 0, (run & 15) << 4 | size)
    token, wide = codes[symbol] << size | amplitude(value, size), lengths[symbol] + size
    skips = run >> 4
    if skips.any():  # sixteen zeros at a time
        where = np.repeat(np.arange(len(lane)), skips)
        return np.insert(token, where, codes[0xF0]), np.insert(wide, where, lengths[0xF0]), np.insert(lane, where, lane[where])
    return token, wide, lane


def ac_refine_tokens(band: np.ndarray):
    """Refining scan of the lowest bit of a band of 15 coefficients at most, a block a lane."""
    n, w = band.shape
    size = np.abs(band)
    old, new = size > 1, size == 1
    turn = np.cumsum(new, 1) - new  # new ones before this place
    zero = ~old & ~new
    gaps = np.cumsum(zero, 1)
    last = np.maximum.accumulate(np.where(new, np.arange(w), -1), 1)
    prior = np.concatenate([np.full((n, 1), -1), last[:, :-1]], 1)
    run = gaps - np.where(prior >= 0, np.take_along_axis(gaps, np.maximum(prior, 0), 1), 0)
    _, codes, lengths = AC_TABLE
    symbol = codes[run << 4 | 1] << 1 | (band > 0)
    more = last[:, -1:] < w - 1
    total = new.sum(1, keepdims=True)
    there = np.concatenate([new, old, more], 1)
    key = np.concatenate([turn * 64, turn * 64 + 1 + np.arange(w), total * 64], 1)
    value = np.concatenate([symbol, size & 1, np.full((n, 1), codes[0])], 1)
    wide = np.concatenate([lengths[run << 4 | 1] + 1, np.ones_like(size), np.full((n, 1), lengths[0])], 1)
    by = np.argsort(key, 1, kind="stable")
    there, value, wide = (np.take_along_axis(a, by, 1) for a in (there, value, wide))
    lane = np.nonzero(there)[0]
    return value[there], wide[there], lane


def segment(kind: int, body: bytes) -> bytes:
    return bytes([0xFF, kind]) + struct.pack(">H", len(body) + 2) + body


#: Scan script of the encoder: the band that is refined, and the one sent whole.
REFINED, WHOLE = (1, 5), (6, 63)


def encode(blocks: list[np.ndarray], comments: list[bytes]) -> list[bytes]:
    """A progressive JPEG (4:2:0, quantisers of 1) for each array of MCUs (n, 6, 64): four blocks of Y, one of Cb, one of Cr, by zigzag position.

    MCUs fill rows of 64, or of more where the picture would be too high. Every MCU (DC) or block (AC) is a restart interval.
    """
    shaped, shapes = [], []
    for b in blocks:
        across = max(min(len(b), 64), -(-len(b) // 4095))
        down = -(-len(b) // across)
        shaped.append(np.concatenate([b, np.zeros((across * down - len(b), 6, 64), b.dtype)]))
        shapes.append((down, across))
    mcus = np.concatenate(shaped).astype(np.int64)
    n = np.array([len(s) for s in shaped])
    # a scan of Y alone goes through its blocks row by row, not MCU by MCU
    luma = np.concatenate([s[:, :4].reshape(d, a, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64) for s, (d, a) in zip(shaped, shapes, strict=True)]).astype(np.int64)
    planes = [(luma, n * 4), (mcus[:, 4], n), (mcus[:, 5], n)]
    coded: list[tuple[bytes, list[bytes]]] = []
    head = lambda components, first, last, high, low: segment(0xDA, bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([first, last, high << 4 | low]))
    every = (1, 2, 3)
    coded.append((head(every, 0, 0, 0, 1), scan_bytes(*dc_tokens(mcus[:, :, 0], 4, 1), n)))
    for (first, last), low in ((REFINED, 1), (WHOLE, 0)):
        for c, (plane, lanes) in zip(every, planes, strict=True):
            coded.append((head((c,), first, last, 0, low), scan_bytes(*ac_tokens(plane[:, first : last + 1], low), lanes)))
    coded.append((head(every, 0, 0, 1, 0), scan_bytes((mcus[:, :, 0] & 1).reshape(-1), np.ones(mcus.shape[0] * 6, np.int64), np.repeat(np.arange(len(mcus)), 6), n)))
    for c, (plane, lanes) in zip(every, planes, strict=True):
        coded.append((head((c,), *REFINED, 1, 0), scan_bytes(*ac_refine_tokens(plane[:, REFINED[0] : REFINED[1] + 1]), lanes)))
    out = []
    tables = segment(0xDB, b"\0" + b"\1" * 64) + segment(0xC4, b"\0" + DC_TABLE[0]) + segment(0xC4, b"\x10" + AC_TABLE[0]) + segment(0xDD, struct.pack(">H", 1))
    for k, ((down, across), comment) in enumerate(zip(shapes, comments, strict=True)):
        frame = segment(0xC2, struct.pack(">BHHB", 8, down * 16, across * 16, 3) + b"\1\x22\0\2\x11\0\3\x11\0")
        out.append(b"\xff\xd8" + segment(0xFE, comment) + tables + frame + b"".join(h + data[k] for h, data in coded) + b"\xff\xd9")
    return out
