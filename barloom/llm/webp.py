"""Lossless WebP (VP8L) in numpy: a full decoder, and an encoder for byte payloads.

The decoder reads simple files (one VP8L chunk) and tiled ones (VP8X, with an ANMF frame for each
tile). It decodes prefix codes, meta prefix codes, back-references and the colour cache, and inverts
the predictor, cross-colour, subtract-green and palette transforms. Images are decoded side by side:
step p of the loop makes pixel p of every image still running, so numpy works on whole rows of lanes;
inner images (modes, elements, palettes) run so too, and transforms are inverted for all images at once.

The encoder stores a payload as RGB pixels, 64 to a row, in tiles of at most 64 x 64 pixels, so that no
lane is long however long the text. A tile is written in the shorter of two forms: predicted, with the mode of each
block of 4 x 4 pixels and the cross-colour element of each of 32 x 32 chosen by coded size; or, if it has at most
256 colours, as a palette and indices. Both hold back-references at any distance, colour-cache hits and literals, in
prefix codes whose lengths follow from rules, the same for every text.
"""

from __future__ import annotations

import heapq
import struct
from functools import lru_cache

import numpy as np

WIDTH = 64
TILE_ROWS = 64
ROW_BYTES = 3 * WIDTH
#: Rows encoded side by side.
ENCODED_ROWS = 1400
CACHE_BITS = 8
CACHE_MULTIPLIER = 0x1E35A7BD
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
SIGNATURE = 0x2F

# Fixed values of the format: the order of code length code lengths, and the near distances (x, y).
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
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
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)


# ---- prefix codes -----------------------------------------------------------------------------


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Bit-reversed canonical codes, as they stand in the stream."""
    codes, code = np.zeros(len(lengths), np.int64), 0
    for n in range(1, int(lengths.max(initial=0)) + 1):
        code <<= 1
        for symbol in np.flatnonzero(lengths == n):
            codes[symbol] = int(format(code, f"0{n}b")[::-1], 2)
            code += 1
    return codes


def lookup_table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """(table, bits): table[next `bits` bits] = symbol | length << 16. One symbol takes no bits."""
    used = np.flatnonzero(lengths)
    if len(used) == 0:
        return np.zeros(1, np.int64), 0
    if len(used) == 1:
        return np.array([used[0]], np.int64), 0
    bits, codes = int(lengths.max()), canonical(lengths)
    if (1 << bits) != sum(1 << (bits - int(lengths[s])) for s in used):
        raise ValueError("prefix code is not complete")
    table = np.zeros(1 << bits, np.int64)
    for s in used:
        table[int(codes[s]) :: 1 << int(lengths[s])] = int(s) | int(lengths[s]) << 16
    return table, bits


class BitReader:
    """Least significant bit first."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def __call__(self, n: int) -> int:
        lo = self.at >> 3
        word = int.from_bytes(self.data[lo : lo + 8], "little") >> (self.at & 7)
        self.at += n
        return word & ((1 << n) - 1)

    def symbol(self, table: np.ndarray, bits: int) -> int:
        lo = self.at >> 3
        word = int.from_bytes(self.data[lo : lo + 8], "little") >> (self.at & 7)
        found = int(table[word & ((1 << bits) - 1)])
        self.at += found >> 16
        return found & 0xFFFF


class BitWriter:
    def __init__(self):
        self.value, self.n = 0, 0

    def __call__(self, value: int, n: int) -> None:
        self.value |= int(value) << self.n
        self.n += n


def read_code(read: BitReader, size: int) -> np.ndarray:
    """The code lengths of one prefix code over `size` symbols."""
    lengths = np.zeros(size, np.int64)
    if read(1):
        two = read(1)
        first = read(8 if read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[read(8)] = 1
        return lengths
    own = np.zeros(19, np.int64)
    for symbol in CODE_LENGTH_ORDER[: 4 + read(4)]:
        own[symbol] = read(3)
    table, bits = lookup_table(own)
    left = 2 + read(2 + 2 * read(3)) if read(1) else size
    at, before = 0, 8
    while at < size and left:
        left -= 1
        symbol = read.symbol(table, bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            before = symbol or before
        else:
            n = read((2, 3, 7)[symbol - 16]) + (3, 3, 11)[symbol - 16]
            if at + n > size:
                raise ValueError("code lengths run over the alphabet")
            lengths[at : at + n] = before if symbol == 16 else 0
            at += n
    return lengths


def write_code(write: BitWriter, lengths: np.ndarray) -> None:
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (len(used) == 0 or used.max() < 256):
        write(1, 1)
        write(len(used) == 2, 1)
        first = int(used[0]) if len(used) else 0
        write(first > 1, 1)
        write(first, 8 if first > 1 else 1)
        if len(used) == 2:
            write(int(used[1]), 8)
        return
    steps, at, before = [], 0, 8
    while at < len(lengths):
        n = 1
        while at + n < len(lengths) and lengths[at + n] == lengths[at]:
            n += 1
        at += n
        value = int(lengths[at - 1])
        while n:
            if value == 0 and n >= 3:
                take = min(n, 138)
                steps.append((18, take - 11, 7) if take >= 11 else (17, take - 3, 3))
            elif value and value == before and n >= 3:
                take = min(n, 6)
                steps.append((16, take - 3, 2))
            else:
                take = 1
                steps.append((value, 0, 0))
                before = value or before
            n -= take
    counts = np.bincount([s for s, _, _ in steps], minlength=19)
    own = huffman_lengths(counts, 7)
    codes = canonical(own) if (own > 0).sum() > 1 else np.zeros(19, np.int64)
    sizes = own if (own > 0).sum() > 1 else np.zeros(19, np.int64)
    n = max(4, max(i + 1 for i, s in enumerate(CODE_LENGTH_ORDER) if own[s]))
    write(0, 1)
    write(n - 4, 4)
    for symbol in CODE_LENGTH_ORDER[:n]:
        write(int(own[symbol]), 3)
    write(0, 1)
    for symbol, extra, bits in steps:
        write(int(codes[symbol]), int(sizes[symbol]))
        write(extra, bits)


def huffman_lengths(weights: np.ndarray, most: int) -> np.ndarray:
    """Huffman code lengths of at most `most` bits; small weights are raised until they fit."""
    used, lengths = np.flatnonzero(weights), np.zeros(len(weights), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    floor = 0
    while True:
        heap = [(max(int(weights[s]), floor), int(s), (int(s),)) for s in used]
        heapq.heapify(heap)
        lengths[:] = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            lengths[list(a[2] + b[2])] += 1
            heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
        if lengths.max() <= most:
            return lengths
        floor = max(1, floor * 2, int(weights[used].min()) * 2)


def prefix_of(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, extra bits, extra value) of lengths or distances from 1."""
    x = np.maximum(np.asarray(value, np.int64) - 1, 0)
    high = np.where(x > 1, np.int64(np.floor(np.log2(np.maximum(x, 1)))), 1)
    small = x < 4
    second = (x >> (high - 1)) & 1
    bits = np.where(small, 0, high - 1)
    return np.where(small, x, 2 * high + second), bits, np.where(small, 0, x & ((1 << bits) - 1))


# ---- decoding ---------------------------------------------------------------------------------


class Job:
    """One entropy-coded image still to be decoded: where its bits begin, its size, codes and groups."""

    def __init__(self, at, width, height, groups, group_of, cache_bits):
        self.at, self.width, self.height = at, width, height
        self.groups, self.group_of, self.cache_bits = groups, group_of, cache_bits


class CodeGroup:
    """Five lookup tables: green with lengths and cache, red, blue, alpha, distance."""

    def __init__(self, lengths: list[np.ndarray]):
        self.tables = [lookup_table(x) for x in lengths]


def read_job(read: BitReader, data: bytes, width: int, height: int, main: bool) -> Job:
    cache_bits = 0
    if read(1):
        cache_bits = read(4)
        if not 1 <= cache_bits <= 11:
            raise ValueError("colour cache size")
    group_of, n_groups = None, 1
    if main and read(1):
        bits = read(3) + 2
        w = -(-width >> bits)
        h = -(-height >> bits)
        w, h = (width + (1 << bits) - 1) >> bits, (height + (1 << bits) - 1) >> bits
        image = decode_now(read, data, w, h)
        meta = ((image >> 8) & 0xFFFF).astype(np.int64).reshape(h, w)
        n_groups = int(meta.max()) + 1
        group_of = np.repeat(np.repeat(meta, 1 << bits, 0), 1 << bits, 1)[:height, :width].ravel()
    sizes = [LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES]
    groups = [CodeGroup([read_code(read, n) for n in sizes]) for _ in range(n_groups)]
    return Job(read.at, width, height, groups, group_of, cache_bits)


def decode_now(read: BitReader, data: bytes, width: int, height: int) -> np.ndarray:
    """Decode an inner image at once and move the reader behind it."""
    job = read_job(read, data, width, height, main=False)
    pixels, ends = decode_lanes(words_at(data), [job])
    read.at = int(ends[0])
    return pixels[0]


def words_at(data: bytes) -> np.ndarray:
    """The 64 bits from each byte of the streams on; sixteen spare bytes follow them."""
    buffer = np.frombuffer(data + bytes(16), np.uint8)
    words = np.zeros(len(buffer) - 8, np.uint64)
    for k in range(8):
        words |= buffer[k : k + len(words)].astype(np.uint64) << np.uint64(8 * k)
    return words.view(np.int64)


def decode_lanes(words: np.ndarray, jobs: list[Job]) -> tuple[list[np.ndarray], np.ndarray]:
    """Pixels (ARGB, uint32) of every job, and the bit where each ends.

    `words` are those of all streams; a job's `at` counts their bits. Jobs that share their code groups share tables.
    """
    n_px = np.array([j.width * j.height for j in jobs], np.int64)
    order = np.argsort(-n_px, kind="stable")

    # All tables in one array for each of the five codes; a lane's group says where its own begin.
    first_group: dict[int, int] = {}
    all_groups: list[CodeGroup] = []
    for j in jobs:
        if id(j.groups) not in first_group:
            first_group[id(j.groups)] = len(all_groups)
            all_groups += j.groups
    tables, starts, masks = [], [], []
    for k in range(5):
        parts = [g.tables[k] for g in all_groups]
        starts.append(np.cumsum([0] + [len(t) for t, _ in parts[:-1]]).astype(np.int64))
        masks.append(np.array([(1 << b) - 1 for _, b in parts], np.int64))
        tables.append(np.concatenate([t for t, _ in parts]))
    single = len(all_groups) == 1
    alpha_fixed = bool((masks[3] == 0).all())

    lanes = [jobs[i] for i in order]
    pos = np.array([j.at for j in lanes], np.int64)
    width = np.array([j.width for j in lanes], np.int64)
    shift = np.array([32 - j.cache_bits if j.cache_bits else 32 for j in lanes], np.int64)
    caches = bool((shift < 32).any())
    cache_of = np.cumsum([0] + [1 << j.cache_bits for j in lanes[:-1]]).astype(np.int64)
    cache = np.zeros(sum(1 << j.cache_bits for j in lanes), np.int64)
    base = np.array([first_group[id(j.groups)] for j in lanes], np.int64)
    metas = [k for k, j in enumerate(lanes) if j.group_of is not None]
    size = n_px[order]
    steps = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(steps), side="left")  # lanes with more than p pixels
    out = np.zeros((steps, len(lanes)), np.uint32)
    flat = out.reshape(-1)
    left = np.zeros(len(lanes), np.int64)  # pixels still to copy
    back = np.zeros(len(lanes), np.int64)
    copying = False

    def value(lane, prefix):
        """Length or distance of prefix codes; reads the extra bits."""
        extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
        w = words[pos[lane] >> 3] >> (pos[lane] & 7)
        pos[lane] += extra
        return np.where(prefix < 4, prefix + 1, ((2 + (prefix & 1)) << extra) + (w & ((1 << extra) - 1)) + 1)

    near = np.array(NEAR, np.int64)
    for p in range(steps):
        n = int(alive[p])
        at = pos[:n]
        w = words[at >> 3] >> (at & 7)
        if single:
            g = 0
        else:
            g = base[:n]
            if metas:
                g = g.copy()
                for k in metas:
                    if k < n:
                        g[k] += lanes[k].group_of[p]
        tab = lambda k, bits: tables[k][starts[k][g] + (bits & masks[k][g])]  # noqa: B023, E731
        green = tab(0, w)
        symbol, used = green & 0xFFFF, green >> 16
        red = tab(1, w >> used)
        used = used + (red >> 16)
        blue = tab(2, w >> used)
        used = used + (blue >> 16)
        if alpha_fixed:
            alpha = tab(3, w)
        else:
            after = at + used
            alpha = tab(3, words[after >> 3] >> (after & 7))
            used = used + (alpha >> 16)
        pixel = (alpha & 0xFF) << 24 | (red & 0xFF) << 16 | symbol << 8 | (blue & 0xFF)
        special = symbol >= LITERALS
        if copying:
            held = left[:n] > 0
            special &= ~held
            used = np.where(held, 0, used)
        odd = np.flatnonzero(special)
        if len(odd):
            what = symbol[odd]
            used[odd] = green[odd] >> 16
            pos[:n] += used
            hits = odd[what >= LITERALS + LENGTHS]
            if len(hits):
                pixel[hits] = cache[cache_of[hits] + symbol[hits] - LITERALS - LENGTHS]
            refs = odd[what < LITERALS + LENGTHS]
            if len(refs):
                left[refs] = value(refs, symbol[refs] - LITERALS)
                d_group = 0 if single else g[refs]
                word = words[pos[refs] >> 3] >> (pos[refs] & 7)
                code = tables[4][starts[4][d_group] + (word & masks[4][d_group])]
                pos[refs] += code >> 16
                far = value(refs, code & 0xFFFF)
                xy = near[np.minimum(far, len(NEAR)) - 1]
                far = np.where(far > len(NEAR), far - len(NEAR), np.maximum(1, xy[:, 0] + xy[:, 1] * width[refs]))
                if (far > p).any():
                    raise ValueError("back-reference before the first pixel")
                back[refs] = far
                copying = True
        else:
            pos[:n] += used
        if copying:
            held = np.flatnonzero(left[:n] > 0)
            if len(held):
                pixel[held] = flat[(p - back[held]) * len(lanes) + held]
                left[held] -= 1
            else:
                copying = False
        out[p, :n] = pixel
        if caches:
            slot = ((pixel & 0xFFFFFFFF) * CACHE_MULTIPLIER & 0xFFFFFFFF) >> shift[:n]
            cache[cache_of[:n] + slot] = pixel
    pixels, ends = [None] * len(jobs), np.zeros(len(jobs), np.int64)
    columns = np.ascontiguousarray(out.T)
    for lane, i in enumerate(order):
        pixels[i], ends[i] = columns[lane, : size[lane]], pos[lane]
    return pixels, ends


def _split(argb: np.ndarray) -> np.ndarray:
    """(..., 4): alpha, red, green, blue as int64."""
    return np.stack([(argb >> s) & 0xFF for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _join(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.uint32)
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def _guess(mode: int, left: np.ndarray, top: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The prediction of one mode for pixels (..., samples), whole numbers; `right` is the pixel above to the right."""
    mean = lambda a, b: (a + b) >> 1
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return right
    if mode == 4:
        return corner
    if mode == 5:
        return mean(mean(left, right), top)
    if mode == 6:
        return mean(left, corner)
    if mode == 7:
        return mean(left, top)
    if mode == 8:
        return mean(corner, top)
    if mode == 9:
        return mean(top, right)
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    if mode == 11:
        nearer = np.abs(top - corner).sum(-1, keepdims=True) < np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(nearer, left, top)
    if mode == 12:
        return np.clip(left + top - corner, 0, 255)
    if mode == 13:
        a = mean(left, top)
        d = a - corner
        return np.clip(a + np.where(d < 0, -((-d) >> 1), d >> 1), 0, 255)
    return np.broadcast_to(np.array([255, 0, 0, 0][-left.shape[-1] :], left.dtype), left.shape)  # black


def undo_predictors(tiles: list[np.ndarray], modes: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Add the prediction to each pixel of each tile. Tiles are (height, width) of one width; modes are those of their blocks.

    All tiles side by side. The first row and column, and blocks predicted as black, depend on nothing beyond
    themselves and take a few steps; other blocks go pixel by pixel, all tiles with that mode there at once.
    """
    width, tall = tiles[0].shape[1], max(len(t) for t in tiles)
    c = np.zeros((len(tiles), tall, width, 4), np.uint8)
    mode = np.zeros((len(tiles), -(-tall >> bits), -(-width >> bits)), np.uint8)
    for k, (t, m) in enumerate(zip(tiles, modes, strict=True)):
        c[k, : len(t)] = np.ascontiguousarray(t).astype(">u4").view(np.uint8).reshape(*t.shape, 4)
        mode[k, : len(m)] = m
    c[:, 0, 0, 0] += 255
    c[:, 0] = np.cumsum(c[:, 0], 1, dtype=np.uint8)
    c[:, :, 0] = np.cumsum(c[:, :, 0], 1, dtype=np.uint8)
    flat = (mode == 0) | (mode > 13)
    block_y, block_x = np.arange(tall) >> bits, np.arange(width) >> bits
    c[:, 1:, 1:, 0] += flat[:, block_y[1:]][:, :, block_x[1:]] * np.uint8(255)
    rows = [[[(m, np.flatnonzero(mode[:, y, x] == m)) for m in np.unique(mode[:, y, x][~flat[:, y, x]]).tolist()] for x in range(mode.shape[2])] for y in range(mode.shape[1])]
    for y in range(1, tall):
        for x in range(1, width):
            for m, who in rows[y >> bits][x >> bits]:
                at = lambda j, i, who=who: c[who, j, i].astype(np.int16)
                right = at(y - 1, x + 1) if x + 1 < width else at(y, 0)
                c[who, y, x] += _guess(m, at(y, x - 1), at(y - 1, x), at(y - 1, x - 1), right).astype(np.uint8)
    whole = c.view(">u4")[..., 0].astype(np.uint32)
    return [whole[k, : len(t)] for k, t in enumerate(tiles)]


def undo_cross_colours(tiles: list[np.ndarray], elements: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """Tiles of one width, each with the elements of its blocks; all rows at once."""
    width = tiles[0].shape[1]
    e = np.concatenate([np.repeat(m, 1 << bits, 0)[: len(t)] for t, m in zip(tiles, elements, strict=True)])
    rows = np.concatenate(tiles)
    some = np.flatnonzero((e & 0xFFFFFF).any(1))  # the others stay as they are
    if len(some):
        c, e = _split(rows[some]), np.repeat(e[some], 1 << bits, 1)[:, :width]
        signed = lambda v: ((v & 0xFF).astype(np.int64) ^ 0x80) - 0x80
        green = signed(c[..., 2])
        red = (c[..., 1] + ((signed(e) * green) >> 5)) & 255
        blue = (c[..., 3] + ((signed(e >> 8) * green) >> 5) + ((signed(e >> 16) * signed(red)) >> 5)) & 255
        c[..., 1], c[..., 3] = red, blue
        rows[some] = _join(c)
    return np.split(rows, np.cumsum([len(t) for t in tiles])[:-1])


def undo_subtract_green(argb: np.ndarray) -> np.ndarray:
    c = _split(argb)
    c[..., 1] = (c[..., 1] + c[..., 2]) & 255
    c[..., 3] = (c[..., 3] + c[..., 2]) & 255
    return _join(c)


def undo_palette(argb: np.ndarray, colours: np.ndarray, width: int, bundle: int) -> np.ndarray:
    """Pixels hold 1 << bundle indices each in their green samples; indices past the table are clear."""
    x = np.arange(width)
    bits = 8 >> bundle
    green = (argb[:, x >> bundle] >> 8) & 0xFF
    index = (green >> ((x & ((1 << bundle) - 1)) * bits).astype(np.uint32)) & ((1 << bits) - 1)
    table = np.zeros(256, np.uint32)
    table[: len(colours)] = colours
    return table[index]


class Stream:
    """A VP8L stream on its way: where its reader stands, what transforms it has, which inner image is wanted next."""

    def __init__(self, data: bytes, at_bit: int):
        read = BitReader(data, at_bit)
        if read(8) != SIGNATURE:
            raise ValueError("not a VP8L stream")
        self.data, self.width, self.height = data, read(14) + 1, read(14) + 1
        read(1)
        if read(3):
            raise ValueError("VP8L version")
        self.at, self.inner, self.transforms, self.wanted = read.at, self.width, [], None

    def next_job(self, image: np.ndarray | None = None) -> Job:
        """Take the inner image that was wanted and read on: the next one to decode; the main image if `wanted` is None."""
        if self.wanted:
            kind, size, shape = self.wanted
            if kind == PALETTE:
                bundle = 3 if size <= 2 else 2 if size <= 4 else 1 if size <= 16 else 0
                self.transforms.append((kind, bundle, _join(np.cumsum(_split(image), 0) & 255), self.inner))
                self.inner = (self.inner + (1 << bundle) - 1) >> bundle
            else:
                image = image.reshape(shape)
                self.transforms.append((kind, size, (image >> 8) & 0xF if kind == PREDICTOR else image))
            self.wanted = None
        read = BitReader(self.data, self.at)
        while read(1):
            kind = read(2)
            if kind in [t[0] for t in self.transforms]:
                raise ValueError("a transform stands twice")
            if kind == SUBTRACT_GREEN:
                self.transforms.append((kind,))
                continue
            if kind == PALETTE:
                size = read(8) + 1
                shape = (1, size)
            else:
                size = read(3) + 2
                shape = (self.height + (1 << size) - 1) >> size, (self.inner + (1 << size) - 1) >> size
            self.wanted = kind, size, shape
            return known_job(read, self.data, shape[1], shape[0], main=False)
        return known_job(read, self.data, self.inner, self.height, main=True)


#: Codes met before in this process: (main, the 64 bits they begin with) -> [(bits, value, groups, cache bits)]. Equal bits, equal codes.
_KNOWN: dict[tuple[bool, int], list[tuple]] = {}


def known_job(read: BitReader, data: bytes, width: int, height: int, main: bool) -> Job:
    """read_job, but codes that stand as they did in an earlier stream aren't built again."""
    lo, shift = read.at >> 3, read.at & 7
    ahead = lambda bits: int.from_bytes(data[lo : lo + (bits + shift + 7) // 8], "little") >> shift & ((1 << bits) - 1)
    key = main, ahead(64)
    for bits, value, groups, cache_bits in _KNOWN.get(key, ()):
        if ahead(bits) == value:
            return Job(read.at + bits, width, height, groups, None, cache_bits)
    job = read_job(read, data, width, height, main)
    if job.group_of is None and len(_KNOWN) < 64:
        bits = job.at - lo * 8 - shift
        _KNOWN.setdefault(key, []).append((bits, ahead(bits), job.groups, job.cache_bits))
    return job


def decode_streams(data: bytes, begins: list[int]) -> list[np.ndarray]:
    """(height, width) ARGB of the streams that begin at these bytes of `data`, all side by side."""
    words = words_at(data)
    found = [Stream(data, 8 * b) for b in begins]
    jobs: list[Job] = [s.next_job() for s in found]
    while inner := [k for k, s in enumerate(found) if s.wanted]:
        images, ends = decode_lanes(words, [jobs[k] for k in inner])
        for k, image, end in zip(inner, images, ends.tolist(), strict=True):
            found[k].at = end
            jobs[k] = found[k].next_job(image)
    # Main images that share their codes run faster without the others.
    alike: dict[int, list[int]] = {}
    for k, job in enumerate(jobs):
        alike.setdefault(id(job.groups) if job.group_of is None else 0, []).append(k)
    tiles: list = [None] * len(found)
    for group in alike.values():
        for k, pixels in zip(group, decode_lanes(words, [jobs[k] for k in group])[0], strict=True):
            tiles[k] = pixels.reshape(found[k].height, -1)
    for step in range(4):
        batch: dict[tuple, list[int]] = {}
        for k, s in enumerate(found):
            if step < len(s.transforms):
                t = s.transforms[-1 - step]
                batch.setdefault((t[0], t[1] if len(t) > 1 else 0, tiles[k].shape[1]), []).append(k)
        for (kind, size, _), group in batch.items():
            own = [found[k].transforms[-1 - step] for k in group]
            if kind == PREDICTOR:
                undone = undo_predictors([tiles[k] for k in group], [t[2] for t in own], size)
            elif kind == CROSS_COLOUR:
                undone = undo_cross_colours([tiles[k] for k in group], [t[2] for t in own], size)
            elif kind == SUBTRACT_GREEN:
                undone = [undo_subtract_green(tiles[k]) for k in group]
            else:
                undone = [undo_palette(tiles[k], t[2], t[3], t[1]) for k, t in zip(group, own, strict=True)]
            for k, tile in zip(group, undone, strict=True):
                tiles[k] = tile
    return tiles


def chunks(data: bytes) -> list[tuple[bytes, int, int]]:
    """(name, begin, end) of each chunk of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP" or struct.unpack("<I", data[4:8])[0] + 8 > len(data):
        raise ValueError("not a WebP file")
    found, at = [], 12
    end = struct.unpack("<I", data[4:8])[0] + 8
    while at + 8 <= end:
        n = struct.unpack("<I", data[at + 4 : at + 8])[0]
        found.append((data[at : at + 4], at + 8, at + 8 + n))
        at += 8 + n + (n & 1)
    return found


def streams(data: bytes) -> tuple[int, int, list[tuple[int, int, int]]]:
    """Canvas width and height (0 where the only stream says), and (x, y, begin) of each VP8L stream."""
    found, width, height = [], 0, 0
    for name, begin, end in chunks(data):
        if name == b"VP8L":
            found.append((0, 0, begin))
        elif name == b"VP8X":
            width = int.from_bytes(data[begin + 4 : begin + 7], "little") + 1
            height = int.from_bytes(data[begin + 7 : begin + 10], "little") + 1
        elif name == b"ANMF":
            x, y = (2 * int.from_bytes(data[begin + k : begin + k + 3], "little") for k in (0, 3))
            if data[begin + 16 : begin + 20] != b"VP8L":
                raise ValueError("a frame that is not lossless")
            found.append((x, y, begin + 24))
    if not found:
        raise ValueError("no lossless stream")
    return width, height, found


def decode_many(files: list[bytes]) -> list[np.ndarray]:
    """The pixels of each file: (height, width) arrays of ARGB."""
    begins, notes, at = [], [], 0
    for i, data in enumerate(files):
        canvas_w, canvas_h, found = streams(data)
        for x, y, begin in found:
            begins.append(at + begin)
            notes.append((i, x, y, canvas_w, canvas_h))
        at += len(data)
    images: list[np.ndarray | None] = [None] * len(files)
    if not begins:
        return []
    for tile, (i, x, y, canvas_w, canvas_h) in zip(decode_streams(b"".join(files) + bytes(16), begins), notes, strict=True):
        if not canvas_h:
            images[i] = tile
            continue
        if images[i] is None:
            images[i] = np.zeros((canvas_h, canvas_w), np.uint32)
        images[i][y : y + tile.shape[0], x : x + tile.shape[1]] = tile
    return images


# ---- encoding ---------------------------------------------------------------------------------


def _weights(size: int, cache: bool) -> np.ndarray:
    """How often the encoder expects each symbol, by rule: letters by rank, then classes of bytes."""
    w = np.full(size, 8, np.int64)
    w[0] = 400  # well predicted
    w[32:127] = 12
    w[128:256] = 14
    w[10] = 60
    w[32] = 1500
    for rank, letter in enumerate(b"entiaorhsdlu"):
        w[letter] = 900 // (1 + rank // 4) - 40 * (rank % 4)
    for letter in b"cmgbpwqvfyzjkx":
        w[letter] = 90
    w[[44, 46]] = 120
    if cache:
        w[LITERALS : LITERALS + LENGTHS] = 4
        w[LITERALS + LENGTHS :] = 9
    return w


#: What the encoder predicts with, and the cross-colour elements (green to red, green to blue, red to blue) it tries.
MODES = (0, 1, 2, 11, 12)
ELEMENTS = ((0, 0, 0), (32, 32, 0), (0, 0, 32))
MODE_BITS, ELEMENT_BITS = 2, 5
#: Which form a tile is written in.
PREDICTED, INDEXED = 0, 1


class Book:
    """The encoder's fixed codes for one form: of green with lengths and cache, of red and blue, of distances."""

    def __init__(self, green: np.ndarray, other: np.ndarray, write: BitWriter):
        self.green, self.other = huffman_lengths(green, 15), huffman_lengths(other, 15)
        self.far = huffman_lengths(np.array([60 if k < 6 else 25 for k in range(DISTANCES)]), 15)
        write(1, 1)
        write(CACHE_BITS, 4)
        write(0, 1)  # one code group
        for lengths in (self.green, self.other, self.other, np.eye(1, 256, 0, dtype=np.int64)[0], self.far):
            write_code(write, lengths)
        self.green_code, self.other_code, self.far_code = canonical(self.green), canonical(self.other), canonical(self.far)


def _inner_codes(write: BitWriter, *lengths: np.ndarray) -> None:
    """Head of an inner image: no cache; codes of green, red, blue, alpha."""
    write(0, 1)
    for own in lengths:
        write_code(write, own)
    write_code(write, np.eye(1, DISTANCES, 0, dtype=np.int64)[0])


def _lengths(size: int, given: dict[int, int]) -> np.ndarray:
    found = np.zeros(size, np.int64)
    found[list(given)] = list(given.values())
    return found


@lru_cache(maxsize=1)
def _books() -> tuple:
    """(books by form; head bits in chunks by form; codes of modes, elements, and palette samples).

    Predicted: up to the modes, up to the elements, up to the pixels. Indexed: after the number of colours up to the palette, up to the pixels.
    """
    size = LITERALS + LENGTHS + (1 << CACHE_BITS)
    zero = _lengths(256, {0: 1})
    modes = _lengths(LITERALS + LENGTHS, dict(zip(MODES, (1, 3, 3, 3, 3), strict=True)))
    sample = huffman_lengths(np.concatenate([np.maximum(1, 40 - np.minimum(np.arange(256), 256 - np.arange(256))), np.zeros(LENGTHS, np.int64)]), 15)
    heads, books = [], []
    write = BitWriter()
    write(1, 1), write(PREDICTOR, 2), write(MODE_BITS - 2, 3)
    _inner_codes(write, modes, zero, zero, zero)
    heads.append(write)
    write = BitWriter()
    write(1, 1), write(CROSS_COLOUR, 2), write(ELEMENT_BITS - 2, 3)
    two = {0: 1, 32: 1}
    _inner_codes(write, _lengths(LITERALS + LENGTHS, two), _lengths(256, two), _lengths(256, two), zero)
    heads.append(write)
    write = BitWriter()
    write(0, 1)
    books.append(Book(_weights(size, True), _weights(256, False), write))
    heads.append(write)
    write = BitWriter()
    _inner_codes(write, sample, sample[:256], sample[:256], _lengths(256, {0: 1, 255: 1}))
    heads.append(write)
    write = BitWriter()
    write(0, 1)
    index = np.concatenate([1 + 400 // (2 + np.arange(LITERALS)), np.full(LENGTHS, 12), np.full(1 << CACHE_BITS, 1)])
    books.append(Book(index, np.eye(1, 256, 0, dtype=np.int64)[0], write))
    heads.append(write)
    chunk = lambda w: (np.array([w.value >> k & ((1 << 48) - 1) for k in range(0, w.n, 48)], np.int64), np.array([min(48, w.n - k) for k in range(0, w.n, 48)], np.int64))
    codes = (canonical(modes), modes), (canonical(sample), sample)
    return books, [chunk(w) for w in heads], codes


def _forward(rows: np.ndarray, first: np.ndarray, tall: np.ndarray, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Predict and decorrelate tiles: (residuals, modes, tile of each, elements, tile of each); rows are (rows, WIDTH, 3) bytes."""
    n = len(rows)
    lengths = np.stack([book.other, book.green[:256], book.other]).astype(np.uint8)
    cost = lambda r: lengths[0][r[..., 0]] + lengths[1][r[..., 1]] + lengths[2][r[..., 2]]
    inside = np.arange(n) - np.repeat(first, tall)
    left, top, corner = np.zeros_like(rows), np.zeros_like(rows), np.zeros_like(rows)
    left[:, 1:], top[1:], corner[1:, 1:] = rows[:, :-1], rows[:-1], rows[:-1, :-1]

    def of_blocks(pixel_cost: np.ndarray, bits: int) -> np.ndarray:
        starts = np.flatnonzero(inside & ((1 << bits) - 1) == 0)
        return np.add.reduceat(pixel_cost.reshape(n, WIDTH >> bits, 1 << bits).sum(2, dtype=np.int64), starts, 0)

    def spread(block: np.ndarray, bits: int) -> np.ndarray:
        return np.repeat(block[np.cumsum(inside & ((1 << bits) - 1) == 0) - 1], 1 << bits, 1)

    wide = [x.astype(np.int16) for x in (left, top, corner)]
    guesses = [np.zeros_like(rows) if m == 0 else _guess(m, *wide, wide[1]).astype(np.uint8) for m in MODES]
    best = np.stack([of_blocks(cost(rows - g), MODE_BITS) for g in guesses]).argmin(0)
    pick = spread(best, MODE_BITS)
    guess = guesses[0]
    for k in range(1, len(MODES)):
        some = pick == k
        if some.any():
            guess[some] = guesses[k][some]
    guess[:, 0] = top[:, 0]
    guess[first] = left[first]
    guess[first, 0] = 0
    residual = rows - guess

    def decorrelated(element: tuple[int, int, int]) -> np.ndarray:
        # An element of 32 takes the other sample whole.
        own = residual.copy()
        if element[0]:
            own[..., 0] -= residual[..., 1]
        if element[1]:
            own[..., 2] -= residual[..., 1]
        if element[2]:
            own[..., 2] -= residual[..., 0]
        return own

    tried = [decorrelated(e) for e in ELEMENTS]
    element = np.stack([of_blocks(cost(x), ELEMENT_BITS) for x in tried]).argmin(0)
    pick = spread(element, ELEMENT_BITS)
    for k in range(1, len(ELEMENTS)):
        some = pick == k
        if some.any():
            tried[0][some] = tried[k][some]
    tile = np.repeat(np.arange(len(tall)), tall)
    of = lambda bits: np.repeat(tile[inside & ((1 << bits) - 1) == 0], WIDTH >> bits)
    return tried[0], best.ravel(), of(MODE_BITS), element.ravel(), of(ELEMENT_BITS)


def _ordered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, equal ones by place, and the places. Keys have at most 40 bits, and there are at most 2**23."""
    both = np.sort(key << 23 | np.arange(len(key)))
    return both >> 23, both & ((1 << 23) - 1)


def _indexed(rgb: np.ndarray, tile: np.ndarray, tall: np.ndarray) -> tuple:
    """Palettes of the tiles that have at most 256 colours, each at least twice on average.

    (tiles, colours of each, palettes one after the other, per tile its packed rows' width, indices by row).
    """
    key, order = _ordered(tile << 24 | rgb)
    new = np.flatnonzero(np.diff(key, prepend=-1))
    owner, colour = key[new] >> 24, key[new] & 0xFFFFFF
    count = np.diff(np.append(new, len(key)))
    n = np.bincount(owner, minlength=len(tall))
    some = (n <= 256) & (2 * n <= WIDTH * tall)
    # The commonest colours first, so that small indices are common.
    ranked = np.lexsort((colour, -count, owner))
    rank = np.empty(len(ranked), np.int64)
    rank[ranked] = np.arange(len(ranked)) - np.repeat(np.cumsum(n) - n, n)
    index = np.empty(len(rgb), np.int64)
    index[order] = np.repeat(rank, count)
    return np.flatnonzero(some), n[some], colour[ranked][some[owner[ranked]]], index


def _tokens(r: np.ndarray, g: np.ndarray, b: np.ndarray, image: np.ndarray, form: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(value, bits) of what is written for each pixel of images laid end to end: literal, cache hit, back-reference or nothing.

    `image` is each pixel's image; form and width are the images'.
    """
    books = _books()[0]
    n = len(g)
    v = r << 16 | g << 8 | b
    f = form[image].astype(np.int64)
    table = lambda name: np.stack([getattr(x, name) for x in books])
    green, green_code, other, other_code = (table(x) for x in ("green", "green_code", "other", "other_code"))
    # A code of one symbol takes no bits.
    used = (other > 0).sum(1) > 1
    other, other_code = other * used[:, None], other_code * used[:, None]
    values = green_code[f, g] | other_code[f, r] << green[f, g] | other_code[f, b] << (green[f, g] + other[f, r])
    sizes = green[f, g] + other[f, r] + other[f, b]

    # A pixel is in the colour cache if the last one with its hash, in its image, had its colour.
    slot = (v * CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - CACHE_BITS)
    key, order = _ordered(image << CACHE_BITS | slot)
    hit = np.zeros(n, bool)
    hit[order[1:]] = (key[1:] == key[:-1]) & (v[order[1:]] == v[order[:-1]])
    cached = LITERALS + LENGTHS + slot
    hit &= green[f, cached] < sizes
    values[hit], sizes[hit] = green_code[f[hit], cached[hit]], green[f[hit], cached[hit]]

    # Three pixels in a row that stood in their image before; such places at one distance are one back-reference.
    at = np.arange(max(0, n - 2))
    at = at[image[at] == image[at + 2]] if n > 2 else at
    key = image[at] << 26 | ((v[at] * 0x9E3779B1 ^ v[at + 1] * 0x85EBCA77 ^ v[at + 2] * 0xC2B2AE3D) >> 6 & 0x3FFFFFF)
    key, order = _ordered(key)
    a, p = at[order[:-1]], at[order[1:]]
    same = (key[1:] == key[:-1]) & (v[a] == v[p]) & (v[a + 1] == v[p + 1]) & (v[a + 2] == v[p + 2])
    far = np.zeros(n + 1, np.int64)
    far[p[same]] = (p - a)[same]
    own = np.append(image, -1)
    begin = np.flatnonzero((far > 0) & np.concatenate([[True], (far[1:] != far[:-1]) | (own[1:] != own[:-1])]))
    if not len(begin):
        return values, sizes
    changed = np.flatnonzero(np.concatenate([(far[1:] != far[:-1]) | (own[1:] != own[:-1]), [True]]))
    end = changed[np.searchsorted(changed, begin)] + 3
    end[:-1] = np.minimum(end[:-1], begin[1:])
    long = end - begin >= 3
    begin, end = begin[long], end[long]
    inside = np.zeros(n + 1, np.int64)
    inside[begin] += 1
    np.add.at(inside, end, -1)
    covered = np.cumsum(inside[:-1]) > 0
    sizes[covered] = values[covered] = 0
    f = f[begin]
    green_symbol, extra_bits, extra = prefix_of(end - begin)
    green_symbol += LITERALS
    value, size = green_code[f, green_symbol] | extra << green[f, green_symbol], green[f, green_symbol] + extra_bits
    distance = _distance_codes()[np.log2(width[image[begin]]).astype(np.int64), far[begin]]
    symbol, extra_bits, extra = prefix_of(distance)
    far_length, far_code = table("far"), table("far_code")
    value |= far_code[f, symbol] << size
    size += far_length[f, symbol]
    values[begin], sizes[begin] = value | extra << size, size + extra_bits
    return values, sizes


@lru_cache(maxsize=1)
def _distance_codes() -> np.ndarray:
    """[log2 of the width, distance] -> distance code: the first near place at that distance, else 120 beyond it."""
    codes = np.tile(np.arange(WIDTH * TILE_ROWS + 1) + len(NEAR), (7, 1))
    for log in range(7):
        for k in range(len(NEAR) - 1, -1, -1):
            d = NEAR[k][0] + (NEAR[k][1] << log)
            if 1 <= d < codes.shape[1]:
                codes[log, d] = k + 1
    return codes


def _pack(values: np.ndarray, sizes: np.ndarray, at: np.ndarray, n_bytes: int) -> np.ndarray:
    """Bytes with each value's low `sizes` bits at bit `at` (ascending)."""
    out = np.zeros(n_bytes // 8 + 2, np.uint64)
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    values = values.astype(np.uint64)
    low = values << shift
    over = np.flatnonzero((at & 63) + sizes > 64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] = np.bitwise_or.reduceat(low, first)
    if len(over):  # at most one value passes the end of a word
        out[word[over] + 1] |= values[over] >> (np.uint64(64) - shift[over])
    return out.view(np.uint8)[:n_bytes]


def _laid(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n_images: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(value, bits, image) of parts (value, bits, image), image by image and within one in the order of the parts."""
    count = np.stack([np.bincount(p[2], minlength=n_images) for p in parts])
    before = np.cumsum(count, 0) - count
    starts = np.cumsum(count.sum(0)) - count.sum(0)
    total = int(count.sum())
    out = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
    for k, part in enumerate(parts):
        own = part[2]
        at = np.arange(len(own)) - np.repeat(np.cumsum(count[k]) - count[k], count[k]) + (starts + before[k])[own]
        for o, x in zip(out, part, strict=True):
            o[at] = x
    return out


def _repeated(head: tuple[np.ndarray, np.ndarray], images: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.tile(head[0], len(images)), np.tile(head[1], len(images)), np.repeat(images, len(head[0]))


def encode_tiles(raw: np.ndarray, tall: np.ndarray) -> list[bytes]:
    """A VP8L stream for each tile; raw are the tiles' rows one after the other, (rows, WIDTH, 3) bytes, and tall their heights."""
    books, heads, ((mode_code, mode_size), (sample_code, sample_size)) = _books()
    n = len(tall)
    first = np.cumsum(tall) - tall
    residual, modes, mode_of, elements, element_of = _forward(raw, first, tall, books[PREDICTED])
    tile = np.repeat(np.arange(n), tall * WIDTH)
    c = raw.reshape(-1, 3).astype(np.int64)
    which, colours, palette, index = _indexed(c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2], tile, tall)

    # Indices of few colours share a pixel; images are the predicted tiles, then the indexed ones by width.
    bundle = np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0)
    green, image, images, widths = [], [], [], [np.full(n, WIDTH)]
    for k in range(4):
        own = which[bundle == k]
        number = np.full(n, -1)
        number[own] = n + sum(len(i) for i in images) + np.arange(len(own))
        some = number[tile] >= 0
        packed = (index[some].reshape(-1, WIDTH >> k, 1 << k) << (np.arange(1 << k) * (8 >> k))).sum(2).ravel()
        green.append(packed)
        image.append(number[tile[some].reshape(-1, 1 << k)[:, 0]])
        images.append(own)
        widths.append(np.full(len(own), WIDTH >> k))
    images = np.concatenate(images)  # tile of each indexed image
    blank = np.zeros(sum(len(x) for x in green), np.int64)
    res = residual.reshape(-1, 3).astype(np.int64)
    whole = np.concatenate([tile, *image])
    form = np.repeat([PREDICTED, INDEXED], [n, len(images)])
    values, sizes = _tokens(*(np.concatenate([res[:, j], *(green if j == 1 else [blank])]) for j in range(3)), whole, form, np.concatenate(widths))

    # The palettes' samples: each colour less the one before, opaque.
    place = np.argsort(images, kind="stable")
    image_of = n + place  # image of each tile of `which`
    owner = np.repeat(image_of, colours)
    begins = np.cumsum(colours) - colours
    rgb = np.stack([palette >> s & 255 for s in (16, 8, 0)], 1)
    delta = rgb.copy()
    delta[1:] -= rgb[:-1]
    delta[begins] = rgb[begins]
    delta &= 255
    opaque = np.zeros(len(delta), np.int64)
    opaque[begins] = 1
    r, g, b = delta.T
    at_g, at_r, at_b = sample_size[g], sample_size[r], sample_size[b]
    sample = sample_code[g] | sample_code[r] << at_g | sample_code[b] << (at_g + at_r) | opaque << (at_g + at_r + at_b)
    order = np.argsort(owner, kind="stable")
    element = np.array([int(e[1] > 0) | int(e[2] > 0) << 1 | int(e[0] > 0) << 2 for e in ELEMENTS])  # green, red, blue
    every, indexed = np.arange(n), np.arange(n, n + len(images))
    written = sizes > 0
    start = SIGNATURE | (WIDTH - 1) << 8 | (tall - 1) << 22
    head = lambda own, tiles: (start[tiles], np.full(len(tiles), 40, np.int64), own)
    number = np.empty(len(images), np.int64)
    number[place] = colours - 1
    mode = np.array(MODES)[modes]
    parts = [
        head(every, every),
        _repeated(heads[0], every),
        (mode_code[mode], mode_size[mode], mode_of),
        _repeated(heads[1], every),
        (element[elements], np.full(len(elements), 3), element_of),
        _repeated(heads[2], every),
        head(indexed, images),
        (1 | PALETTE << 1 | number << 3, np.full(len(images), 11), indexed),
        _repeated(heads[3], indexed),
        (sample[order], (at_g + at_r + at_b + 1)[order], owner[order]),
        _repeated(heads[4], indexed),
        (values[written], sizes[written], whole[written]),
    ]
    value, size, own = _laid(parts, n + len(images))
    bits = np.bincount(own, size, n + len(images)).astype(np.int64)
    chosen = np.arange(n)
    shorter = bits[image_of] < bits[which]
    chosen[which[shorter]] = image_of[shorter]
    kept = np.zeros(n + len(images), bool)
    kept[chosen] = True
    value, size, own = (x[kept[own]] for x in (value, size, own))
    n_bytes = np.where(kept, (bits + 7) // 8, 0)
    begin = np.cumsum(n_bytes) - n_bytes
    running = np.cumsum(size) - size
    first_token = np.searchsorted(own, np.arange(len(kept)))
    at = running - running[np.minimum(first_token, len(running) - 1)][own] + 8 * begin[own]
    everything = _pack(value, size, at, int(n_bytes.sum())).tobytes()
    return [everything[lo : lo + k] for lo, k in zip(begin[chosen].tolist(), n_bytes[chosen].tolist(), strict=True)]


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """A WebP file for each payload; payload lengths are positive multiples of 192."""
    if not payloads:
        return []
    n_rows = np.array([len(p) // ROW_BYTES for p in payloads], np.int64)
    raw = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, WIDTH, 3)
    tiles_of = -(-n_rows // TILE_ROWS)
    doc_of_tile = np.repeat(np.arange(len(payloads)), tiles_of)
    tile_no = np.arange(len(doc_of_tile)) - np.repeat(np.cumsum(tiles_of) - tiles_of, tiles_of)
    rows = np.minimum(TILE_ROWS, n_rows[doc_of_tile] - tile_no * TILE_ROWS)
    found: list[bytes] = []
    frames: list[bytes] = []
    # Some tiles at a time, since encoding takes some hundred bytes a pixel.
    cuts = np.flatnonzero(np.diff(np.cumsum(rows) // ENCODED_ROWS, prepend=0, append=-1))
    stop = np.concatenate([[0], np.cumsum(rows)])
    coded = [x for a, b in zip([0, *cuts], cuts, strict=False) if a < b for x in encode_tiles(raw[stop[a] : stop[b]], rows[a:b])]
    for t, (doc, stream) in enumerate(zip(doc_of_tile.tolist(), coded, strict=True)):
        n = len(stream)
        chunk = b"VP8L" + struct.pack("<I", n) + stream + b"\0" * (n & 1)
        if tiles_of[doc] > 1:
            place = bytes(3) + (int(tile_no[t]) * TILE_ROWS // 2).to_bytes(3, "little")
            frame = place + (WIDTH - 1).to_bytes(3, "little") + (int(rows[t]) - 1).to_bytes(3, "little") + bytes(3) + b"\x02"
            frames.append(b"ANMF" + struct.pack("<I", len(frame) + len(chunk)) + frame + chunk)
            if tile_no[t] + 1 < tiles_of[doc]:
                continue
            canvas = b"\x02" + bytes(3) + (WIDTH - 1).to_bytes(3, "little") + (int(n_rows[doc]) - 1).to_bytes(3, "little")
            chunk = b"VP8X" + struct.pack("<I", 10) + canvas + b"ANIM" + struct.pack("<I", 6) + bytes(6) + b"".join(frames)
            frames = []
        found.append(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk)
    return found


def samples(image: np.ndarray) -> bytes:
    """The RGB samples of a pixel array, row by row."""
    argb = np.ascontiguousarray(image).reshape(-1)
    return np.stack([(argb >> s).astype(np.uint8) for s in (16, 8, 0)], 1).tobytes()
