"""Media columns against a decoder written apart: one bit and one block at a time, as the standard describes progressive JPEG."""

import hashlib
import math
import zlib

import numpy as np

from tracewright.llm import media, queries

SF = "/root/testdata/sf0.001"


class Reader:
    def __init__(self, data):
        self.data, self.at, self.bits = data, 0, []

    def bit(self):
        if not self.bits:
            byte = self.data[self.at]
            self.at += 2 if byte == 0xFF else 1  # a stuffed zero follows
            self.bits = [byte >> k & 1 for k in range(8)]
        return self.bits.pop()

    def number(self, n):
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table):
        code, n = 0, 0
        while (n, code) not in table:
            code, n = code << 1 | self.bit(), n + 1
        return table[n, code]

    def signed(self, n):
        v = self.number(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1

    def restart(self):
        self.bits = []
        if self.at + 1 < len(self.data) and self.data[self.at] == 0xFF and 0xD0 <= self.data[self.at + 1] <= 0xD7:
            self.at += 2


def huffman(counts, symbols):
    table, code, k = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            table[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return table


def naive(stream):
    """(width, height, comment, {component: {(row, column): 64 coefficients by zigzag place}}, sampling, quantisers)."""
    at, tables, quant, blocks, interval, comment = 2, {}, {}, {}, 0, b""
    while stream[at + 1] != 0xD9:
        kind, n = stream[at + 1], int.from_bytes(stream[at + 2 : at + 4], "big")
        body, at = stream[at + 4 : at + 2 + n], at + 2 + n
        if kind == 0xDB:
            quant[body[0]] = list(body[1:65])
        elif kind == 0xC4:
            tables[body[0]] = huffman(body[1:17], body[17:])
        elif kind == 0xDD:
            interval = int.from_bytes(body, "big")
        elif kind == 0xFE:
            comment = body
        elif kind == 0xC2:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(body[5])}
            wide, high = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
            across, down = -(-width // (8 * wide)), -(-height // (8 * high))
            blocks = {c: {(r, k): [0] * 64 for r in range(down * v) for k in range(across * h)} for c, (h, v, _) in parts.items()}
        elif kind == 0xDA:
            end = at
            while not (stream[end] == 0xFF and stream[end + 1] not in (0, *range(0xD0, 0xD8))):
                end += 1
            own = [(body[1 + 2 * k], body[2 + 2 * k]) for k in range(body[0])]
            first, last, bits = body[1 + 2 * body[0] :]
            scan(Reader(stream[at:end]), own, first, last, bits >> 4, bits & 15, blocks, parts, tables, interval, (width, height, wide, high, across, down))
            at = end
    return width, height, comment, blocks, parts, quant


def scan(read, own, first, last, high, low, blocks, parts, tables, interval, frame):
    width, height, wide, tall, across, down = frame
    if len(own) == 1:
        c, t = own[0]
        h, v, _ = parts[c]
        units = [[(c, t, r, k)] for r in range(math.ceil(height * v / (8 * tall))) for k in range(math.ceil(width * h / (8 * wide)))]
    else:
        units = [[(c, t, y * parts[c][1] + r, x * parts[c][0] + k) for c, t in own for r in range(parts[c][1]) for k in range(parts[c][0])] for y in range(down) for x in range(across)]
    before, band = dict.fromkeys(parts, 0), 0
    for number, unit in enumerate(units):
        if interval and number and number % interval == 0:
            read.restart()
            before, band = dict.fromkeys(parts, 0), 0
        for c, t, r, k in unit:
            block = blocks[c][r, k]
            if first == 0:
                if high:
                    block[0] |= read.bit() << low
                else:
                    before[c] += read.signed(read.symbol(tables[t >> 4]))
                    block[0] = before[c] << low
                continue
            place, table, one = first, tables[0x10 | t & 15], 1 << low
            while place <= last and not band:
                symbol = read.symbol(table)
                run, size = symbol >> 4, symbol & 15
                if size == 0 and run < 15:
                    band = (1 << run) + read.number(run)
                    break
                value = read.signed(size) if not high else (one if size and read.bit() else -one if size else 0)
                if not high:
                    place += run
                    if size:
                        block[place] = value << low
                    place += 1
                    continue
                while place <= last:  # refining: old values take a bit each, zeros use up the run
                    if block[place]:
                        if read.bit() and not abs(block[place]) & one:
                            block[place] += one if block[place] > 0 else -one
                    elif run == 0:
                        block[place] = value
                        place += 1
                        break
                    else:
                        run -= 1
                    place += 1
            if band:
                while high and place <= last:
                    if block[place] and read.bit() and not abs(block[place]) & one:
                        block[place] += one if block[place] > 0 else -one
                    place += 1
                band -= 1


def zigzag_places():
    r, c, up, out = 0, 0, True, []
    for _ in range(64):
        out.append((r, c))
        if up and c == 7 or not up and r == 7:
            r, c, up = (r + 1, c, False) if up else (r, c + 1, True)
        elif up and r == 0 or not up and c == 0:
            r, c, up = (r, c + 1, False) if up else (r + 1, c, True)
        else:
            r, c = (r - 1, c + 1) if up else (r + 1, c - 1)
    return out


def picture(decoded):
    width, height, _, blocks, parts, quant = decoded
    wide, tall = max(p[0] for p in parts.values()), max(p[1] for p in parts.values())
    scale = lambda u: 1 / math.sqrt(8) if u == 0 else 0.5
    wave = np.array([[scale(u) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
    planes = []
    for c, (h, v, q) in parts.items():
        plane = np.zeros((height, width))
        for (r, k), block in blocks[c].items():
            square = np.zeros((8, 8))
            for (y, x), value, factor in zip(zigzag_places(), block, quant[q], strict=True):
                square[y, x] = value * factor
            samples = np.clip(np.rint(wave.T @ square @ wave) + 128, 0, 255)
            samples = np.kron(samples, np.ones((tall // v, wide // h)))
            y, x = r * 8 * tall // v, k * 8 * wide // h
            part = plane[y : y + samples.shape[0], x : x + samples.shape[1]]
            part[:] = samples[: part.shape[0], : part.shape[1]]
        planes.append(plane)
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    return np.clip(np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], 2), 0, 255)


def payload_of(decoded):
    """Blocks of each MCU in turn: four of Y, one of Cb, one of Cr; a coefficient is a byte less OFFSET."""
    _, _, comment, blocks, parts, _ = decoded
    y, b, r = parts
    out = []
    for my, mx in sorted(blocks[b]):
        for block in (*(blocks[y][2 * my + i, 2 * mx + j] for i in range(2) for j in range(2)), blocks[b][my, mx], blocks[r][my, mx]):
            out += block
    return bytes(v + media.OFFSET for v in out[: int(comment)])


def test_pictures_mean_what_the_standard_says():
    rng = np.random.default_rng(3)
    payloads = [media.padded(t) for t in (b"", "Zwölf Boxkämpfer jagen Viktor.".encode() * 9, rng.integers(0, 256, 900, np.uint8).tobytes(), b"\xff\x00" * 300, bytes(range(256)) * 2)]
    for payload, stream, (back, rgb) in zip(payloads, media.to_jpeg(payloads), media.from_jpeg(media.to_jpeg(payloads)), strict=True):
        decoded = naive(stream)
        assert payload_of(decoded) == payload == back
        # the standard leaves rounding to decoders: a sample may be one step off, which blue has as 1 + 1.772 and half a step of its own
        assert rgb.shape == (decoded[1], decoded[0], 3)
        off = np.abs(rgb - picture(decoded))
        assert off.max() <= 3.3 and off.mean() < 0.75


def brute_feature(rgb):
    height, width, _ = rgb.shape
    pixels = [tuple(map(int, p)) for row in rgb for p in row]
    mean = [100 * sum(p[c] for p in pixels) // len(pixels) for c in range(3)]
    cells = [0] * 16
    for k, p in enumerate(pixels):
        cells[k // width * 4 // height * 4 + k % width * 4 // width] += sum(p)
    bits = sum(1 << (15 - k) for k, c in enumerate(cells) if 16 * c >= sum(cells))
    return f"{width}x{height}:{','.join(map(str, mean))}:{bits:04x}:{zlib.crc32(rgb.tobytes()):08x}"


def test_query_columns_are_those_of_the_texts(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op4_media_columns(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + b" " * (192 * max(1, math.ceil(len(raw) / 192)) - len(raw))
        stream = media.to_jpeg([payload])[0]  # pictures do not depend on what they are coded with
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(stream), hashlib.sha256(stream).hexdigest())
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert r["feature"] == media.feature(rgb)
    for r in rows[:12]:
        rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
        assert r["feature"] == brute_feature(rgb)


def test_tensors_are_written_in_small_row_groups(spark, tmp_path):
    import pyarrow.parquet as pq

    docs = spark.range(400).selectExpr("id AS doc_id", "repeat(cast(id AS string), 900) AS text").coalesce(1)
    media.write_tensors(media.media_columns(docs), str(tmp_path / "tensors"), row_group=1 << 15)
    files = list((tmp_path / "tensors").glob("*.parquet"))
    assert sum(pq.ParquetFile(f).metadata.num_row_groups for f in files) > 1
    assert spark.read.parquet(str(tmp_path / "tensors")).where("length(rgb) = height * width * 3").count() == 400
