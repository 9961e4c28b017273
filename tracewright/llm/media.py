"""Operator 4, media columns: texts as progressive JPEG pictures, and pictures as tensors.

A payload of bytes is stored in the format's own unit, quantised DCT coefficients: each byte less `OFFSET` is one
coefficient, 64 to a block, six blocks to an MCU (4:2:0), so the stored form is an ordinary progressive JPEG and gives every byte back. Reading
gathers all scans (spectral selection, successive approximation) into coefficient arrays, transforms them back in numpy, upsamples
chroma and gives full-resolution RGB tensors. Pictures are written as a table and read from it; tensors are columns of the result.
Rows stay where they are; tasks work on a few megabytes at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm import jpeg
from tracewright.llm.common import ship, stored, text_of
from tracewright.llm.word_encoder import slices

UNIT, OFFSET, MCU = 192, 106, 384
#: Bytes of payload that are coded or decoded together.
TOGETHER = 1 << 20


def padded(raw: bytes) -> bytes:
    """The bytes followed by spaces up to a positive multiple of 192."""
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def to_jpeg(payloads: list[bytes]) -> list[bytes]:
    """A JPEG for each payload; its length stands in the comment. Blocks beyond it are zero."""
    mcus = []
    for p in payloads:
        blocks = np.zeros((-(-len(p) // MCU), 6 * 64), np.int64)
        blocks.reshape(-1)[: len(p)] = np.frombuffer(p, np.uint8).astype(np.int64) - OFFSET
        mcus.append(blocks.reshape(-1, 6, 64))
    return jpeg.encode(mcus, [str(len(p)).encode() for p in payloads])


def from_jpeg(media: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, RGB picture) of each."""
    images = [jpeg.parse(m) for m in media]
    out = []
    for image, coefficients in zip(images, jpeg.decode(images), strict=True):
        blocks = jpeg.order_of(image, (0, 1, 2))[0]
        n = int(image.comment)
        payload = (coefficients[blocks[: -(-n // 64)]].reshape(-1)[:n] + OFFSET).astype(np.uint8).tobytes()
        out.append((payload, jpeg.rgb(image, coefficients)))
    return out


def feature(picture: np.ndarray) -> str:
    """Size, mean colour in hundredths, a 16-bit mean hash of a 4 x 4 grid of brightness, and CRC of the tensor: whole numbers, alike on every machine."""
    height, width, _ = picture.shape
    total = picture.reshape(-1, 3).sum(0, dtype=np.int64)
    light = picture.sum(2, dtype=np.int64).reshape(4, height // 4, 4, width // 4).sum((1, 3)).reshape(-1)
    bits = int("".join("1" if 16 * x >= light.sum() else "0" for x in light), 2)
    mean = ",".join(str(int(t * 100 // (height * width))) for t in total)
    return f"{width}x{height}:{mean}:{bits:04x}:{zlib.crc32(picture.tobytes()):08x}"


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the text of every document as a JPEG. Null counts as empty; an empty text is one unit of spaces."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2048, TOGETHER):
            raw = batch.column("text").cast(pa.binary()).to_pylist()
            media = to_jpeg([padded(r) for r in raw])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(encode, f"doc_id {id_type}, n_bytes long, media binary")


def read_back(media: DataFrame, tensors: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of stored pictures; with `tensors` also height, width and rgb (bytes by row, pixel, colour)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["height", "width", "rgb"] * tensors
        for batch in slices(batches, "media", 2048, TOGETHER):
            stored = batch.column("media").to_pylist()
            both = from_jpeg(stored)
            payloads = [p for p, _ in both]
            columns = [
                batch.column("doc_id"), batch.column("n_bytes"), pa.array(map(len, payloads), pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payloads]), pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                pa.array(map(len, stored), pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in stored]), pa.array([feature(x) for _, x in both]),
            ]
            if tensors:
                columns += [pa.array([x.shape[0] for _, x in both], pa.int32()), pa.array([x.shape[1] for _, x in both], pa.int32()), pa.array([x.tobytes() for _, x in both], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names)

    ship(media.sparkSession)
    id_type = media.schema["doc_id"].dataType.simpleString()
    fields = f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(decode, fields + ", height int, width int, rgb binary" * tensors)


def media_columns(docs: DataFrame, tensors: bool = True) -> DataFrame:
    """One row for each row of docs, written as pictures to the shared folder and read back; the tensor (height, width, rgb) unless `tensors` is False.

    A null text counts as empty. Equal texts give equal values wherever they lie: all arithmetic is in whole numbers. Repeated
    rows, ties and null doc_ids are stored each for itself. Only doc_id and text are read. A very long text makes a picture with more MCUs to a row.
    An empty table gives an empty result.
    """
    return read_back(stored(store(docs), "media", compression="zstd"), tensors)


def write_tensors(pictures: DataFrame, path: str, row_group: int = 16 << 20) -> None:
    """Write the result of media_columns as Parquet, in row groups of about `row_group` bytes, so that a reader holds few tensors at once."""
    pictures.write.option("parquet.block.size", row_group).option("compression", "zstd").parquet(path)
