"""Texts kept as lossless WebP images, read back as pixel arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import webp

#: Payload bytes coded side by side; bounds a worker's memory however many rows a batch has.
GROUP_BYTES = 4 << 20


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 bytes filled with blanks to a positive multiple of ROW_BYTES, bytes before that)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    whole = max(1, -(-len(raw) // webp.ROW_BYTES)) * webp.ROW_BYTES
    return raw.ljust(whole, b" "), len(raw)


def _groups(items: Iterator[tuple], weight) -> Iterator[list[tuple]]:
    group, total = [], 0
    for item in items:
        group.append(item)
        total += weight(item)
        if total >= GROUP_BYTES:
            yield group
            group, total = [], 0
    if group:
        yield group


def store_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WebP file.

    A null text counts as empty, an empty one is one row of blanks, a very long one becomes more tiles;
    one row comes out for each that goes in, repeated ones and null ids too. Other columns of `docs`
    are not read. Narrow: no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i.as_py(), *payload_of(t.as_py())) for i, t in zip(batch.column(0), batch.column(1), strict=True))
            for group in _groups(rows, lambda r: len(r[1])):
                media = webp.encode_many([p for _, p, _ in group])
                yield pa.record_batch([pa.array([r[0] for r in group], pa.int64()), pa.array([r[2] for r in group], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def features(image: np.ndarray) -> str:
    """Size, sample sums by channel, and a difference hash of the column sums, all in whole numbers."""
    columns = [((image >> s) & 0xFF).sum(0, dtype=np.int64) for s in (16, 8, 0)]
    light = sum(columns)
    bits = np.packbits(light[1:] > light[:-1]).tobytes().hex()
    return f"{image.shape[1]}x{image.shape[0]};sum={','.join(str(int(c.sum())) for c in columns)};dhash={bits}"



def read_media(media: DataFrame, payload: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload, media_bytes, media_sha256, feature): the stored files decoded.

    The payload is the RGB samples of the pixel array, blanks at the end included. With `payload` false
    that column gives way to payload_bytes, payload_sha256 and tail_crc32 (of the last 16 samples). A file that
    isn't lossless WebP raises ValueError; a null one gives nulls.
    """
    names = ["doc_id", "n_bytes", *(["payload"] if payload else ["payload_bytes", "payload_sha256", "tail_crc32"]), "media_bytes", "media_sha256", "feature"]
    arrow = {"payload": pa.binary(), "payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string()}
    ddl = {"payload": "binary", "payload_sha256": "string", "media_sha256": "string", "feature": "string"}
    schema = pa.schema([(n, arrow.get(n, pa.int64())) for n in names])

    def row(doc_id, n_bytes, data, image) -> list:
        if image is None:
            return [doc_id, n_bytes, *[None] * (len(names) - 2)]
        own = webp.samples(image)
        mid = [own] if payload else [len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-16:])]
        return [doc_id, n_bytes, *mid, len(data), hashlib.sha256(data).hexdigest(), features(image)]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = ((i.as_py(), n.as_py(), m.as_py()) for i, n, m in zip(*batch.columns, strict=True))
            for group in _groups(rows, lambda r: len(r[2] or b"")):
                images = iter(webp.decode_many([m for _, _, m in group if m is not None]))
                made = [row(i, n, m, None if m is None else next(images)) for i, n, m in group]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), schema, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, ", ".join(f"{n} {ddl.get(n, 'long')}" for n in names))
