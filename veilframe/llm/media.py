"""Media columns: progressive JPEG in, coefficients and full-resolution RGB tensors out."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole_text
from .jpeg import Frame, JpegError, pad, payload_of, store


def store_texts(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as a progressive JPEG."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [t.encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([store(pad(r)) for r in raw], pa.binary())],
                    names=["doc_id", "n_bytes", "media"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(
        run, "doc_id long, n_bytes long, media binary"
    )


def tensors(media: DataFrame) -> DataFrame:
    """``media`` (a binary column ``media``) plus height, width and rgb, the raw H x W x 3 bytes."""
    schema = T.StructType([*media.schema, T.StructField("height", T.IntegerType()), T.StructField("width", T.IntegerType()), T.StructField("rgb", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one image at a time bounds the memory
                part = batch.slice(k, 1)
                data = part.column(part.schema.get_field_index("media"))[0].as_py()
                rgb = None if data is None else Frame(data).rgb()
                cells = [pa.array([None if rgb is None else v]) for v in ((0, 0) if rgb is None else rgb.shape[:2])]
                cells = [c.cast(pa.int32()) for c in cells] + [pa.array([None if rgb is None else rgb.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns, *cells], names=[*part.schema.names, "height", "width", "rgb"])

    return media.mapInArrow(run, schema)


def feature(rgb: np.ndarray) -> str:
    """Size, mean of each channel and mean absolute step across, in thousandths, from exact sums."""
    h, w = rgb.shape[:2]
    flat = rgb.reshape(-1, 3)
    means = [int(flat[:, c].sum(dtype=np.int64)) * 1000 // (h * w) for c in range(3)]
    green = rgb[..., 1].astype(np.int16)
    step = int(np.abs(green[:, 1:] - green[:, :-1]).sum(dtype=np.int64)) * 1000 // (h * (w - 1)) if w > 1 else 0
    return f"{h}x{w}:{means[0]},{means[1]},{means[2]}:{step}"


def _digests(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * 7
    own = len(data), hashlib.sha256(data).hexdigest()
    try:
        frame = Frame(data)
        payload = payload_of(frame)
    except (JpegError, IndexError, KeyError, struct.error):
        return None, None, None, *own, None, None
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), *own, feature(frame.rgb()), frame.scans


def digest(media: DataFrame) -> DataFrame:
    """Reads stored media back: payload and media digests and the feature of the RGB tensor.

    All these are null where ``media`` is null. Bytes that are no JPEG, or one that
    :func:`store_texts` did not write, give media_bytes and media_sha256 alone.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_scans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names[2:]]
            for data in batch.column(2):
                made = _digests(data.as_py())
                for col, v in zip(rows, made, strict=True):
                    col.append(v)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=names
            )

    return media.select("doc_id", "n_bytes", "media").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_scans int",
    )
