"""Media columns: progressive JPEGs in a binary column, read back as coefficients and full-resolution RGB tensors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import jpeg
from assayer.llm.scratch import stored, table
from assayer.llm.tokens import as_text, text_slices

#: Bytes that a task encodes or decodes at once.
SLICE = 1 << 20


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = as_text(batch.column(batch.num_columns - 1))
        for lo, hi in text_slices(texts, SLICE):
            raw = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in texts[lo:hi]]
            padded = [r + bytes(-len(r) % 64 or (0 if r else 64)) for r in raw]
            media = jpeg.encode(padded, [len(r) for r in raw])
            yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns[:-1]), pa.array(media, pa.binary())], [*batch.schema.names[:-1], "media"])


def _schema(df: DataFrame, drop: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != drop)


def store_texts(docs: DataFrame) -> DataFrame:
    """docs with column media in place of text: the text's UTF-8 bytes (null: none), padded with zeros to a
    positive multiple of 64, as the coefficients of a progressive JPEG; one row per input row, lossless. Extra
    columns stay, but for one named media; an empty table gives an empty result."""
    rest = docs.select(*(c for c in docs.columns if c not in ("text", "media")), "text")
    return rest.mapInArrow(_encode, f"{_schema(rest, 'text')}, media binary")


def _decode(want_tensor: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            for lo, hi in text_slices(column, SLICE):
                files = column[lo:hi].to_pylist()
                good = [k for k, f in enumerate(files) if f]
                images, coefficients, bases = jpeg.decode_coefficients([files[k] for k in good])
                rows: list[tuple] = [(None, None, None, None, None, None)] * len(files)
                for k, image, base, rgb in zip(good, images, bases, jpeg.tensors(images, coefficients, bases), strict=True):
                    payload = size = None
                    if len(image.comment) == 16:
                        total, size = (int.from_bytes(image.comment[p : p + 8], "big") for p in (0, 8))
                        payload = jpeg.TO_BYTE[coefficients[base[0] : base[0] + total // 64] + 256].tobytes()
                    levels = np.stack([np.bincount(rgb[..., c].ravel(), minlength=256) for c in range(3)])
                    sums, power = levels @ np.arange(256), int((levels @ np.arange(256) ** 2).sum())
                    feature = f"{rgb.shape[0]}x{rgb.shape[1]}:{sums[0]}:{sums[1]}:{sums[2]}:{power}"
                    rows[k] = (payload, size, image.height, image.width, feature, rgb.tobytes() if want_tensor else None)
                kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c[lo:hi] for c in batch.columns), *columns], [*batch.schema.names, "payload", "n_bytes", "height", "width", "feature", "rgb"])

    return run


def read_media(stored_: DataFrame, tensor: bool = True) -> DataFrame:
    """stored_ with what its column media holds: payload, n_bytes, height, width, feature and, unless told
    otherwise, rgb: height * width * 3 bytes. Any progressive JPEG is read; payload is null without our comment
    segment, everything is null for null media. feature: the size, the sums of R, G and B, and of all squares.
    """
    names = ("payload", "n_bytes", "height", "width", "feature", "rgb", "media")
    rest = stored_.select(*(c for c in stored_.columns if c not in names), "media")
    return rest.mapInArrow(_decode(tensor), f"{_schema(rest, 'media')}, media binary, payload binary, n_bytes long, height int, width int, feature string, rgb binary")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media table is written to the shared folder and read back; rgb is the tensor, height * width * 3 bytes."""
    media = stored(store_texts(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    back = read_media(media)
    tail = F.substring("payload", F.length("payload") - 63, F.lit(64))
    return back.select(
        "doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"), F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "height", "width", "rgb")
