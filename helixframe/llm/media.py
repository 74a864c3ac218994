"""FLAC media columns: store bytes losslessly as samples, decode to PCM blocks that can be sought."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import flac
from helixframe.llm.nested import identifier

UNIT, CHUNK, BLOCK_ROWS = 64, 1 << 21, 256
BLOCKS = "block int, sample_offset long, n_samples int, channels int, depth int, rate int, verified boolean, pcm binary, error string"


def payload(text: str | None) -> bytes:
    """UTF-8 of the text (null: empty) with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_samples(raw: bytes) -> np.ndarray:
    """Bytes as signed 8-bit samples, without widening them."""
    return (np.frombuffer(raw, np.uint8) ^ 0x80).view(np.int8)


def from_samples(samples: np.ndarray) -> bytes:
    return (samples[:, 0] + 128).astype(np.uint8).tobytes()


def _chunks(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of consecutive items of at most ``most`` bytes, or of one item."""
    start = held = 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield slice(start, i)
            start, held = i, 0
        held += n
    if sizes:
        yield slice(start, len(sizes))


def encode_column(docs: DataFrame, text: str = "text", ident: str = "doc_id") -> DataFrame:
    """(media_id, n_bytes, media): every whole text's payload as an 8-bit mono FLAC stream.

    Null texts are empty; identifiers keep their type, nulls too; equal texts give equal streams. Further columns
    are not carried; an empty table gives none. Texts are coded ``CHUNK`` bytes at once, or one by one if longer.
    """
    kind, arrow = identifier(docs, ident)
    schema = pa.schema([("media_id", arrow), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.as_buffer() or b"") if t.is_valid else 0 for t in batch.column(1)]
            for part in _chunks(sizes, CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                media = flac.encode_many([to_samples(payload(t.as_py())) for t in rows.column(1)])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(sizes[part], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col(ident).alias("media_id"), F.col(text).alias("text")).mapInArrow(run, f"media_id {kind}, n_bytes long, media binary")


def pcm_blocks(media: DataFrame, column: str = "media", ident: str = "media_id") -> DataFrame:
    """One row a FLAC frame: its PCM and the sample offset at which it can be sought.

    A frame whose checksum fails, or that can't be decoded, has null PCM and ``verified``
    false. A value that is null or no FLAC stream gives one row with ``error``; a stream without frames one row without block.
    """
    kind, arrow = identifier(media, ident)
    numbers = [("block", pa.int32()), ("sample_offset", pa.int64()), *((n, pa.int32()) for n in ("n_samples", "channels", "depth", "rate"))]
    schema = pa.schema([("media_id", arrow), *numbers, ("verified", pa.bool_()), ("pcm", pa.binary()), ("error", pa.string())])

    def rows_of(idents: list, media: list) -> Iterator[tuple]:
        last, number = -1, 0
        for i, state, frame, samples in flac.decode_blocks(media):
            number = number + 1 if i == last else 0
            last = i
            if frame is None:
                yield (idents[i], *(None,) * 6, state.error is None, None, state.error)
                continue
            pcm = None if samples is None else flac.pcm_bytes(samples, state.stream.depth)
            s = state.stream
            yield (idents[i], number, frame.sample, None if samples is None else len(samples), s.channels, s.depth, s.rate, samples is not None, pcm, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = rows_of(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            while part := list(islice(found, BLOCK_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)

    return media.select(F.col(ident).alias("media_id"), F.col(column).alias("media")).mapInArrow(run, f"media_id {kind}, {BLOCKS}")


def write_pcm_blocks(blocks: DataFrame, path: str) -> None:
    """Blocks in order of stream and sample, so that a seek reads few row groups."""
    blocks.repartitionByRange("media_id", "sample_offset").sortWithinPartitions("media_id", "sample_offset").write.mode("overwrite").parquet(path)


def seek(spark: SparkSession, path: str, media_id: int, first: int, count: int) -> DataFrame:
    """The blocks that hold samples ``first`` to ``first + count - 1`` of a stream; both filters reach the scan."""
    rows = spark.read.parquet(path).where((F.col("media_id") == media_id) & (F.col("sample_offset") < first + count))
    return rows.where(F.col("sample_offset") + F.col("n_samples") > first).orderBy("sample_offset")


class _Digest:
    """Digests and features of a stream's bytes, taken block by block."""

    def __init__(self) -> None:
        self.sha, self.tail, self.n, self.frames = hashlib.sha256(), b"", 0, 0
        self.squares = self.crossings = self.peak = 0
        self.last: bool | None = None

    def add(self, samples: np.ndarray) -> None:
        raw, x = from_samples(samples), samples[:, 0]
        self.sha.update(raw)
        self.tail = (self.tail + raw[-UNIT:])[-UNIT:]
        below = x < 0
        self.crossings += int(np.count_nonzero(below[1:] != below[:-1])) + (self.last is not None and bool(below[0]) != self.last)
        self.last = bool(below[-1])
        self.squares += int((x * x).sum())
        self.peak = max(self.peak, int(np.abs(x).max()))
        self.n += len(x)

    def features(self) -> str:
        """Root mean square, zero crossing rate, peak and frame count."""
        return f"rms={np.sqrt(self.squares / max(self.n, 1)):.4f};zcr={self.crossings / max(self.n - 1, 1):.5f};peak={self.peak};frames={self.frames}"


def media_report(docs: DataFrame) -> DataFrame:
    """Digests of every document's stored stream and of the payload read back from it.

    Rows as in ``encode_column``. A frame that can't be read back is left out of the payload, and ``verified`` is false.
    """
    kind, arrow = identifier(docs, "doc_id")
    kinds = [("doc_id", arrow), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64())]
    schema = pa.schema([*kinds, ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("verified", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stored = batch.column(2).to_pylist()
            digests, verified = [_Digest() for _ in stored], [False] * len(stored)
            for i, state, frame, samples in flac.decode_blocks(stored):
                digests[i].frames += frame is not None
                if samples is not None:
                    digests[i].add(samples)
                verified[i] = state.md5_ok
            sizes, sums = [len(m or b"") for m in stored], [hashlib.sha256(m or b"").hexdigest() for m in stored]
            columns = [[d.n for d in digests], [d.sha.hexdigest() for d in digests], [zlib.crc32(d.tail) for d in digests], sizes, sums, [d.features() for d in digests], verified]
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[2:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], schema=schema)

    report = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, verified boolean"
    return encode_column(docs).mapInArrow(run, report)
