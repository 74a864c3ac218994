"""The compact binary track: an index of paths and segments, then three 32-bit counts a base."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 1 << 16


def write_binary_track(rows: DataFrame, path: str, k: int) -> None:
    """Write ``rows`` (a row for every base of every segment) to one local file, in path order.

    The index holds a row a segment; the payload arrives in chunks of bases, one partition at a time.
    """
    order = rows.groupBy("path", "segment_id").agg(F.min("abs_pos").alias("start"), F.count("*").alias("n")).orderBy("path", "start").collect()
    paths: dict[str, list] = {}
    for r in order:
        paths.setdefault(r["path"], []).append(r)
    item = F.struct("pos", "cov", "right", "left")
    chunks = rows.groupBy("path", "segment_id", F.floor(F.col("pos") / CHUNK).alias("chunk")).agg(F.min("abs_pos").alias("start"), F.sort_array(F.collect_list(item)).alias("v"))
    with open(path, "wb") as out:
        out.write(struct.pack("<BI", k, len(paths)))
        for name, parts in paths.items():
            raw = name.encode()
            out.write(struct.pack("<H", len(raw)) + raw + struct.pack("<I", len(parts)))
            for r in parts:
                out.write(struct.pack("<QQB", r["start"], r["n"], 1))
        for r in chunks.orderBy("path", "start").toLocalIterator():
            out.write(np.array([(x["cov"], x["right"], x["left"]) for x in r["v"]], "<u4").tobytes())


def parse_index(data: bytes) -> tuple[int, list[tuple[str, int, int, int, int]], int]:
    """k, (path, segment_id, abs_pos, length, byte offset in the payload) and where the payload starts."""
    k, n = struct.unpack_from("<BI", data)
    at, payload, out = 5, 0, []
    for _ in range(n):
        (size,) = struct.unpack_from("<H", data, at)
        name = data[at + 2 : at + 2 + size].decode()
        (parts,) = struct.unpack_from("<I", data, at + 2 + size)
        at += 6 + size
        for s in range(parts):
            start, length, _ = struct.unpack_from("<QQB", data, at)
            at += 17
            out.append((name, s, start, length, payload))
            payload += 12 * length
    return k, out, at


def read_binary_track(spark: SparkSession, path: str) -> DataFrame:
    """(path, segment_id, pos, abs_pos, cov, right, left, k) of binary track files of up to 2 GB each."""
    names = ["path", "segment_id", "pos", "abs_pos", "cov", "right", "left", "k"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                k, index, base = parse_index(content)
                for name, segment, start, length, offset in index:
                    values = np.frombuffer(content, "<u4", 3 * length, base + offset).reshape(-1, 3).astype(np.int64)
                    for at in range(0, length, CHUNK):
                        v = values[at : at + CHUNK]
                        pos = np.arange(at, at + len(v))
                        columns = [pa.array([name] * len(v)), pa.array(np.full(len(v), segment)), pa.array(pos), pa.array(pos + start), *(pa.array(v[:, i]) for i in range(3)), pa.array(np.full(len(v), k, np.int64))]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = spark.read.format("binaryFile").load(path).select("content")
    return rows.mapInArrow(run, "path string, " + ", ".join(f"{n} long" for n in names[1:]))
