"""Files of the vendor's binary records as a Spark source: spark.read.format("dbn").option("kind", "mbp-10").load(path).

A file is a header (the letters DBN, a version, the length of its metadata) and records, each beginning with its own length;
it may be compressed as a whole (zstd). Files are read in tasks, one file each, record by record of the kind asked for.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Layout of the records (little endian) and their types.
HEADER = [("length", "u1"), ("rtype", "u1"), ("publisher_id", "<u2"), ("instrument_id", "<u4"), ("ts_event", "<u8")]
_BOOK = [("price", "<i8"), ("size", "<u4"), ("action", "S1"), ("side", "S1"), ("flags", "u1"), ("depth", "u1"), ("ts_recv", "<u8"), ("ts_in_delta", "<i4"), ("sequence", "<u4")]


def _levels(n: int) -> list[tuple[str, str]]:
    return [(f"{name}_{i:02d}", kind) for i in range(n) for name, kind in (("bid_px", "<i8"), ("ask_px", "<i8"), ("bid_sz", "<u4"), ("ask_sz", "<u4"), ("bid_ct", "<u4"), ("ask_ct", "<u4"))]


_BARS = [(c, "<i8") for c in ("open", "high", "low", "close")] + [("volume", "<u8")]
KINDS = {"mbp-1": (1, HEADER + _BOOK + _levels(1)), "mbp-10": (10, HEADER + _BOOK + _levels(10)), "ohlcv-1s": (32, HEADER + _BARS)}
#: Records handed on at once.
BATCH = 65_536


def columns_of(kind: str) -> list[str]:
    left_out = {"length", "rtype", "publisher_id", "flags", "depth", "ts_in_delta"}
    return [n for n, _ in KINDS[kind][1] if n not in left_out and not n[:6] in ("bid_ct", "ask_ct")]


def records_of(data: bytes, kind: str) -> np.ndarray:
    """The records of a kind in the bytes of a file; others are passed over, a torn last record is an error."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    if data[:3] != b"DBN":
        raise ValueError("not a file of this format")
    rtype, layout = KINDS[kind]
    dtype = np.dtype(layout)
    body = np.frombuffer(data, np.uint8)[8 + int.from_bytes(data[4:8], "little") :]
    n = len(body) // dtype.itemsize
    whole = body[: n * dtype.itemsize].reshape(n, dtype.itemsize)
    if n * dtype.itemsize == len(body) and (whole[:, 0] == dtype.itemsize // 4).all() and (whole[:, 1] == rtype).all():
        return whole.reshape(-1).view(dtype)
    starts, at = [], 0
    while at < len(body):
        size = int(body[at]) * 4
        if size < 16 or at + size > len(body):
            raise ValueError("the last record is torn")
        if body[at + 1] == rtype and size == dtype.itemsize:
            starts.append(at)
        at += size
    picked = body[np.array(starts, np.int64)[:, None] + np.arange(dtype.itemsize)] if starts else np.empty((0, dtype.itemsize), np.uint8)
    return np.ascontiguousarray(picked).reshape(-1).view(dtype)


class DbnReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.kind = options["path"].removeprefix("file:"), options.get("kind", "mbp-10")

    def partitions(self) -> list[InputPartition]:
        files = sorted(glob.glob(os.path.join(self.path, "*.dbn*"))) if os.path.isdir(self.path) else [self.path]
        if not files or not os.path.exists(files[0]):
            raise FileNotFoundError(self.path)
        return [InputPartition(f) for f in files]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        with open(partition.value, "rb") as f:
            rows = records_of(f.read(), self.kind)
        names = columns_of(self.kind)
        for k in range(0, len(rows), BATCH):
            part = rows[k : k + BATCH]
            columns = [pa.array([v.decode() for v in part[n]]) if part[n].dtype.kind == "S" else pa.array(part[n].astype(np.int64)) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([os.path.basename(partition.value)] * len(part))], names=[*names, "file"])


class DbnSource(DataSource):
    """Options: path (a file, or a folder all executors share) and kind (mbp-1, mbp-10, ohlcv-1s). Prices stay in fixed point."""

    @classmethod
    def name(cls) -> str:
        return "dbn"

    def schema(self) -> str:
        kind = self.options.get("kind", "mbp-10")
        if kind not in KINDS:
            raise ValueError(f"unknown kind {kind}")
        return ", ".join(f"{n} {'string' if n in ('action', 'side') else 'bigint'}" for n in columns_of(kind)) + ", file string"

    def reader(self, schema) -> DbnReader:
        return DbnReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DbnSource)
