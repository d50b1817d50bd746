"""Vendor records into canonical frames: fixed-point prices to ticks, codes, levels, bars, definitions; manifests of tables."""

from __future__ import annotations

import dataclasses
import os
import subprocess
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.sources.files import delete, exists, read_json, write_json
from tidegrid.schema import ADD, ASK, BID, CANCEL, CLEAR, FILL, MODIFY, NONE, TRADE, UNDEFINED_PRICE

# The vendor's letters.
ACTIONS = {"A": ADD, "C": CANCEL, "M": MODIFY, "T": TRADE, "F": FILL, "R": CLEAR}
SIDES = {"B": BID, "A": ASK, "N": NONE}


def to_ticks(fixed: Column, tick: Column) -> Column:
    """Fixed-point price (1e-9) in whole ticks, halves to even; the undefined price is NULL."""
    return F.when(fixed == UNDEFINED_PRICE, None).otherwise(F.rint(fixed * 1e-9 / tick).cast("long"))


def _decode(values: dict[str, int], code: Column, other: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[code.cast("string")], F.lit(other))


def book_frame(records: DataFrame, tick: Column, levels: int) -> DataFrame:
    """Book records (bid_px_00.. in fixed point, letters for action and side) as a canonical frame; unknown letters become MODIFY and NONE."""
    px = [to_ticks(F.col(f"{s}_px_{i:02d}"), tick).alias(f"{s}_px_{i}") for i in range(levels) for s in ("bid", "ask")]
    sz = [F.col(f"{s}_sz_{i:02d}").cast("long").alias(f"{s}_sz_{i}") for i in range(levels) for s in ("bid", "ask")]
    keep = [c for c in ("window_id", "instrument", "sequence", "instrument_id") if c in records.columns]
    return records.select(
        *keep, F.col("ts_event").cast("long").alias("ts_event"), _decode(ACTIONS, F.col("action"), MODIFY).alias("action"), _decode(SIDES, F.col("side"), NONE).alias("side"),
        to_ticks(F.col("price"), tick).alias("price"), F.col("size").cast("long").alias("size"), *px, *sz,
    )


def bar_frame(records: DataFrame, tick: Column) -> DataFrame:
    keep = [c for c in ("window_id", "instrument") if c in records.columns]
    return records.select(*keep, "ts_event", *[to_ticks(F.col(c), tick).alias(c) for c in ("open", "high", "low", "close")], F.col("volume").cast("long").alias("volume"))


def definitions(records: DataFrame, order: str) -> DataFrame:
    """The last record of each instrument_id: raw_symbol, tick_size, multiplier (NULL if not positive), expiration_ns."""
    last = records.groupBy("instrument_id").agg(F.max_by(F.struct("raw_symbol", "min_price_increment", "unit_of_measure_qty", "expiration"), order).alias("r"))
    unit = F.col("r.unit_of_measure_qty") * 1e-9
    return last.select("instrument_id", "r.raw_symbol", (F.col("r.min_price_increment") * 1e-9).alias("tick_size"), F.when(unit > 0, unit).alias("multiplier"), F.col("r.expiration").alias("expiration_ns"))


class IncompleteTableError(RuntimeError):
    """A table without its manifest: the run that wrote it did not end."""


def run_info(command: str, settings: object) -> dict:
    """What a manifest says of the run: command, time, the code's version (if it is a git checkout) and all settings."""
    here = os.path.dirname(os.path.abspath(__file__))
    try:
        version = subprocess.run(["git", "-C", here, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10).stdout.strip() or None
    except OSError:
        version = None
    return {"command": command, "written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "version": version, "settings": dataclasses.asdict(settings) if dataclasses.is_dataclass(settings) else settings}


def write_with_manifest(df: DataFrame, path: str, info: dict, partition: list[str] | None = None) -> None:
    """Overwrite a table, its manifest last: a table is whole if and only if the manifest is there. Any file system of the cluster."""
    spark, marker = df.sparkSession, path.rstrip("/") + ".manifest.json"
    delete(spark, marker)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition) if partition else writer).parquet(path)
    write_json(spark, marker, {"written_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "schema": df.schema.jsonValue(), **info})


def read_with_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The table, with the columns and types it was written with."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    marker = path.rstrip("/") + ".manifest.json"
    if not exists(spark, marker):
        raise IncompleteTableError(path)
    schema = T.StructType.fromJson(read_json(spark, marker)["schema"])
    return spark.read.schema(schema).parquet(path).select(*schema.names)


def text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with all columns as text, for validation before typing; a file without its header's columns is an error."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    head = spark.read.text(path).limit(1).collect()
    have = [c.strip().strip('"') for c in head[0][0].lstrip("\ufeff").split(",")] if head else []
    if lacking := [c for c in columns if c not in have]:
        raise ValueError(f"{path}: " + ("the file is empty" if not head else "missing columns " + ", ".join(lacking)))
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for small result tables."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def template(path: str, columns: list[str]) -> bool:
    """An empty CSV with its header, never over a file that exists."""
    if os.path.exists(path):
        return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w") as f:
        f.write(",".join(columns) + "\n")
    return True
