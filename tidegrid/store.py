"""Stored panels: built once from books and stages, then read by the analyses, pruned by event type and instrument."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from tidegrid.config import Study
from tidegrid.functions.shared import ensure_checkpoint_dir
from tidegrid.operators import panel
from tidegrid.sources.files import delete, exists, write_json
from tidegrid.sources.records import IncompleteTableError, read_with_manifest, run_info, write_with_manifest

PRUNED = ["event_type", "instrument"]
PARTS = ("coarse", "fine", "baselines", "moves", "validation")


def build_panels(spark: SparkSession, ticks: DataFrame, stages: DataFrame, study: Study, path: str, info: dict | None = None, on: tuple[str, ...] = ("window_id",)) -> None:
    """Write both panels, baselines, moves and the validation of the events; the store's manifest comes last.

    Old parts go first, so a build that was interrupted is never read. Baselines and spike ratios are made from the stored
    coarse panel, not from the ticks again.
    """
    marker = f"{path}/manifest.json"
    delete(spark, marker)
    for part in PARTS:
        delete(spark, f"{path}/{part}")
    for name, grid in (("coarse", study.coarse), ("fine", study.fine)):
        write_with_manifest(panel.panel(ticks, stages, grid.grid(name), on=on), f"{path}/{name}", {}, PRUNED)
    write_with_manifest(panel.mid_changes(ticks, stages, study.moves_s, on), f"{path}/moves", {}, PRUNED)
    coarse = read_with_manifest(spark, f"{path}/coarse")
    write_with_manifest(panel.baselines(coarse, study.baseline_s), f"{path}/baselines", {})
    ratios = panel.spike_ratios(coarse.filter("event_type <> 'CONTROL'"), study.quiet_s, study.spike_s)
    write_with_manifest(panel.confirmed_events(ratios, study.references, study.least_spike_ratio), f"{path}/validation", {})
    write_json(spark, marker, run_info("panel build", study) | (info or {}))


def read_part(spark: SparkSession, path: str, part: str) -> DataFrame:
    """A part of a whole store; an error while its manifest is missing."""
    if not exists(spark, f"{path}/{part}"):
        raise FileNotFoundError(f"{path}/{part}")
    if not exists(spark, f"{path}/manifest.json"):
        raise IncompleteTableError(path)
    return read_with_manifest(spark, f"{path}/{part}")


def session_table(spark: SparkSession, inputs: list[str], name: str, make) -> DataFrame:
    """The table that `make()` gives, written once a session for these input files (by path, size and time) and read from then on."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = []
    for i in inputs:
        p = jvm.org.apache.hadoop.fs.Path(i)
        s = p.getFileSystem(conf).getFileStatus(p)
        seen.append(f"{i} {s.getLen()} {s.getModificationTime()}")
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{hashlib.sha1(' '.join(seen).encode()).hexdigest()}"
    if not exists(spark, f"{path}.manifest.json"):
        write_with_manifest(make(), path, {"inputs": seen}, PRUNED)
    return read_with_manifest(spark, path)
