"""Orphan references kept up batch by batch: new references probe the parents, arriving parents resolve, deletions reopen.

The state lies in a folder that all executors share, split by the hash of the key: the number of parents on record by key
(`index`), the references that wait (`waiting`) and those that are answered (`answered`). A batch reads the index and the
waiting references of the buckets its keys fall into, and answered ones only where a key of theirs lost its last parent;
it writes new files for these buckets and then moves the pointer `current.json`. Until then the state before stands, so a
batch that was interrupted is simply done again, and an object made later goes on where the last one stopped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.chunked import PIECE, lookup
from tidegrid.functions.shared import cut
from tidegrid.operators.orphans import parent_changes, timeline
from tidegrid.sources.files import delete, exists, read_json, write_json

PARTS = ("index", "waiting", "answered")
#: The moment of what was on record before a batch.
BEFORE = -(2**63) + 1


class IncrementalOrphans:
    """References (id, k0.., t) to parents whose changes are (k0.., t, change), as parent_changes gives them; t in microseconds.

    Batches are cut by time: each holds what happened since the batch before. step() returns the events of a batch: id, keys,
    t, event, with "orphaned" at the reference's own moment, "resolved" and "reopened" at those of the parents. Of several
    changes to and fro within one batch the first and the last are told.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], id_type: str = "bigint", buckets: int = 16, piece: int = PIECE):
        self.spark, self.folder, self.names, self.buckets, self.piece = spark, folder.rstrip("/"), keys, buckets, piece
        self.kinds = {"index": "on_record bigint", "waiting": f"id {id_type}, t bigint", "answered": f"id {id_type}, t bigint"}
        pointer = f"{self.folder}/current.json"
        self.state = read_json(spark, pointer) if exists(spark, pointer) else {"version": 0, **{p: {} for p in PARTS}, "events": []}

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.names), F.lit(self.buckets)).cast("int")

    def _read(self, part: str, buckets: list[int], keys: str) -> DataFrame:
        """The rows of a part in these buckets."""
        paths = [f"{self.folder}/{v}/{part}/bucket={b}" for b in buckets for v in self.state[part].get(str(b), [])]
        schema = f"{keys}, {self.kinds[part]}"
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def step(self, references: DataFrame, changes: DataFrame) -> DataFrame:
        n, spark = self.names, self.spark
        keys = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in references.schema.fields if f.name in n)
        version = self.state["version"] + 1
        home = f"{self.folder}/{version}"
        delete(spark, home)  # of a batch that was interrupted
        refs = references.select("id", *n, "t")
        touched = refs.select(self._bucket().alias("b")).union(changes.select(self._bucket().alias("b"))).distinct()
        touched = sorted(r["b"] for r in touched.collect())  # at most `buckets` numbers

        index = self._read("index", touched, keys).select(*n, F.lit(BEFORE).alias("t"), F.col("on_record").alias("change"))
        rows = cut(timeline(index.unionByName(changes.select(*n, "t", "change")), refs, n, self.piece))
        flip = (F.col("is_ref") == 0) & (F.col("t") > BEFORE)
        own = rows.filter("is_ref = 0").groupBy(*n).agg(
            F.max_by("on_record", "t").alias("after"), *[F.min(F.when(flip & F.col(f), F.col("t"))).alias(f"first_{f}") for f in ("up", "down")],
            *[F.max(F.when(flip & F.col(f), F.col("t"))).alias(f"last_{f}") for f in ("up", "down")],
        )
        own = cut(own)
        moved = own.filter("first_up is not null or first_down is not null")
        lost = sorted(r["b"] for r in moved.filter("first_down is not null").select(self._bucket().alias("b")).distinct().collect())
        few = own.count()

        fresh = lookup(rows.filter("is_ref = 1").select("id", *n, "t", (F.col("on_record") > 0).alias("ok"), "next_up", "next_down"), own, n, few).withColumn("fresh", F.lit(True))
        waiting = lookup(self._read("waiting", touched, keys), own, n, few).withColumns({"ok": F.lit(False), "next_up": F.col("first_up"), "next_down": F.col("first_down")})
        shaken = lookup(self._read("answered", lost, keys), own, n, few).withColumns({"ok": F.lit(True), "next_up": F.col("first_up"), "next_down": F.col("first_down")})
        columns = ["id", *n, "t", "ok", "next_up", "next_down", "after", "last_up", "last_down", "fresh"]
        every = fresh.select(*columns).unionByName(waiting.withColumn("fresh", F.lit(False)).select(*columns)).unionByName(shaken.withColumn("fresh", F.lit(False)).select(*columns))
        ends_well = F.coalesce(F.col("after") > 0, F.lit(False))

        def event(name: str, when: Column, at: Column) -> Column:
            return F.when(when, F.struct(F.lit(name).alias("event"), at.alias("at")))

        ok, up, down = F.col("ok"), F.col("next_up"), F.col("next_down")
        events = F.array_compact(F.array(
            event("orphaned", F.col("fresh") & ~ok, F.col("t")), event("resolved", ~ok & up.isNotNull(), up), event("reopened", ~ok & up.isNotNull() & ~ends_well, F.col("last_down")),
            event("reopened", ok & down.isNotNull(), down), event("resolved", ok & down.isNotNull() & ends_well, F.col("last_up")),
        ))
        # A reference whose key nothing happened to stays as it is.
        answered = F.when(ok, down.isNull() | ends_well).otherwise(up.isNotNull() & ends_well)
        every = cut(every.select("id", *n, "t", "fresh", F.col("ok").alias("was"), answered.alias("answered"), events.alias("events")))

        def write(part: str, df: DataFrame) -> None:
            df.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{home}/{part}")

        every.select("id", *n, F.explode("events").alias("e")).select("id", *n, F.col("e.at").alias("t"), "e.event").write.mode("overwrite").parquet(f"{home}/events")
        write("index", own.filter("after <> 0").select(*n, F.col("after").alias("on_record")))
        write("waiting", every.filter("not answered").select(*n, "id", "t"))
        write("answered", every.filter("answered").select(*n, "id", "t"))
        for part, whole in (("index", touched), ("waiting", touched), ("answered", lost)):
            here = {str(b) for b in touched if exists(spark, f"{home}/{part}/bucket={b}")}
            for b in map(str, touched):
                kept = [] if int(b) in whole else self.state[part].get(b, [])
                self.state[part][b] = kept + ([version] if b in here else [])
        self.state |= {"version": version, "events": [*self.state["events"], version]}
        write_json(spark, f"{self.folder}/current.json", self.state)
        return self.events([version], keys)

    def events(self, versions: list[int] | None = None, keys: str | None = None) -> DataFrame:
        """The events of these batches, or of all."""
        paths = [f"{self.folder}/{v}/events" for v in (self.state["events"] if versions is None else versions)]
        return self.spark.read.parquet(*paths)

    def snapshot(self) -> DataFrame:
        """Counts of the references by whether their key is on record now: answered, references."""
        every = [self.spark.read.parquet(*paths).select(F.lit(p == "answered").alias("answered")) for p in PARTS[1:] if (paths := [f"{self.folder}/{v}/{p}/bucket={b}" for b, vs in self.state[p].items() for v in vs])]
        out = self.spark.createDataFrame([], "answered boolean")
        for d in every:
            out = out.unionByName(d)
        return out.groupBy("answered").agg(F.count("*").alias("references"))

    def replay(self, references: DataFrame, changes: DataFrame, period: str = "quarter") -> DataFrame:
        """Step through a history period by period and return all events. References without a time come with the first one."""
        at = F.date_trunc(period, F.timestamp_micros("t"))
        spans = references.select(at.alias("p")).union(changes.select(at.alias("p"))).filter("p is not null").distinct().orderBy("p")
        starts = [r["p"] for r in spans.select(F.unix_micros("p").alias("p")).collect()] or [0]  # periods of a history are few
        for k, low in enumerate(starts):
            span = F.lit(True) if len(starts) == 1 else (F.col("t") >= low if k + 1 == len(starts) else (F.col("t") >= low) & (F.col("t") < starts[k + 1]))
            self.step(references.filter(span | F.col("t").isNull() if k == 0 else span), changes.filter(span))
        return self.events()


__all__ = ["IncrementalOrphans", "parent_changes"]
