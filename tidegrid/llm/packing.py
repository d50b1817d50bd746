"""Items into containers of fixed capacity with little space left over.

Karmarkar-Karp multiway differencing: every item begins as a partial partition of its own; the two partial partitions of the
largest spread are merged, the largest windows of one with the smallest of the other, until one partition of near-equal windows
remains. Where a window exceeds the capacity the number of windows rises. Items are packed in blocks of bounded size, so that a
group holding most of all items is many blocks.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.chunked import lookup
from tidegrid.functions.shared import cut

#: Ranks of a public byte-level tokenizer, and the pattern by which it splits text (fixed value).
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """The items (by index) of each window after multiway differencing."""
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Both are in descending order; windows not listed are empty. The k-th largest of one meets the k-th smallest of the other.
        both = len(a) + len(b) - windows
        if both <= 0:
            merged = a + b
        else:
            keep = len(a) - both
            if keep < 0:  # b is the longer one
                a, b, keep = b, a, len(b) - both
            free = len(b) - both  # the largest of b go to the empty windows
            merged = a[:keep] + b[:free] + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(a[keep:], reversed(b[free:]))]
        merged.sort(key=lambda w: -w[0])
        low = merged[-1][0] if len(merged) == windows else 0
        heapq.heappush(heap, (low - merged[0][0], serial, merged))
        serial += 1
    out = []
    for _, tree in heap[0][2] if heap else []:
        items, todo = [], [tree]
        while todo:
            x = todo.pop()
            if isinstance(x, tuple):
                todo.extend(x)
            else:
                items.append(x)
        out.append(items)
    return out


def pack(sizes: list[int], capacity: int, full: float = 0.98) -> list[list[int]]:
    """Windows (lists of indices) of at most `capacity`; no item may be larger.

    Differencing starts with the least number of windows that could hold all. Windows filled to `full` and within the capacity
    are closed; the items of the others are differenced again. When a round closes nothing the number of windows rises, until
    no window exceeds the capacity.
    """
    left = [i for i, s in enumerate(sizes) if s > 0]
    empty = [i for i, s in enumerate(sizes) if s <= 0]
    done: list[list[int]] = []
    extra, aim = 0, full
    while left:
        part = [sizes[i] for i in left]
        windows = max(1, -(-sum(part) // capacity) + extra)
        found = [[left[i] for i in w] for w in difference(part, windows)]
        load = [sum(sizes[i] for i in w) for w in found]
        if max(load) <= capacity:
            done += found
            break
        closed = [w for w, n in zip(found, load) if aim * capacity <= n <= capacity]
        if closed:
            done += closed
            gone = {i for w in closed for i in w}
            left = [i for i in left if i not in gone]
        else:
            extra += max(1, windows // 50)
            aim = max(0.9, aim - 0.01)
    if empty:  # items without size go with the first window
        done = [done[0] + empty, *done[1:]] if done else [empty]
    return done


@lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(documents: DataFrame, doc_id: str, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, the columns of keep, tokens: the length of each text by the public tokenizer whose ranks are in `vocabulary`.

    NULL texts have no row, empty ones 0 tokens. Whole texts are counted.
    """
    columns = list(dict.fromkeys([doc_id, *keep]))
    schema = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary).encode_ordinary
        for b in batches:
            tokens = pa.array([len(encode(t)) for t in b.column(len(columns)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], tokens], names=[*columns, "tokens"])

    return documents.filter(F.col(text).isNotNull()).select(*columns, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, tokens bigint")


def fill_containers(items: DataFrame, item_id: str, size: str, plans: list[tuple[int, int, str | None]], block: int = 1_024) -> DataFrame:
    """plan_id, container_id, item_id, piece, start, size: the container of every item, or of every piece of an item too large.

    plans: (plan_id, capacity, column or None); with a column a container holds items of one value of it only. An item larger
    than the capacity is cut into pieces of the capacity, each a container, and a rest, which is packed like an item. The
    items of a plan and group fall by hash into blocks of about `block`, each packed by itself. Defined cases: sizes of 0 go
    with another item, NULL sizes count as 0; a NULL group is a group; repeated items are packed each; an empty table gives no
    rows.
    """
    rows = items.select(F.col(item_id).alias("__id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"), *[F.col(c).alias(f"__c{i}") for i, (_, _, c) in enumerate(plans) if c])
    wanted = F.array(*[
        F.struct(F.lit(p).cast("int").alias("plan_id"), F.lit(n).cast("long").alias("capacity"), (F.col(f"__c{i}").cast("string") if c else F.lit("")).alias("grp"))
        for i, (p, n, c) in enumerate(plans)
    ])
    rows = rows.select("__id", "__size", F.explode(wanted).alias("p")).select("__id", "__size", "p.*")
    whole, rest = F.expr("__size div capacity"), F.col("__size") % F.col("capacity")
    fits = F.col("__size") <= F.col("capacity")
    full = rows.filter(~fits).select("*", F.explode(F.sequence(F.lit(0).cast("long"), whole - 1)).alias("piece"))
    full = full.select("plan_id", F.concat_ws("/", F.lit("full"), F.col("__id").cast("string"), F.col("piece").cast("string")).alias("container_id"),
                       "__id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"))
    open_ = rows.filter(fits | (rest > 0)).select(
        "__id", "plan_id", "capacity", "grp", F.when(fits, 0).otherwise(whole).cast("int").alias("piece"),
        F.when(fits, F.lit(0)).otherwise(F.col("__size") - rest).alias("start"), F.when(fits, F.col("__size")).otherwise(rest).alias("size"),
    )
    # Only groups of more than one block need their number of blocks: fewer than one in `block` rows, and never a hot key of the join.
    counts = cut(open_.groupBy("plan_id", "grp").agg(F.ceil(F.count("*") / block).alias("blocks")).filter("blocks > 1"))
    open_ = lookup(open_, counts, ["plan_id", "grp"], counts.count())
    open_ = open_.withColumn("block", F.pmod(F.xxhash64("__id", "piece"), F.coalesce("blocks", F.lit(1).cast("long")))).drop("blocks")

    def run(key: tuple, part: pa.Table) -> pa.Table:
        part = part.sort_by([("__id", "ascending"), ("piece", "ascending")])  # the same containers however the rows came
        windows = pack(part.column("size").to_pylist(), part.column("capacity")[0].as_py())
        which = np.empty(part.num_rows, np.int64)
        for k, w in enumerate(windows):
            which[w] = k
        group, number = key[1].as_py(), key[2].as_py()
        names = pa.array([f"group/{group}/{number}/{k}" if group is not None else f"null/{number}/{k}" for k in which], pa.string())
        return part.select(["plan_id", "__id", "piece", "start", "size"]).append_column("container_id", names)

    kind = items.schema[item_id].dataType.simpleString()
    packed = open_.groupBy("plan_id", "grp", "block").applyInArrow(run, f"plan_id int, __id {kind}, piece int, start bigint, size bigint, container_id string")
    columns = ["plan_id", "container_id", "__id", "piece", "start", "size"]
    return packed.select(*columns).unionByName(full.select(*columns)).withColumnRenamed("__id", item_id)
