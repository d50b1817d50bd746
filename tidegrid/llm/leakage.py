"""Passages of evaluation items inside a corpus.

Size-partitioned MinHash containment search: the items are grouped by size; each group has its own length of windows and its
own banding, both chosen for the shortest passage of the group that counts. Windows of a document whose bands meet those of an
item's windows are candidates; they are verified by exact shingle containment along the item. Items and documents are worked
through in tasks and meet in joins, so neither is bounded; the corpus is read once.
"""

from __future__ import annotations

import html
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.chunked import lookup, same
from tidegrid.functions.shared import cut

#: Letters of other alphabets drawn like Latin ones.
LOOKALIKES = str.maketrans({
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ԛ": "Q", "Ԝ": "W",
    "α": "a", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "υ": "u", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "­": None, "​": None, "‌": None, "‍": None, "⁠": None, "﻿": None,
})
WORD = re.compile(r"[a-z]+|[0-9]+")
_ESCAPE = re.compile(r"\\u([0-9a-fA-F]{4})|\\x([0-9a-fA-F]{2})|\\[ntr]|%([0-9a-fA-F]{2})")
_BREAK = re.compile(r"([A-Za-z])-\r?\n[ \t]*(?:[#*>]+|//+|--)?[ \t]*(?=[a-z])")
SHINGLE = 3
#: Sizes of items, in words, at which their groups begin; from there on they double.
EDGES = (0, 56, 72, 96, 128, 192, 384, 768)
#: Hash functions of a signature at most, and the share of passages of the least density that may go unseen by it.
HASHES, MISS = 54, 0.002
#: Words worked on at once in a task.
BLOCK = 100_000
#: Positions of a document that are joined to its candidates as one row.
SPAN = 512
#: Bits of a filter for each key in it, and of a filter at most (64 MB); a fuller one lets more through, and loses nothing.
BITS_A_KEY, MOST_BITS = 64, 1 << 29


def _unescape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3]
    return chr(int(code, 16)) if code else " "


def plain(text: str) -> str:
    """The text without what a file's encoding or layout does to it: escapes, entities, look-alike letters, case, broken words."""
    if "\\" in text or "%" in text:
        text = _ESCAPE.sub(_unescape, text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text.translate(LOOKALIKES))
    if "-\n" in text or "-\r\n" in text:
        text = _BREAK.sub(r"\1", text)
    return text.lower()


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A random-looking permutation of 64-bit values (the finaliser of a well-known generator)."""
    with np.errstate(over="ignore"):
        z = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed + 1)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def word_codes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """A 64-bit code by word, the same in every task; `known` keeps those met before."""
    if len(known) > 1_000_000:
        known.clear()
    for w in {*words} - known.keys():
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.array([known[w] for w in words], np.uint64)


def shingle_codes(words: np.ndarray) -> np.ndarray:
    """The code of the shingle that starts at each word."""
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = _mix(out ^ words[k : n + k], k)
    return out


@dataclass(frozen=True)
class Banding:
    """How items of a size are searched: windows of `length` shingles every `stride` of a document, bands of `rows` hashes."""

    part: int
    length: int
    stride: int
    rows: int
    bands: int


def size_part(words: int) -> int:
    """The group of an item of so many words."""
    if words < EDGES[-1]:
        return sum(words >= e for e in EDGES[1:])
    return len(EDGES) - 1 + int(math.log2(words / EDGES[-1]))


def banding(part: int, share: float, least_words: int, density: float) -> Banding:
    """Windows and bands of a group.

    Two aligned windows of which a share `density` of the shingles stands have the similarity density / (2 - density). The
    longer the shortest passage of the group, the more whole windows lie in it, and the more rows a band may have without
    losing passages: most rows are taken at which no more than MISS of them go unseen with HASHES hashes.
    """
    low = EDGES[part] if part < len(EDGES) else EDGES[-1] << (part - len(EDGES) + 1)
    passage = max(least_words, int(share * low)) - SHINGLE + 1
    similarity = density / (2 - density)
    for rows, part_of in ((3, 6), (2, 3)):
        length = passage // part_of
        stride = max(1, length // 2)
        windows = (passage - length + 1) // stride
        bands = math.ceil(math.log(MISS) / (windows * math.log(1 - similarity**rows)))
        if length >= 8 and rows * bands <= HASHES:
            return Banding(part, length, stride, rows, bands)
    length = max(4, passage * 2 // 3)
    return Banding(part, length, max(1, length // 2), 1, math.ceil(math.log(MISS) / math.log(1 - similarity)))


def window_mins(hashed: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Minima over [start, start + length) of each row: two overlapping power-of-two blocks, as in a sparse table."""
    block, width = hashed, 1
    while width * 2 <= length and block.shape[1] > width:
        block = np.minimum(block[:, :-width], block[:, width:])
        width *= 2
    last = block.shape[1] - 1
    return np.minimum(block[:, np.minimum(starts, last)], block[:, np.minimum(starts + length - width, last)])


def band_keys(hashed: np.ndarray, starts: np.ndarray, b: Banding) -> np.ndarray:
    """Keys (bands x windows) of the windows that begin at `starts`; hashed: hashes x shingles."""
    mins = window_mins(hashed[: b.rows * b.bands], starts, b.length)
    out = np.empty((b.bands, len(starts)), np.uint64)
    for k in range(b.bands):
        key = np.full(len(starts), (b.part << 16) + k + 1, np.uint64)
        for r in range(b.rows):
            key = _mix(key ^ mins[k * b.rows + r], 7)
        out[k] = key
    return out


def hashes_of(codes: np.ndarray, count: int) -> np.ndarray:
    out = np.empty((count, len(codes)), np.uint64)
    for h in range(count):
        out[h] = _mix(codes, h)
    return out


def _places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of a key in a filter of `bits` (a power of two)."""
    low = np.uint64(bits - 1)
    return [keys & low, (keys >> np.uint64(33)) & low, _mix(keys, 11) & low]


def filter_of(df: DataFrame, column: str, count: int) -> np.ndarray:
    """A Bloom filter of the keys of a LONG column, put together in tasks; its size is bounded, whatever the count."""
    bits = 1 << min(MOST_BITS.bit_length() - 1, max(10, (max(count, 1) * BITS_A_KEY - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_places(b.column(0).to_numpy().view(np.uint64), bits)))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            mask = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(mask.view(np.int64))], names=["word", "mask"])

    words = df.select(column).mapInArrow(run, "word bigint, mask bigint").groupBy("word").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(np.uint64)
    return out


def passes(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys the filter may hold."""
    left = np.arange(len(keys))
    for k in range(3):
        at = _places(keys[left], len(words) * 64)[k]
        left = left[(words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
    out = np.zeros(len(keys), bool)
    out[left] = True
    return out


def item_rows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """item_id, part, words, codes (of the shingles in order), word_of (the word of each token); items too short for a shingle are left out."""
    kind = items.schema[item_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            at, parts, sizes, codes, words_of = [], [], [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                # A word of an item is what stands between blanks; it may hold several tokens.
                spaced = [WORD.findall(w) for w in plain(t or "").split()]
                flat = [x for w in spaced for x in w]
                if len(flat) < SHINGLE:
                    continue
                at.append(i)
                parts.append(size_part(len(spaced)))
                sizes.append(len(spaced))
                codes.append(shingle_codes(word_codes(flat, known)).view(np.int64))
                words_of.append(np.repeat(np.arange(len(spaced)), [len(w) for w in spaced]))
            ids = b.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(parts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(codes, pa.list_(pa.int64())), pa.array(words_of, pa.list_(pa.int32()))],
                names=["item", "part", "words", "codes", "word_of"],
            )

    return items.select(item_id, text).distinct().mapInArrow(run, f"item {kind}, part int, words int, codes array<bigint>, word_of array<int>")


def item_keys(rows: DataFrame, bandings: dict[int, Banding]) -> DataFrame:
    """item, key: the band keys of all windows of the items, each once."""
    kind = rows.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys = [], []
            for i, (part, codes) in enumerate(zip(b.column(1).to_pylist(), b.column(2))):
                c, how = codes.values.to_numpy().view(np.uint64), bandings[part]
                own = np.unique(band_keys(hashes_of(c, how.rows * how.bands), np.arange(max(1, len(c) - how.length + 1)), how))
                at.append(np.full(len(own), i))
                keys.append(own.view(np.int64))
            if at:
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.concatenate(at))), pa.array(np.concatenate(keys))], names=["item", "key"])

    return rows.select("item", "part", "codes").mapInArrow(run, f"item {kind}, key bigint")


@dataclass
class Search:
    """What a task needs to search documents: the bandings in use with their reach in tokens, and the two filters."""

    bandings: list[tuple[Banding, int]]
    keys: np.ndarray
    codes: np.ndarray

    def block(self, words: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
        """Of a run of words the (positions, keys) of windows that may meet an item's, and the positions of shingles near them that items may have."""
        codes = shingle_codes(words)
        n = len(codes)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if not n:
            return found, np.empty(0, np.int64)
        hashed = hashes_of(codes, max(b.rows * b.bands for b, _ in self.bandings))
        near = np.zeros(n + 1, np.int64)
        for b, reach in self.bandings:
            starts = np.arange(0, max(1, n - b.length + 1 + b.stride), b.stride)
            starts = starts[starts < n]
            keys = band_keys(hashed, starts, b)
            hit = passes(self.keys, keys.ravel()).reshape(keys.shape)
            band, window = np.nonzero(hit)
            if len(band):
                found.append((starts[window], keys[band, window]))
                own = starts[np.unique(window)]
                np.add.at(near, np.maximum(own - reach, 0), 1)
                np.add.at(near, np.minimum(own + b.length + reach, n), -1)
        inside = np.flatnonzero(np.cumsum(near[:-1]) > 0)
        return found, inside[passes(self.codes, codes[inside])]


def scan(documents: DataFrame, doc_id: str, text: str, search) -> DataFrame:
    """One pass over the texts: doc, pos, value, is_key: band keys of windows, and shingles near them, that pass the filters."""
    kind = documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Search = search.value
        known: dict[str, int] = {}

        def flush(words: list[str], at: list[int], docs: list[int], ids: pa.Array) -> pa.RecordBatch | None:
            codes = word_codes(words, known)
            shingles = shingle_codes(codes)
            found, spots = s.block(codes)
            pos = np.concatenate([*[p for p, _ in found], spots]).astype(np.int64)
            if not len(pos):
                return None
            value = np.concatenate([*[k for _, k in found], shingles[spots]]).astype(np.uint64).view(np.int64)
            is_key = np.arange(len(pos)) < len(pos) - len(spots)
            d = np.searchsorted(at, pos, side="right") - 1
            local = pos - np.array(at)[d]
            return pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(docs)[d])), pa.array(local.astype(np.int32)), pa.array(value), pa.array(is_key)], names=["doc", "pos", "value", "is_key"])

        for b in batches:
            words: list[str] = []
            at: list[int] = []
            docs: list[int] = []
            for i, t in enumerate(b.column(1).to_pylist()):
                if not t:
                    continue
                at.append(len(words))
                docs.append(i)
                words.extend(WORD.findall(plain(t)))
                words.extend(("\n", "\r"))  # no word of a text: shingles across texts are none of an item
                if len(words) >= BLOCK:
                    out = flush(words, at, docs, b.column(0))
                    if out is not None:
                        yield out
                    words, at, docs = [], [], []
            if words:
                out = flush(words, at, docs, b.column(0))
                if out is not None:
                    yield out

    return documents.select(doc_id, text).mapInArrow(run, f"doc {kind}, pos int, value bigint, is_key boolean")


def verify(words: int, word_of: np.ndarray, spots: list[tuple[int, int]], share: float, least_words: int, density: float, gap: int, slack: float = 0.9) -> bool:
    """Exact containment: a connected stretch of the document holds a passage of the item, long enough and dense enough.

    spots: the shared shingles as (position in the document, position in the item). slack: an altered word at an end of a
    passage takes the shingles around it along, so the stretch seen may be shorter than the passage by this factor.
    """
    need = max(least_words, slack * share * words)
    if len(spots) < density * (need - SHINGLE + 1):  # a word has at least one token, so it can't be dense enough
        return False
    return any(_holds(c, word_of, need, density) for c in chains(spots, gap))


def chains(spots: list[tuple[int, int]], gap: int, drift: int = 6) -> Iterator[list[tuple[int, int]]]:
    """The shared shingles of an item in chains, each a connected stretch of the document.

    Shared shingles are chained in the order of the document while at most `gap` tokens lie between and the place in the item
    moves on alike, within `drift` tokens for what was put in or left out; phrases that stand elsewhere in the item don't count.
    """
    live: list[list[tuple[int, int]]] = []
    for a, q in spots:
        home = None
        for c in live:
            if a - c[-1][0] <= gap and abs((q - c[-1][1]) - (a - c[-1][0])) <= drift:
                home = c if home is None or len(c) > len(home) else home
        if home is None:
            live.append([(a, q)])
        else:
            home.append((a, q))
        live, old = [c for c in live if a - c[-1][0] <= gap], [c for c in live if a - c[-1][0] > gap]
        yield from old
    yield from live


def _holds(chain: list[tuple[int, int]], word_of: np.ndarray, need: float, density: float) -> bool:
    """Whether some stretch of the item spans `need` words or more, of whose shingles the chain holds the share `density`.

    Between two held places i <= j the share is (j - i + 1) / (q_j - q_i + 1), so for each end j the start with the least
    i - density * q_i decides, among those far enough before it.
    """
    q = np.unique(np.array([x for _, x in chain]))
    k = np.arange(len(q))
    starts = np.minimum.accumulate(k - density * q)
    # Starts up to `far` leave words enough to the end j.
    far = np.searchsorted(word_of[q], word_of[q + SHINGLE - 1] + 1 - need, side="right") - 1
    ends = far >= 0
    return bool((k[ends] + 1 - density * (q[ends] + 1) >= starts[np.minimum(far, k)[ends]] - 1e-9).any())


def spots_of(codes: list[int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(position in the document, position in the item) of the shingles (position, code) of a document that the item has."""
    places: dict[int, list[int]] = {}
    for q, c in enumerate(codes):
        places.setdefault(c, []).append(q)
    return [(a, q) for a, c in sorted(set(found)) for q in places.get(c, ())]


def shared_spots(spots: pa.ListArray, codes: pa.ListArray, least: float) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """Of a batch of pairs those with at least `least` shared places, with the (position, code) that the item has too; all pairs at once."""
    n = len(spots)
    if not n:
        return
    flat = spots.flatten()
    pos, code = flat.field(0).to_numpy(), flat.field(1).to_numpy()
    owner = np.repeat(np.arange(n), pa.compute.list_value_length(spots).to_numpy(zero_copy_only=False).astype(np.int64))
    of_item = np.repeat(np.arange(n), pa.compute.list_value_length(codes).to_numpy(zero_copy_only=False).astype(np.int64))
    pair = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        mine, theirs = (_mix(c.view(np.uint64) ^ (o.astype(np.uint64) * pair), 13) for c, o in ((code, owner), (codes.flatten().to_numpy(), of_item)))
    known, times = np.unique(theirs, return_counts=True)
    at = np.minimum(np.searchsorted(known, mine), max(0, len(known) - 1))
    hit = known[at] == mine if len(known) else np.zeros(len(mine), bool)
    enough = np.bincount(owner[hit], weights=times[at[hit]] if len(known) else None, minlength=n) >= least
    use = np.flatnonzero(hit & enough[owner])
    for part in np.split(use, np.flatnonzero(np.diff(owner[use])) + 1) if len(use) else ():
        yield int(owner[part[0]]), list(zip(pos[part].tolist(), code[part].tolist()))


def leaks(
    documents: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str,
    share: float = 0.25, least_words: int = 11, density: float = 0.5, gap: int = 16,
) -> DataFrame:
    """One row (item_id, doc_id) per document and item of which the document holds a passage.

    A passage is a connected stretch of at least `share` of the item's words and `least_words` words, of which at least
    `density` of the shingles stand unaltered. Items are indexed in tasks; a filter of bounded size made from their band keys
    goes to the tasks that read the corpus, once and whole; what passes it meets the keys in a join, and the pairs that share
    a key are verified on the shingles around. Defined cases: NULL, empty and very short texts and items match nothing;
    repeated rows count once; a NULL id is an id; documents of one id count as one, wherever a passage stands in them; other
    columns are not read.
    """
    kinds = documents.schema[doc_id].dataType, items.schema[item_id].dataType
    rows = cut(item_rows(items, item_id, item_text))
    parts = rows.groupBy("part").agg(F.max(F.size("word_of")).alias("tokens"), F.sum(F.size("codes")).alias("codes")).collect()  # a few groups of sizes
    if not parts:
        return documents.sparkSession.createDataFrame([], f"`{item_id}` {kinds[1].simpleString()}, `{doc_id}` {kinds[0].simpleString()}")
    bandings = {r["part"]: banding(r["part"], share, least_words, density) for r in parts}
    total = sum(r["codes"] for r in parts)
    keys = cut(item_keys(rows, bandings))
    n_keys = keys.count()
    search = Search(
        [(bandings[r["part"]], r["tokens"] + gap) for r in parts], filter_of(keys, "key", n_keys), filter_of(rows.select(F.explode("codes").alias("code")), "code", total)
    )
    met = cut(scan(documents, doc_id, text, documents.sparkSession.sparkContext.broadcast(search)))
    reach = F.create_map(*[F.lit(x) for r in parts for x in (r["part"], r["tokens"] + gap + bandings[r["part"]].length)])

    # Pairs with a common key, and the spans of the document around; a key of many windows is spread over tasks.
    pairs = lookup(met.filter("is_key").select("doc", "pos", F.col("value").alias("key")), keys, ["key"], n_keys, "inner")
    pairs = lookup(pairs.select("doc", "pos", "item").distinct(), rows.select("item", "part"), ["item"], total, "inner")
    low, high = F.floor(F.greatest(F.col("pos") - reach[F.col("part")], F.lit(0)) / SPAN).cast("int"), F.floor((F.col("pos") + reach[F.col("part")]) / SPAN).cast("int")
    pairs = pairs.select("doc", "item", F.explode(F.sequence(low, high)).alias("span")).distinct()
    spans = met.filter("not is_key").groupBy("doc", F.floor(F.col("pos") / SPAN).cast("int").alias("span")).agg(F.collect_set(F.struct("pos", F.col("value").alias("code"))).alias("spots"))
    held = pairs.alias("l").join(spans.alias("r"), same("l", "r", ["doc", "span"])).select("l.doc", "l.item", "r.spots")
    held = held.groupBy("doc", "item").agg(F.flatten(F.collect_list("spots")).alias("spots"))
    whole = lookup(held, rows.select("item", "words", "codes", "word_of"), ["item"], total, "inner")
    names = ["item", "doc"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            codes, words = b.column(b.schema.get_field_index("codes")), b.column(b.schema.get_field_index("words")).to_pylist()
            word_of = b.column(b.schema.get_field_index("word_of"))
            for i, own in shared_spots(b.column(b.schema.get_field_index("spots")), codes, density * (least_words - SHINGLE + 1)):
                if verify(words[i], word_of[i].values.to_numpy(), spots_of(codes[i].values.to_pylist(), own), share, least_words, density, gap):
                    keep.append(i)
            yield b.select(names).take(pa.array(keep, pa.int64()))

    out = whole.select("item", "doc", "spots", "words", "codes", "word_of").mapInArrow(judge, f"item {kinds[1].simpleString()}, doc {kinds[0].simpleString()}")
    return out.distinct().select(F.col("item").alias(item_id), F.col("doc").alias(doc_id))
