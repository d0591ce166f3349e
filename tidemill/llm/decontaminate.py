"""Benchmark items inside documents: size-partitioned MinHash containment search, verified exactly.

Texts are lower-cased (A-Z) and cut into words and five-word shingles. An item of fewer words has its
whole sequence as its only shingle, which a document has if the words stand in it side by side. The
containment of an item in a document is the share of the item's different shingles that the document
has; pairs at ``threshold`` or more count.

A short item and a long document have a tiny Jaccard similarity however much of the item the
document holds, so both sides are cut to one size. Items fall into classes by their number of
shingles (up to 1, 2, 4, 8, ...). For each class in use a document is covered by windows of twice the
class size, half overlapping, so that a passage of the class lies whole in some window. Item and
window are compared by ``hashes`` one-row MinHash bands: window minima come from block minima, from
the least class in use on, which the next class merges in pairs. A candidate shares any one minimum: at
containment 0.8 the similarity to its window is at least 0.19 in every class, so that 64 bands miss less
than one pair in 600 000. Items below the shingle length are looked up by the hash of their words among
all runs of as many words. Each candidate is then checked on its shingles themselves, over the whole
document.

Items are the query set. They are taken in blocks of ``block`` items and ``block_bytes`` bytes of
text at most, one after another, and each block goes to every task, so what is broadcast has a bound
whatever the size of the item table; an item beyond the byte bound is a block of its own. Documents
are never shuffled.

Defined results: null or empty texts match nothing; equal rows of documents or items each give their
own pairs; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel

SHINGLE, THRESHOLD, HASHES = 5, 0.8, 64
BLOCK, BLOCK_BYTES = 20_000, 16 << 20

_draw = kernel.mix(np.arange(1, 2 * 256 + 1, dtype=np.uint64) * kernel.BASE)
FACTOR = _draw[:256] | np.uint64(1)
OFFSET = _draw[256:]


def shingles(text: str, n: int, short: bool = True) -> frozenset[bytes]:
    """The different shingles themselves, as bytes; short: a text of fewer words is one shingle."""
    found = kernel.LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().split()
    if not found or len(found) < n and not short:
        return frozenset()
    k = min(n, len(found))
    return frozenset(b" ".join(found[i : i + k]) for i in range(len(found) - k + 1))


def _lookup(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    return table[(x >> np.uint64(32)) & np.uint64(0xFFFF)]


def _marks(x: np.ndarray) -> np.ndarray:
    """A cheap test of 2^16 bits that rules most other values out."""
    table = np.zeros(1 << 16, bool)
    table[(x >> np.uint64(32)) & np.uint64(0xFFFF)] = True
    return table


class Index:
    """MinHash signatures of a block of items, by size class."""

    def __init__(self, texts: list[str], n: int, hashes: int) -> None:
        self.n, self.hashes = n, hashes
        self.sets = [shingles(t, n) for t in texts]
        column = pa.array(texts, pa.large_string())
        raw, off = kernel.buffers(column)
        self.items: list[np.ndarray] = []
        few: dict[int, list[tuple[np.uint64, int]]] = defaultdict(list)
        for i, j in kernel.spans(off):
            w = kernel.words(raw, off, i, j, lower=True)
            at, h = kernel.runs(w, n)
            first = np.searchsorted(at, w.first)
            for r, count in enumerate(np.diff(w.first).tolist()):
                if 0 < count < n:
                    few[count].append((kernel.rolling(w.hash[w.first[r] : w.first[r + 1]], count)[0], len(self.items)))
                self.items.append(np.unique(h[first[r] : first[r + 1]]))
        self.few = {}
        for count, found in few.items():
            values = np.array([x for x, _ in found], np.uint64)
            by = np.argsort(values)
            self.few[count] = (values[by], np.array([i for _, i in found])[by], _marks(values))
        members: dict[int, list[int]] = defaultdict(list)
        for i, x in enumerate(self.items):
            if len(x):
                members[(len(x) - 1).bit_length()].append(i)
        self.least = min(members, default=0)
        self.classes: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for level, who in members.items():
            sig = np.array([[(self.items[i] * FACTOR[k] + OFFSET[k]).min() for k in range(hashes)] for i in who], np.uint64)
            bands = []
            for k in range(hashes):
                by = np.argsort(sig[:, k])
                bands.append((sig[by, k], np.array(who)[by], _marks(sig[:, k])))
            self.classes[level] = bands

    def candidates(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """(row, item) pairs that share a minimum in some window."""
        if not self.classes or not len(h):
            return []
        count = np.diff(first)
        rows = np.flatnonzero(count)
        size = 1 << self.least
        blocks = -(-count[rows] // size)
        owner = np.repeat(rows, blocks)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[owner] + nth * size
        # the blocks of each level, and where a window joins a block with the next of its row
        plan, own, number = [], owner, nth
        for level in range(self.least, max(self.classes) + 1):
            if level > self.least:
                starts = np.flatnonzero(number % 2 == 0)
                own, number = own[starts], number[starts] // 2
            else:
                starts = begin
            plan.append((starts, own, own[:-1] == own[1:]))
        found: list[np.ndarray] = []
        width = np.int64(len(self.items))
        for k in range(self.hashes):
            least = h * FACTOR[k] + OFFSET[k]
            for level, (starts, own, joined) in enumerate(plan, self.least):
                least = np.minimum.reduceat(least, starts)
                bands = self.classes.get(level)
                if bands is None:
                    continue
                window = least.copy()
                np.minimum(least[:-1], least[1:], out=window[:-1], where=joined)
                values, who, table = bands[k]
                hit = np.flatnonzero(_lookup(table, window))
                if not len(hit):
                    continue
                x = window[hit]
                lo, hi = np.searchsorted(values, x, "left"), np.searchsorted(values, x, "right")
                some = hi > lo
                for r, a, b in zip(own[hit[some]].tolist(), lo[some].tolist(), hi[some].tolist(), strict=True):
                    found.append(r * width + who[a:b])
        if not found:
            return []
        return [(int(x // width), int(x % width)) for x in np.unique(np.concatenate(found))]

    def matches(self, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(row, item, shared shingles) of the pairs at the threshold, for all rows of a column."""
        raw, off = kernel.buffers(texts)
        for i, j in kernel.spans(off):
            w = kernel.words(raw, off, i, j, lower=True)
            at, h = kernel.runs(w, self.n)
            first = np.searchsorted(at, w.first)
            near: dict[int, list[int]] = defaultdict(list)
            for r, item in self.candidates(h, first):
                own = h[first[r] : first[r + 1]]
                if np.isin(self.items[item], own).sum() >= threshold * len(self.items[item]):
                    near[r].append(item)
            for r, who in near.items():
                have = shingles(raw[off[i + r] : off[i + r + 1]].tobytes().decode(), self.n, False)
                for item in who:
                    shared = len(self.sets[item] & have)
                    if shared >= threshold * len(self.sets[item]):
                        yield i + r, item, shared
            for r, item in self.short_matches(w):
                yield i + r, item, 1

    def short_matches(self, w: kernel.Words) -> Iterator[tuple[int, int]]:
        """(row, item) of the items below the shingle length whose words the row has side by side."""
        for count, (values, who, table) in self.few.items():
            at, h = kernel.runs(w, count)
            hit = np.flatnonzero(_lookup(table, h))
            lo, hi = np.searchsorted(values, h[hit], "left"), np.searchsorted(values, h[hit], "right")
            seen: set[tuple[int, int]] = set()
            for p, a, b in zip(at[hit].tolist(), lo.tolist(), hi.tolist(), strict=True):
                for item in who[a:b].tolist():
                    pair = (int(w.row[p]), item)
                    if pair in seen:
                        continue
                    found = b" ".join(w.data[w.start[q] : w.end[q]].tobytes() for q in range(p, p + count))
                    if found in self.sets[item]:
                        seen.add(pair)
                        yield pair


def blocks_of(items: DataFrame, id_col: str, text_col: str, block: int, block_bytes: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded number and bytes; one block at a time is on the driver."""
    rows = items.select(F.col(id_col).alias("i"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where(F.length(F.trim("t")) > 0)
    now: list[tuple] = []
    size = 0
    for r in rows.toLocalIterator():
        n = len(r["t"].encode())
        if now and (len(now) >= block or size + n > block_bytes):
            yield now
            now, size = [], 0
        now.append((r["i"], r["t"]))
        size += n
    if now:
        yield now


_built: dict[tuple, Index] = {}


def _index(texts: list[str], n: int, hashes: int) -> Index:
    """One index for a worker: the last block stays."""
    key = (n, hashes, len(texts), hash(tuple(texts)))
    if key not in _built:
        _built.clear()
        _built[key] = Index(texts, n, hashes)
    return _built[key]


def containment_pairs(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    shingle: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(id, item_id, n_shared, n_item, containment)`` of all pairs at the threshold."""
    kinds = docs.schema[id_col].dataType, items.schema[item_id].dataType
    schema = f"d {kinds[0].simpleString()}, i {kinds[1].simpleString()}, n_shared long, n_item long"
    spark = docs.sparkSession

    def search(rows: list[tuple]) -> Callable:
        # the block as one broadcast value; workers build its index once
        sent = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _index([t for _, t in sent.value], shingle, hashes)
            for b in batches:
                hits = list(found.matches(b.column("t"), threshold))
                if hits:
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column("d").take(pa.array([r for r, _, _ in hits], pa.int64())),
                            pa.array([sent.value[i][0] for _, i, _ in hits], to_arrow(kinds[1])),
                            pa.array([n for _, _, n in hits], pa.int64()),
                            pa.array([len(found.sets[i]) for _, i, _ in hits], pa.int64()),
                        ],
                        names=["d", "i", "n_shared", "n_item"],
                    )

        return scan

    from pyspark.sql.pandas.types import to_arrow_type as to_arrow

    text = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    parts = [text.mapInArrow(search(rows), schema) for rows in blocks_of(items, item_id, item_text, block, block_bytes)]
    out = reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
    return out.select(F.col("d").alias(id_col), F.col("i").alias(item_id), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def contaminated_column(text: Column, items: DataFrame, item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD, hashes: int = HASHES, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> Column:
    """True where the text holds any item at the threshold; one pass over the text for each block."""
    spark = items.sparkSession

    def test(rows: list[tuple]) -> Column:
        sent = spark.sparkContext.broadcast(rows)

        def of(texts: pa.Array) -> pa.Array:
            hit = np.zeros(len(texts), bool)
            for r, _, _ in _index([t for _, t in sent.value], shingle, hashes).matches(texts, threshold):
                hit[r] = True
            return pa.array(hit)

        return F.arrow_udf(of, "boolean")(text)

    return reduce(lambda a, b: a | b, [test(rows) for rows in blocks_of(items, item_id, item_text, block, block_bytes)], F.lit(False))


def without_items(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that hold no item at the threshold, with the input's columns."""
    return docs.where(~contaminated_column(F.col(text_col), items))
