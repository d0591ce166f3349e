"""Near-duplicate groups by SimHash with a bit-sliced comparison.

A text is lower-cased (A-Z), cut into words and ``shingle``-word shingles (repeats included; fewer
words: the whole sequence; none: fingerprint zero). A fingerprint bit is 1 if it is set in more than
half of the shingles' XXH64 values (seed 42). Fingerprints link at ``radius`` or fewer differing
bits, and linked fingerprints form components.

Links are found among distinct fingerprints only, so copies cost one row. 64 bits are cut into
``blocks`` parts; two fingerprints within the radius agree on at least ``blocks - radius`` of them,
so every choice of that many parts gives a bucket key. Within a bucket, fingerprints are held as bit
planes, 64 to a word, and a query is compared with a whole word at once: a carry-save counter of two
bit planes counts differing bits of all 64 lanes, a third keeps the lanes beyond the radius, and a
word is abandoned once all its lanes are beyond. A bucket returns a spanning star of each local
component, never its pairs. Buckets over ``tile`` fingerprints are cut into tiles and every pair of
tiles becomes a group of its own, so a task holds two tiles at most.

Defined results: a null text counts as empty; rows without id get the component of their
fingerprint, whose id is null only if no member has one; equal rows each come out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.cluster import fresh, held
from tidemill.llm.components import components

SHINGLE, RADIUS, BLOCKS, TILE = 3, 2, 4, 4096


def _bits(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each group of hashes (bounds in first, none empty) the number of hashes with each bit, from the high bit."""
    planes = np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(planes, first, axis=0, dtype=np.int32)


def fingerprints(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    raw, off = kernel.buffers(texts)
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, j in kernel.spans(off, 1 << 18):
        w = kernel.words(raw, off, i, j, lower=True, hashes=False)
        count = np.diff(w.first)
        data = w.data.tobytes()
        found = [data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist(), strict=True)]
        norm = b" ".join(found)
        size = w.end - w.start
        begin = np.cumsum(size + 1) - (size + 1)
        end = begin + size
        rows = np.flatnonzero(count)
        n = np.maximum(1, count[rows] - shingle + 1)
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first - w.first[rows], n)
        last = np.minimum(at + shingle, np.repeat(w.first[rows + 1], n)) - 1
        h = np.fromiter((digest(norm[a:b], 42) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at))
        # long runs of shingles are counted in pieces, so that the planes stay small
        sums = np.zeros((len(rows), 64), np.int64)
        step = 1 << 16
        for p in range(0, len(h), step):
            q = min(len(h), p + step)
            lo = int(np.searchsorted(first, p, side="right")) - 1
            hi = int(np.searchsorted(first, q, side="left"))
            cuts = np.maximum(first[lo:hi], p) - p
            sums[lo:hi] += _bits(h[p:q], cuts)
        set_bits = sums * 2 > n[:, None]
        if len(rows):
            out[i + rows] = np.packbits(set_bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long, computed over Arrow batches."""

    def of(texts: pa.Array) -> pa.Array:
        return pa.array(fingerprints(texts, shingle).view(np.int64))

    return F.arrow_udf(of, "long")(text)


def bit_sliced_pairs(fp: np.ndarray, group: np.ndarray, radius: int, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one group (rows sorted by group) within the radius, a chunk of work at a time."""
    n = len(fp)
    words = -(-n // 64)
    lanes = np.zeros(words * 64, np.uint64)
    lanes[:n] = fp
    # plane b, word w: bit l is bit b of lane 64 w + l
    planes = np.empty((64, words), np.uint64)
    for b in range(64):
        on = ((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8)
        planes[b] = np.packbits(on.reshape(words, 64), axis=1, bitorder="little").view("<u8").ravel()
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(start, n))
    end_of = np.repeat(start + size, size)
    here = np.arange(n)
    todo = (end_of - 1) // 64 - (here + 1) // 64 + 1
    todo[here + 1 >= end_of] = 0
    full = ~np.uint64(0)
    upto = np.cumsum(todo)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + chunk, side="right")))
        own = todo[i:j]
        q = np.repeat(here[i:j], own)
        if len(q):
            w = np.arange(len(q)) - np.repeat(np.cumsum(own) - own, own) + (q + 1) // 64
            lo = np.maximum(q + 1 - w * 64, 0).astype(np.uint64)
            hi = np.minimum(end_of[q] - w * 64, 64).astype(np.uint64)
            valid = (full << lo) & (full >> (np.uint64(64) - hi))
            beyond = ~valid
            count = [np.zeros(len(q), np.uint64) for _ in range(max(1, int(radius + 1).bit_length()))]
            mine = fp[q]
            for b in range(64):
                flip = np.where((mine >> np.uint64(b)) & np.uint64(1), full, np.uint64(0))
                carry = planes[b][w] ^ flip
                for s in range(len(count)):
                    count[s], carry = count[s] ^ carry, count[s] & carry
                at = full
                for s in range(len(count)):
                    at = at & (count[s] if (radius + 1) >> s & 1 else ~count[s])
                beyond |= at | carry
                if b % 8 == 7:
                    live = beyond != full
                    if not live.all():
                        q, w, mine, beyond = q[live], w[live], mine[live], beyond[live]
                        count = [c[live] for c in count]
                        if not len(q):
                            break
            if len(q):
                hit = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                a, lane = np.nonzero(hit)
                yield q[a], w[a] * 64 + lane
        i = j


def _union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merges the trees of label (parents at or below each node) along the pairs."""
    while len(a):
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up
        ra, rb = label[a], label[b]
        keep = ra != rb
        if not keep.any():
            return
        a, b, ra, rb = a[keep], b[keep], ra[keep], rb[keep]
        np.minimum.at(label, np.maximum(ra, rb), np.minimum(ra, rb))


def local_stars(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    label = np.arange(len(fp))
    for a, b in bit_sliced_pairs(fp, group, radius):
        _union(label, a, b)
    while True:
        up = label[label]
        if (up == label).all():
            break
        label = up
    tied = np.flatnonzero(label != np.arange(len(fp)))
    return fp[tied], fp[label[tied]]


def _compare(radius: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            key = np.concatenate([k for k, _ in parts])
            fp = np.concatenate([f for _, f in parts])
            u, v = local_stars(fp, key, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for b in batches:
            if not len(b):
                continue
            key = np.zeros(len(b), np.uint64)
            for c in ("t", "key", "a", "b"):
                key = kernel.mix(key + b.column(c).to_numpy().astype(np.int64).view(np.uint64) + kernel.BASE)
            fp = b.column("fp").to_numpy().view(np.uint64)
            if held > 1 << 15:
                same = key == parts[-1][0][-1]
                cut = len(key) if same.all() else int(np.argmin(same))
                parts.append((key[:cut], fp[:cut]))
                key, fp = key[cut:], fp[cut:]
                if not len(key):
                    continue
                yield run(parts)
                parts, held = [], 0
            parts.append((key, fp))
            held += len(key)
        if parts:
            yield run(parts)

    return scan


def links(prints: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints (column fp) that span all links within the radius."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("radius must be below the number of blocks")
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    tables = []
    for chosen in combinations(range(blocks), blocks - radius):
        mask = sum(((1 << (bounds[i + 1] - bounds[i])) - 1) << bounds[i] for i in chosen)
        tables.append(mask - (1 << 64) if mask >> 63 else mask)
    entry = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in tables])).alias("t", "key")
    rows = prints.select("fp", entry)
    many = rows.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    near = rows.join(many, ["t", "key"]).withColumn("tiles", F.ceil(F.col("c") / tile).cast("int"))
    mine = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("fp"), F.col("tiles"))).otherwise(F.lit(0)).cast("int")
    near = near.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    near = near.select("t", "key", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "fp")
    parts = max(1, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["t", "key", "a", "b"]
    return near.repartition(parts, *order).sortWithinPartitions(*order, "fp").mapInArrow(_compare(radius), "u long, v long")


def near_groups(prints: DataFrame, id_col: str, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """``(fp, component_id)`` for each distinct fingerprint of rows ``(id, fp)``; the least id of its component."""
    least = prints.groupBy("fp").agg(F.min(id_col).alias("least"))
    tied = components(links(least.select("fp"), radius, blocks, tile)).withColumnRenamed("node", "fp")
    both = least.join(tied, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    whole = both.groupBy("component").agg(F.min("least").alias("component_id"))
    return both.join(whole, "component").select("fp", "component_id")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(id, fingerprint, component_id)`` for every row."""
    prints = docs.select(F.col(id_col), fingerprint_column(F.col(text_col), shingle).alias("fp"))
    prints = held(prints)
    groups = near_groups(prints, id_col, radius)
    out = prints.join(groups, "fp", "left")
    return out.select(id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with all its columns: the least id (nulls last), then the least text hash.

    Of rows that agree in id and text one stays. They are merged before the join, partly on the map
    side, so that a text with very many copies does not gather in one task.
    """
    k, h = fresh(docs, "k", "h")
    keys = [F.xxhash64(F.col(id_col)).alias(k), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(h)]
    light = held(docs.select(F.col(id_col).alias("id"), *keys, fingerprint_column(F.col(text_col), shingle).alias("fp")))
    first = light.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", h, k)).alias("first"))
    tied = components(links(first.select("fp"), radius)).withColumnRenamed("node", "fp")
    whole = first.join(tied, "fp", "left").groupBy(F.coalesce("component", "fp").alias("c")).agg(F.min("first").alias("first"))
    stay = whole.select(F.col(f"first.{k}").alias(k), F.col(f"first.{h}").alias(h))
    rows = docs.select(*docs.columns, *keys).dropDuplicates([k, h])
    return rows.join(stay, [k, h], "left_semi").select(*docs.columns)
