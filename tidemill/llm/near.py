"""One document of each group of near copies: SimHash with a bit-sliced comparison, checked exactly.

A text is lower-cased (A-Z), cut into words, and stands for the set of its ``shingle``-word runs by
64-bit hash (fewer words: the whole sequence; none: the empty set). Two texts link at a Jaccard
similarity of ``NUM / DEN`` or more, and linked texts form components.

Every set gets a 64-bit SimHash. At this similarity fingerprints differ in about 10 bits, too many for
the block keys of ``simhash.links``, so buckets come from the shingles themselves: two sets of that
similarity have a shingle in common among the first ``n - ceil(share n) + 1`` of each, in any order that is
the same for all sets. Shingles that are frequent in a sample of the texts come last in that order, rarer
ones first, which bounds the work and never the result. Within a bucket the fingerprints are compared as
bit planes by carry-save counters (``simhash.bit_sliced_pairs``) at ``RADIUS`` bits; pairs beyond it, or
whose sizes and places rule the similarity out, are dropped. The radius is wide: a pair at the least
similarity lies beyond it with a probability below one in 100,000, others far less. All that is left is
checked on the whole sets.

Equal texts (by 64-bit hash) are one node. A bucket never gives its pairs: each node is tied to the centre of its local
group (the member nearest to all others) and to its own nearest member, so that a group of near copies
costs two rows for each copy. Only groups in which a tie to the centre failed the check are compared again,
and then all pairs of nodes within the radius that are not joined yet are checked. A bucket that the sample
shows to be large is cut into tiles of ``TILE`` and every pair of tiles is a group of its own. Texts move
only if they may be tied or copied: a bitmap of ``cluster.BITS`` bits, whatever the number of documents, rules the
others out before each join.

Defined results: a null text counts as empty, all empty texts are copies of each other; a row without
id stays only if no other of its component has one; of rows that agree in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel, simhash
from tidemill.llm.cluster import bitmap, fresh, held, maybe_in
from tidemill.llm.components import components

#: The least similarity is NUM / DEN.
SHINGLE, NUM, DEN, RADIUS, TILE = 5, 4, 5, 26, 4096
#: One text in SAMPLE is sampled for frequent shingles; of those in OFTEN sampled texts the first MOST count.
SAMPLE, OFTEN, MOST = 32, 3, 100000
#: Rows that are compared together, at least, whole buckets each.
TOGETHER = 1 << 15
ROW = "key long, sig long, fp long, n int, i int"


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """For each text the sorted set of its shingles' hashes."""
    raw, off = kernel.buffers(texts)
    for i, j in kernel.spans(off):
        w = kernel.words(raw, off, i, j, lower=True)
        at, h = kernel.runs(w, shingle)
        cut = np.searchsorted(at, w.first)
        for r in range(j - i):
            a, b = int(w.first[r]), int(w.first[r + 1])
            if b - a >= shingle:
                yield np.unique(h[cut[r] : cut[r + 1]])
            elif b > a:
                yield np.array([xxhash.xxh64_intdigest(w.hash[a:b].tobytes(), b - a)], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if len(b):
            s = np.concatenate(list(shingle_sets(b.column("text"))))
            yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["s"])


class Frequent:
    """The shingles that come last (sorted), with their number of sampled texts."""

    def __init__(self, found: list[tuple[int, int]]) -> None:
        s = np.array([x for x, _ in found], np.int64).view(np.uint64)
        by = np.argsort(s)
        self.s, self.c = s[by], np.array([c for _, c in found], np.int64)[by]

    def counts(self, s: np.ndarray) -> np.ndarray:
        """The sampled texts that have each shingle, 0 where it isn't frequent."""
        if not len(self.s):
            return np.zeros(len(s), np.int64)
        at = np.minimum(np.searchsorted(self.s, s), len(self.s) - 1)
        return np.where(self.s[at] == s, self.c[at], 0)


def _print(s: np.ndarray) -> int:
    """The SimHash of a set: bits that more than half of the hashes have."""
    if not len(s):
        return 0
    sums = np.zeros((1, 64), np.int64)
    for p in range(0, len(s), 1 << 16):
        sums += simhash._bits(s[p : p + (1 << 16)], np.zeros(1, np.int64))
    return int(np.packbits(sums * 2 > len(s), axis=1).view(">u8")[0, 0])


def _entry_rows(frequent: Frequent, tile: int, sig: np.ndarray, sets: list[np.ndarray], c: np.ndarray | None = None) -> pa.RecordBatch:
    """A row for each node and leading shingle; in large buckets for each pair of tiles that has the node."""
    size = np.array([len(x) for x in sets], np.int64)
    fp = np.array([_print(x) for x in sets], np.uint64)
    leading = []
    for x in sets:
        by = np.argsort(frequent.counts(x), kind="stable")
        # all empty sets meet in one bucket
        leading.append(x[by[: len(x) - -(-NUM * len(x) // DEN) + 1]] if len(x) else np.zeros(1, np.uint64))
    count = np.array([len(x) for x in leading], np.int64)
    owner = np.repeat(np.arange(len(sets)), count)
    i = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    s = np.concatenate(leading)
    tiles = np.maximum(1, -(-SAMPLE * frequent.counts(s) // tile))
    at = np.repeat(np.arange(len(s)), tiles)
    other = np.arange(len(at)) - np.repeat(np.cumsum(tiles) - tiles, tiles)
    mine = (kernel.mix(sig[owner[at]]) % tiles[at].astype(np.uint64)).astype(np.int64)
    pair = np.minimum(mine, other) * tiles[at] + np.maximum(mine, other)
    key = kernel.mix(s[at] + pair.astype(np.uint64) * kernel.BASE)
    who = owner[at]
    columns = {"key": key.view(np.int64), "sig": sig[who].view(np.int64), "fp": fp[who].view(np.int64), "n": size[who].astype(np.int32), "i": i[at].astype(np.int32)}
    return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in (columns | ({} if c is None else {"c": c[who]})).items()})


def _entries(frequent: Frequent, tile: int) -> Callable:
    """Entries of the different texts of a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            new = []
            for r, h in enumerate(b.column("h").to_pylist()):
                if h not in seen:
                    # a bound on memory: a text met again later is only sent again
                    if len(seen) > 1 << 20:
                        seen.clear()
                    seen.add(h)
                    new.append(r)
            b = b.take(pa.array(new, pa.int64()))
            sig = b.column("h").to_numpy().view(np.uint64)
            for at, part in kernel.parts(b.column("text")):
                yield _entry_rows(frequent, tile, sig[at : at + len(part)], list(shingle_sets(part)))

    return of


def _entries_again(frequent: Frequent, tile: int) -> Callable:
    """Entries of nodes whose sets are known."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                yield _entry_rows(frequent, tile, b.column("sig").to_numpy().view(np.uint64), [np.frombuffer(x.as_buffer(), np.uint64) for x in b.column("set")], b.column("c").to_numpy())

    return of


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Columns of rows sorted by key, many whole buckets at a time, without buckets of one row."""

    def ready(parts: list[pa.RecordBatch]) -> dict[str, np.ndarray] | None:
        t = pa.Table.from_batches(parts)
        key, sig = t.column("key").to_numpy(), t.column("sig").to_numpy()
        # tasks send the same text each
        by = np.lexsort((sig, key))
        by = by[np.append(True, (key[by][1:] != key[by][:-1]) | (sig[by][1:] != sig[by][:-1]))]
        key = key[by]
        twin = np.zeros(len(key), bool)
        twin[1:] = key[1:] == key[:-1]
        twin[:-1] |= twin[1:].copy()
        return {c: t.column(c).to_numpy()[by[twin]] for c in t.column_names} if twin.any() else None

    parts: list[pa.RecordBatch] = []
    waiting = 0
    for b in batches:
        if not len(b):
            continue
        if waiting > TOGETHER:
            same = b.column("key").to_numpy() == parts[-1].column("key")[-1].as_py()
            cut = len(b) if same.all() else int(np.argmin(same))
            parts.append(b.slice(0, cut))
            if cut == len(b):
                continue
            if (out := ready(parts)) is not None:
                yield out
            b, parts, waiting = b.slice(cut), [], 0
        parts.append(b)
        waiting += len(b)
    if parts and (out := ready(parts)) is not None:
        yield out


def _near(t: dict[str, np.ndarray], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one bucket within the radius that can have the similarity if their first common shingle is this one."""
    n, i, sig = t["n"].astype(np.int64), t["i"].astype(np.int64), t["sig"]
    for a, b in simhash.bit_sliced_pairs(t["fp"].view(np.uint64), t["key"], radius):
        fits = (np.minimum(n[a] - i[a], n[b] - i[b]) * (NUM + DEN) >= NUM * (n[a] + n[b])) & (sig[a] != sig[b])
        yield a[fits], b[fits]


def _ties(radius: int) -> Callable:
    """Rows (u, v, centre): every node of a local group with its centre, and with its nearest member."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            fp, sig = t["fp"].view(np.uint64), t["sig"]
            n = len(fp)
            label, weight = np.arange(n), np.zeros(n)
            best = np.full(n, np.iinfo(np.int64).max)
            for a, b in _near(t, radius):
                if not len(a):
                    continue
                far = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int64)
                close = (radius + 1 - far).astype(np.float64)
                weight += np.bincount(a, close, n) + np.bincount(b, close, n)
                np.minimum.at(best, a, far * n + b)
                np.minimum.at(best, b, far * n + a)
                simhash._union(label, a, b)
            while not ((up := label[label]) == label).all():
                label = up
            tied = np.flatnonzero(weight > 0)
            if not len(tied):
                continue
            # the centre of each group: the greatest weight, then the least signature
            by = tied[np.lexsort((sig[tied], -weight[tied], label[tied]))]
            lead = by[np.append(True, label[by][1:] != label[by][:-1])]
            centre = np.zeros(n, np.int64)
            centre[label[lead]] = lead
            to = centre[label[tied]]
            u = np.concatenate([tied, tied])
            v = np.concatenate([to, best[tied] % n])
            star = np.append(np.ones(len(tied), bool), np.zeros(len(tied), bool))
            keep = sig[u] != sig[v]
            seen = pa.table({"u": sig[u][keep], "v": sig[v][keep], "star": star[keep]}).group_by(["u", "v", "star"]).aggregate([])
            yield from seen.select(["u", "v", "star"]).to_batches()

    return of


def _open_pairs(radius: int) -> Callable:
    """Rows (u, v): pairs of nodes of different components (column c) within the radius."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_buckets(batches):
            for a, b in _near(t, radius):
                apart = t["c"][a] != t["c"][b]
                u, v = t["sig"][a[apart]], t["sig"][b[apart]]
                seen = pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)}).group_by(["u", "v"]).aggregate([])
                yield from seen.select(["u", "v"]).to_batches()

    return of


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array([s.tobytes() for s in shingle_sets(b.column("text"))], pa.binary())], names=["sig", "set"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (u, v) whose sets x and y have the similarity."""
    for b in batches:
        keep = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(DEN * both >= NUM * (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v")], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    x, y = sets.select(F.col("sig").alias("u"), F.col("set").alias("x")), sets.select(F.col("sig").alias("v"), F.col("set").alias("y"))
    return pairs.join(x, "u").join(y, "v").select("u", "v", "x", "y").mapInArrow(_similar, "u long, v long")


def _dealt(entries: DataFrame) -> DataFrame:
    parts = max(1, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return entries.repartition(parts, "key").sortWithinPartitions("key")


def similar_components(docs: DataFrame, frequent: Frequent, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``(node, component)`` of linked nodes. docs: rows (h, text); a node is a text's hash h."""
    spark = docs.sparkSession
    entries = _dealt(docs.select("h", "text").mapInArrow(_entries(frequent, tile), ROW))
    ties = entries.mapInArrow(_ties(radius), "u long, v long, star boolean")
    ties = held(ties.groupBy("u", "v").agg(F.max("star").alias("star")))
    ends = held(ties.select(F.explode(F.array("u", "v")).alias("sig")).distinct())
    texts = docs.where(maybe_in(spark, bitmap(ends, "sig"))(F.col("h"))).select(F.col("h").alias("sig"), "text").dropDuplicates(["sig"])
    sets = held(texts.join(ends, "sig", "left_semi").mapInArrow(_sets, "sig long, set binary"))
    pairs = ties.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = held(_checked(pairs, sets))
    joined = components(first).withColumnRenamed("node", "sig")
    # groups of a centre to which some node is not joined
    part = ends.join(joined, "sig", "left").select("sig", F.coalesce("component", "sig").alias("c"))
    sides = ties.where("star").select("u", "v").join(part.select(F.col("sig").alias("u"), F.col("c").alias("cu")), "u").join(part.select(F.col("sig").alias("v"), F.col("c").alias("cv")), "v")
    apart = held(sides.where("cu != cv").select("v").distinct())
    if apart.isEmpty():
        return joined.withColumnRenamed("sig", "node")
    again = ties.where("star").join(apart, "v", "left_semi").select(F.explode(F.array("u", "v")).alias("sig")).distinct()
    left = sets.join(again.join(part, "sig"), "sig").select("sig", "set", "c")
    rest = _dealt(left.mapInArrow(_entries_again(frequent, tile), ROW + ", c long")).mapInArrow(_open_pairs(radius), "u long, v long").distinct()
    return components(first.unionByName(_checked(rest, sets)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """One row of each component, with all its columns: the least id (nulls last), then the least text hash."""
    spark = docs.sparkSession
    k, h = fresh(docs, "k", "h")
    keys = [F.xxhash64(F.col(id_col)).alias(k), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias(h)]
    plain = docs.select(keys[1].alias("h"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = plain.where(F.pmod("h", F.lit(SAMPLE)) == 0).select("text").mapInArrow(_sampled, "s long")
    often = sample.groupBy("s").agg(F.count("*").alias("c")).where(F.col("c") >= OFTEN).orderBy(F.desc("c"), "s").limit(MOST)
    frequent = Frequent([(r["s"], r["c"]) for r in often.collect()])
    light = docs.select(F.col(id_col).alias("id"), keys[0].alias("k"), keys[1].alias("h"))
    best = light.groupBy("h").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "k")).alias("best"), F.count("*").alias("n"))
    tied = held(similar_components(plain, frequent, radius, tile).withColumnRenamed("node", "h"))
    nodes = held(best.join(tied, "h", "left").where("n > 1 OR component IS NOT NULL"))
    stay = nodes.groupBy(F.coalesce("component", "h").alias("c")).agg(F.min("best").alias("best")).select(F.col("best.k").alias(k), F.col("best.h").alias(h))
    rows = docs.select(*docs.columns, *keys)
    unsure = maybe_in(spark, bitmap(nodes, "h"))(F.col(h))
    alone = rows.where(~unsure).select(*docs.columns)
    some = rows.where(unsure).dropDuplicates([k, h])
    # of the rows that only look like one of a group nothing goes
    whole = nodes.select(F.col("h").alias(h)).distinct()
    kept = some.join(stay, [k, h], "left_semi").unionByName(some.join(whole, h, "left_anti"))
    return alone.unionByName(kept.select(*docs.columns))
