"""Exact removal of passages that occur more than once (Rabin-Karp windows).

A window is ``width`` consecutive words of one text. Every window gets a 64-bit Rabin-Karp hash;
a window whose word sequence starts at two or more places of the corpus is repeated, and repeated
windows merge into maximal intervals of words, which are removed.

Counting every window as a row of its own would shuffle several times the corpus. Each window is
therefore filed under the least hash of its ``gram``-word grams (its minimizer): equal windows have
equal minimizers, and about one window in fourteen starts a new one. Plain counts of minimizers
rule out windows that can't be repeated; the hashes of all others travel packed under their
minimizer and are counted there. A minimizer with very many occurrences is dealt out over salted
groups; what a salted group can't decide alone is counted across groups by window hash.

Defined results: a null or empty text has no words and loses none; a text shorter than the window
loses none; rows are judged independently, so a row that is wholly repeated loses all its words if it
has a window at all. Columns other than the id and the text are ignored. Equality is by 64-bit hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel

WIDTH, GRAM = 35, 6
#: Occurrences of one minimizer that are counted together.
TOGETHER = 512


def _sliding_min(g: np.ndarray, span: int) -> np.ndarray:
    step, out = 1, g
    while step * 2 <= span:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = span - step
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def _windows(w: kernel.Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word index, hash and minimizer of each window."""
    at, h = kernel.runs(w, width)
    if not len(at):
        return at, h, h
    least = _sliding_min(kernel.rolling(w.hash, gram, 0x9FB21C651E98DF25), width - gram + 1)
    return at, h, least[at]


def _runs(at: np.ndarray, row: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Indices at which a run of consecutive windows of one row with one minimizer begins."""
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (m[1:] != m[:-1]) | (row[1:] != row[:-1])
    return np.flatnonzero(begin)


def _occurrences(width: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = kernel.buffers(b.column("t"))
            k, h = (b.column(c).to_numpy(zero_copy_only=False) for c in ("k", "h"))
            for i, j in kernel.spans(off):
                w = kernel.words(raw, off, i, j)
                at, hashes, m = _windows(w, width, gram)
                if not len(at):
                    continue
                row = w.row[at]
                by = np.lexsort((hashes, row))
                same = (hashes[by][1:] == hashes[by][:-1]) & (row[by][1:] == row[by][:-1])
                again = np.zeros(j - i, dtype=bool)
                again[row[by][1:][same]] = True
                r = _runs(at, row, m)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(m[r].view(np.int64)),
                        pa.array(k[i + row[r]]),
                        pa.array(h[i + row[r]]),
                        pa.array((at[r] - w.first[row[r]]).astype(np.int32)),
                        pa.array(np.diff(np.append(r, len(at))).astype(np.int32)),
                        pa.array(again[row[r]]),
                    ],
                    names=["m", "k", "h", "start", "n", "again"],
                )

    return scan


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and digest of each whole text, and the text itself packed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for b in batches:
        raw, off = kernel.buffers(b.column("t"))
        n, sha, z = [], [], []
        for r in range(len(b)):
            text = raw[off[r] : off[r + 1]].tobytes()
            found = text.split()
            n.append(len(found))
            sha.append(hashlib.sha256(b" ".join(found)).hexdigest())
            z.append(pack.compress(text))
        yield pa.RecordBatch.from_arrays(
            [b.column("d"), b.column("k"), b.column("h"), pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(z, pa.binary())],
            names=["d", "k", "h", "n", "sha", "z"],
        )


def _packed(width: int, together: int):
    """Candidate runs of each text with the packed hashes of their windows."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            size = 0
            for d, k, h, z, runs in zip(*(b.column(c).to_pylist() for c in ("d", "k", "h", "z", "runs")), strict=True):
                text = np.frombuffer(unpack.decompress(z), np.uint8)
                w = kernel.words(text, np.array([0, len(text)]), 0, 1)
                _, hashes = kernel.runs(w, width)
                for x in runs:
                    blob = hashes[x["start"] : x["start"] + x["n"]].tobytes()
                    salt = (k ^ h ^ (x["start"] * 0x9E3779B1)) % max(1, -(-x["c"] // together))
                    for a, v in zip(out, (x["m"], salt, x["c"] > together, k, h, x["start"], blob), strict=True):
                        a.append(v)
                    size += len(blob)
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [[], [], [], [], [], [], []], 0
            if out[0]:
                yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(out, kinds, strict=True)], names=["m", "salt", "hot", "k", "h", "start", "blob"])

    return scan


def _intervals(at: np.ndarray) -> list[tuple[int, int]]:
    """Sorted window starts as (first, count) of consecutive ones."""
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return [(int(p[0]), len(p)) for p in np.split(at, cut) if len(p)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads runs sorted by (m, salt), many whole groups at a time, and marks windows seen twice.

    Rows out: intervals of repeated windows (w null); for salted groups also one row for each
    different window with its count (k null) and, for the undecided, where it starts.
    """

    def group(parts: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(parts)
        blob = t.column("blob").combine_chunks()
        size = np.diff(np.frombuffer(blob.buffers()[1], np.int32)[blob.offset : blob.offset + len(blob) + 1].astype(np.int64)) // 8
        m, salt, k, h, start = (t.column(c).to_numpy() for c in ("m", "salt", "k", "h", "start"))
        hot = t.column("hot").to_numpy(zero_copy_only=False)
        ws = np.frombuffer(b"".join(blob.to_pylist()), np.uint64)
        owner = np.repeat(np.arange(len(size)), size)
        pos = np.arange(len(ws)) - np.repeat(np.cumsum(size) - size, size) + start[owner]
        key = ws ^ kernel.mix(salt.view(np.uint64))[owner]
        _, back, n = np.unique(key, return_inverse=True, return_counts=True)
        seen = n[back]
        rows: list[list] = [[], [], [], [], [], []]

        def put(*v) -> None:
            for a, x in zip(rows, v, strict=True):
                a.append(x)

        twice = seen > 1
        if twice.any():
            o, p = owner[twice], pos[twice]
            begin = np.ones(len(o), bool)
            begin[1:] = (o[1:] != o[:-1]) | (p[1:] != p[:-1] + 1)
            at = np.flatnonzero(begin)
            rows[0] += k[o[at]].tolist()
            rows[1] += h[o[at]].tolist()
            rows[2] += p[at].tolist()
            rows[3] += np.diff(np.append(at, len(o))).tolist()
            rows[4] += [None] * len(at)
            rows[5] += [None] * len(at)
        warm = hot[owner]
        if warm.any():
            first = np.zeros(len(ws), bool)
            first[np.unique(key, return_index=True)[1]] = True
            for i in np.flatnonzero(warm & first):
                put(None, None, None, None, int(ws[i].view(np.int64)), int(seen[i]))
            for i in np.flatnonzero(warm & ~twice):
                put(int(k[owner[i]]), int(h[owner[i]]), int(pos[i]), 1, int(ws[i].view(np.int64)), None)
        if not rows[0]:
            return None
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(rows, kinds, strict=True)], names=["k", "h", "start", "n", "w", "c"])

    parts: list[pa.RecordBatch] = []
    waiting = 0
    for b in batches:
        if not len(b):
            continue
        parts.append(b)
        waiting += b.nbytes
        if waiting < 8 << 20:
            continue
        m, salt = (b.column(c).to_numpy() for c in ("m", "salt"))
        change = np.flatnonzero((m[1:] != m[:-1]) | (salt[1:] != salt[:-1]))
        if not len(change):
            continue
        cut = int(change[-1]) + 1
        parts[-1] = b.slice(0, cut)
        if (out := group(parts)) is not None:
            yield out
        parts = [b.slice(cut)]
        waiting = parts[0].nbytes * (len(b) - cut) // max(1, len(b))
    if parts and (out := group(parts)) is not None:
        yield out


def _remove(width: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            removed, shas, spans = [], [], []
            for n, sha, z, copied, runs in zip(*(b.column(c).to_pylist() for c in ("n", "sha", "z", "copied", "marks")), strict=True):
                if copied and n >= width:
                    removed.append(n)
                    shas.append(hashlib.sha256(b"").hexdigest())
                    spans.append([{"start": 0, "end": n}])
                    continue
                if not runs:
                    removed.append(0)
                    shas.append(sha)
                    spans.append([])
                    continue
                edge = np.zeros(n + 1, np.int64)
                for x in runs:
                    edge[x["start"]] += 1
                    edge[x["start"] + x["n"] + width - 1] -= 1
                gone = np.cumsum(edge[:n]) > 0
                found = unpack.decompress(z).split()
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(b" ".join([x for x, g in zip(found, gone.tolist(), strict=True) if not g])).hexdigest())
                spans.append([{"start": s, "end": s + c} for s, c in _intervals(np.flatnonzero(gone))])
            yield pa.RecordBatch.from_arrays(
                [b.column("d"), b.column("n"), pa.array(removed, pa.int64()), pa.array(shas, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["d", "n", "removed", "sha", "spans"],
            )

    return scan


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, together: int = TOGETHER) -> DataFrame:
    """``(id, n_words, n_removed, kept_sha256, removed)``; removed: word intervals [start, end)."""
    id_type = docs.schema[id_col].dataType
    base = docs.select(
        F.col(id_col).alias("d"),
        F.xxhash64(F.col(id_col)).alias("k"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"),
        F.col(text_col).alias("t"),
    )
    text = base.select("k", "h", "t")
    occ = text.mapInArrow(_occurrences(width, gram), "m long, k long, h long, start int, n int, again boolean")
    often = (
        occ.groupBy("m")
        .agg(F.count("*").alias("c"), F.min("h").alias("a"), F.max("h").alias("z"), F.max("again").alias("again"))
        .where("a != z OR again")
        .select("m", "c")
    )
    copies = base.groupBy("h").agg(F.count("*").alias("copies"), F.min("k").alias("rep")).where("copies > 1")
    near = occ.join(often, "m").groupBy("k", "h").agg(F.collect_set(F.struct("start", "n", "m", "c")).alias("runs"))
    near = near.join(copies, "h", "left").where("copies IS NULL OR k = rep").select("k", "h", "runs")
    packed = base.mapInArrow(_digests, _schema(id_type, "k long, h long, n long, sha string, z binary"))
    wide = (
        packed.join(near.hint("shuffle_merge"), ["k", "h"])
        .select("d", "k", "h", "z", "runs")
        .mapInArrow(_packed(width, together), "m long, salt long, hot boolean, k long, h long, start int, blob binary")
    )
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marks = wide.repartition(parts, "m", "salt").sortWithinPartitions("m", "salt").mapInArrow(_count, "k long, h long, start int, n int, w long, c long")
    done = marks.where("w IS NULL")
    across = marks.where("w IS NOT NULL AND k IS NULL").groupBy("w").agg(F.sum("c").alias("total")).where("total > 1")
    late = marks.where("w IS NOT NULL AND k IS NOT NULL").join(across, "w")
    found = done.select("k", "h", "start", "n").unionByName(late.select("k", "h", "start", "n"))
    found = found.groupBy("k", "h").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    twin = base.select("k", "h").join(copies, "h").select("k", "h").distinct().withColumn("copied", F.lit(True))
    side = found.join(twin, ["k", "h"], "full")
    out = packed.join(side.hint("shuffle_merge"), ["k", "h"], "left").select("d", "n", "sha", "z", "copied", "marks")
    out = out.mapInArrow(_remove(width), _schema(id_type, "n long, removed long, sha string, spans array<struct<start:long,end:long>>"))
    return out.select(
        F.col("d").alias(id_col), F.col("n").alias("n_words"), F.col("removed").alias("n_removed"), F.col("sha").alias("kept_sha256"), F.col("spans").alias("removed")
    )


def _schema(id_type, rest: str) -> str:
    return f"d {id_type.simpleString()}, {rest}"
