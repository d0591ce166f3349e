"""Language identification with bit-sliced Bloom filters over character n-grams.

The filter is one table of rows; each row is a bit mask with a bit for each language. An n-gram sets
its language bits in ``HASHES`` rows, and the AND of these rows returns, in one lookup, all languages
that may contain it. For a text, the n-grams of each language are counted (a popcount down each bit
column) and corrected for the filter's false positives: with fill rate f of a language's bits, a
foreign n-gram passes with probability p = f^HASHES, so of n n-grams with c passes (c - p n) / (1 - p)
are estimated to be its own. The largest estimate decides; its share of all estimates is the score.

Texts are lower-cased, runs of characters that aren't letters become one space, and n-grams are the
``GRAM`` UTF-8 bytes at every position, spaces included. A language holds an n-gram if, per n-gram of
its training texts, it has it at least ``RATIO`` times as often as any language and at least
``LEAST`` times; the ``GRAMS`` most frequent are kept.

The filters are fitted on at most ``SAMPLE`` labelled texts of each language, chosen by hash (a
documented bound); every text is then predicted. Defined results: null texts and texts without a
letter are ``und`` with score 0; where no estimate is positive, ties included, the first language in
alphabetical order wins; without labelled texts everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.cluster import fresh

GRAM, HASHES, ROWS = 5, 3, 1 << 20
SAMPLE, GRAMS, LEAST, RATIO = 2000, 1 << 16, 3, 0.2


def letters(texts: pa.Array) -> pa.Array:
    """Lower-cased words of letters, each between single spaces; empty where there is no letter."""
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    low = pc.replace_substring_regex(low, r"[^\p{L}\p{M}]+", " ")
    low = pc.if_else(pc.match_substring_regex(low, r"\p{L}"), pc.utf8_trim(low, " "), "")
    space, nothing = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.if_else(pc.equal(low, ""), low, pc.binary_join_element_wise(space, low, space, nothing))


def grams(texts: pa.Array, size: int = GRAM) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For row slices i..j of texts: n-gram hashes, and where each row's begin (j-i+1 bounds)."""
    for at, part in kernel.parts(texts):
        for i, j, h, first in _grams(letters(part), size):
            yield at + i, at + j, h, first


def _grams(clean: pa.Array, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    raw, off = kernel.buffers(clean)
    for i, j in kernel.spans(off):
        data = raw[off[i] : off[j]]
        cut = off[i : j + 1] - off[i]
        n = np.maximum(np.diff(cut) - size + 1, 0)
        short = (n == 0) & (np.diff(cut) > 0)
        code = np.zeros(len(data), np.uint64)
        for s in range(size):
            part = np.zeros(len(data), np.uint64)
            part[: len(data) - s] = data[s:]
            code |= part << np.uint64(8 * s)
        first = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(int(n.sum())) + np.repeat(cut[:-1] - first[:-1], n)
        h = kernel.mix(code[at] + np.uint64(1))
        if short.any():  # a text below the size is one n-gram of what it has
            n = n + short
            whole = [kernel.mix(np.array([int.from_bytes(data[a:b].tobytes(), "little") + 1], np.uint64))[0] for a, b in zip(cut[:-1][short], cut[1:][short], strict=True)]
            new = np.concatenate([[0], np.cumsum(n)])
            out = np.zeros(int(new[-1]), np.uint64)
            keep = np.ones(len(out), bool)
            keep[new[:-1][short]] = False
            out[keep] = h
            out[new[:-1][short]] = whole
            h, first = out, new
        yield i, j, h, first


def _slots(h: np.ndarray) -> list[np.ndarray]:
    step = (h >> np.uint64(40)) | np.uint64(1)
    return [((h + np.uint64(k) * step) & np.uint64(ROWS - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """The bit-sliced filters of all languages."""

    def __init__(self, known: dict[str, np.ndarray]) -> None:
        self.langs = sorted(known)
        self.table = np.zeros((ROWS, -(-max(1, len(self.langs)) // 64)), np.uint64)
        for i, lang in enumerate(self.langs):
            bit = np.uint64(1 << (i % 64))
            for slot in _slots(known[lang]):
                self.table[slot, i // 64] |= bit
        fill = [float(((self.table[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(self.langs))]
        self.passes = np.array([f**HASHES for f in fill])

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        best, score = ["und"] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return best, score
        for i, _, h, first in grams(texts):
            n = np.diff(first)
            rows = np.flatnonzero(n)
            if not len(rows):
                continue
            slots = _slots(h)
            mask = self.table[slots[0]]
            for s in slots[1:]:
                mask = mask & self.table[s]
            counts = np.empty((len(rows), len(self.langs)))
            for k in range(len(self.langs)):
                bits = (mask[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)
                counts[:, k] = np.add.reduceat(bits, first[rows])
            own = np.maximum((counts - n[rows, None] * self.passes) / (1 - np.minimum(self.passes, 0.999)), 0)
            top = own.argmax(axis=1)
            total = own.sum(axis=1)
            for r, t, share in zip(rows.tolist(), top.tolist(), np.where(total > 0, own[np.arange(len(rows)), top] / np.maximum(total, 1e-12), 0).tolist(), strict=True):
                best[i + r] = self.langs[t]
                score[i + r] = share
        return best, score


def fit(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id", sample: int = SAMPLE) -> Filters:
    """Filters from a bounded sample of the rows where train holds and the language is known."""
    light = docs.where(train & F.col(lang_col).isNotNull())
    chance = F.pmod(F.xxhash64(F.col(key_col).cast("string"), F.lit("lang")), F.lit(1 << 20))
    sizes = {r[0]: r[1] for r in light.groupBy(lang_col).count().collect()}
    if not sizes:
        return Filters({})
    # twice the sample by hash, then exactly the sample by order of the hash
    bar = F.lit(0)
    for lang, n in sizes.items():
        bar = F.when(F.col(lang_col) == lang, F.lit(int(min(1.0, 2 * sample / n) * (1 << 20)))).otherwise(bar)
    few = light.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t"), chance.alias("_p")).where(F.col("_p") < bar)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_p", F.xxhash64("t")))
    few = few.withColumn("_r", rank).where(F.col("_r") <= sample).select("lang", "t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, inverse = np.unique(np.array(b.column("lang").to_pylist(), dtype=object).astype(str), return_inverse=True)
            for i, _, h, first in grams(b.column("t")):
                own = np.repeat(inverse[i : i + len(first) - 1], np.diff(first))
                for k, name in enumerate(names):
                    g, n = np.unique(h[own == k], return_counts=True)
                    if len(g):
                        yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(g)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "g", "n"])

    found = few.mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    found = found.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    found = found.withColumn("top", F.max("rate").over(Window.partitionBy("g"))).where((F.col("n") >= LEAST) & (F.col("rate") >= RATIO * F.col("top")))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("r") <= GRAMS)
    got = found.select("lang", "g").toArrow()
    lang, g = got.column("lang").to_pylist(), got.column("g").to_numpy().view(np.uint64)
    names = np.array(lang, dtype=object)
    return Filters({x: g[names == x] if len(g) else np.zeros(0, np.uint64) for x in sizes})


def identify(docs: DataFrame, filters: Filters, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """All columns of docs and the predicted language and score."""
    sent = docs.sparkSession.sparkContext.broadcast(filters)

    def of(texts: pa.Array) -> pa.Array:
        best, score = sent.value.predict(texts)
        return pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(score)], names=["lang", "score"])

    (both,) = fresh(docs, "guess")
    out = docs.withColumn(both, F.arrow_udf(of, "lang string, score double")(F.col(text_col)))
    return out.withColumns({lang_out: F.col(both)["lang"], score_out: F.col(both)["score"]}).drop(both)
