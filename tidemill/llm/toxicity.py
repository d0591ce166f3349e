"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

Features are the words of a text (lower-cased letters) and their first ``PREFIX`` bytes, hashed, with
value 1 if present, so that a word said once counts whatever the length of the text. One weight vector is shared by all thresholds: P(grade <= k) =
sigmoid(theta_k - w.x) with theta_1 < theta_2 < ..., and the output is the expected severity, the
sum over k of P(grade > k).

Labels say only whether a text is toxic. Grade 0 is a text that isn't; toxic texts get grades 1 to 3
by terciles of how many different features they have that the labels mark as abusive (those whose odds
of a toxic text are at least ``MARK`` times the usual), so severity orders texts by how much abuse they
hold.

The model is fitted on at most ``SAMPLE`` labelled texts, chosen by hash (a documented bound), on the
``FEATURES`` features most associated with the labels (chi-square of ``CHI`` or more); every text is then scored whole.
Defined results: a null or empty text has no features and gets the severity of the intercepts alone;
labels of unknown documents are ignored, conflicting labels count as toxic; without both kinds of
label nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm import kernel
from tidemill.llm.languages import letters

SAMPLE, FEATURES, PREFIX, CHI, MARK, GRADES = 8000, 4096, 5, 30.0, 8.0, 4
#: A text is rejected if P(grade >= 1) reaches this: one abusive word is enough evidence, though most toxic texts have several.
REJECT = 0.12


def features(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of rows: first row, then rows and features of the slice's features.

    The low bit of a feature tells prefixes from words.
    """
    for at, part in kernel.parts(texts):
        raw, off = kernel.buffers(letters(part))
        for i, j in kernel.spans(off):
            w = kernel.words(raw, off, i, j)
            if len(w.start):
                yield at + i, *_features(w)


def _features(w: kernel.Words) -> tuple[np.ndarray, np.ndarray]:
    """Each different feature of each row, once."""
    size = np.minimum(w.end - w.start, PREFIX)
    code = np.zeros(len(w.start), np.uint64)
    for s in range(PREFIX):
        at = np.minimum(w.start + s, len(w.data) - 1)
        code |= np.where(s < size, w.data[at], 0).astype(np.uint64) << np.uint64(8 * s)
    f = np.concatenate([w.hash & ~np.uint64(1), kernel.mix(code + np.uint64(7)) | np.uint64(1)])
    row = np.concatenate([w.row, w.row])
    _, at = np.unique(f ^ kernel.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
    return row[at], f[at]


@dataclass
class Ordinal:
    """Shared weights of the chosen features (sorted) and the ordered thresholds."""

    ids: np.ndarray
    weights: np.ndarray
    theta: np.ndarray

    def severity(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Expected severity and P(grade >= 1) of every text."""
        dot = np.zeros(len(texts))
        if len(self.ids):
            for i, row, f in features(texts):
                at = np.minimum(np.searchsorted(self.ids, f), len(self.ids) - 1)
                hit = self.ids[at] == f
                part = np.bincount(row[hit], weights=self.weights[at[hit]])
                dot[i : i + len(part)] += part
        above = 1 / (1 + np.exp(np.clip(self.theta[None, :] - dot[:, None], -500, 500)))
        return above.sum(axis=1), above[:, 0]


def fit_ordinal(row: np.ndarray, col: np.ndarray, val: np.ndarray, grade: np.ndarray, width: int, grades: int = GRADES, l2: float = 0.05, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch gradient descent with momentum (Adam); deterministic.

    Thresholds are theta_1 plus running sums of exponentials, so they stay in order.
    """
    n = len(grade)
    w, raw = np.zeros(width), np.zeros(grades - 1)
    share = np.array([(grade <= k).mean() for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    raw[0] = start[0]
    raw[1:] = np.log(np.maximum(np.diff(start), 1e-2))
    m1, m2 = np.zeros(width + grades - 1), np.zeros(width + grades - 1)
    for t in range(1, steps + 1):
        theta = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
        x = np.bincount(row, weights=val * w[col], minlength=n)
        # P(grade <= k) with the ends 0 and 1
        c = 1 / (1 + np.exp(np.clip(x[:, None] - theta[None, :], -60, 60)))
        full = np.concatenate([np.zeros((n, 1)), c, np.ones((n, 1))], axis=1)
        slope = np.concatenate([np.zeros((n, 1)), c * (1 - c), np.zeros((n, 1))], axis=1)
        at = np.arange(n)
        p = np.maximum(full[at, grade + 1] - full[at, grade], 1e-12)
        up, low = slope[at, grade + 1] / p, slope[at, grade] / p
        gx = up - low  # d(-log p)/dx
        gt = np.zeros(grades - 1)
        for k in range(grades - 1):
            gt[k] = -up[grade == k].sum() + low[grade == k + 1].sum()
        graw = np.concatenate([[gt.sum()], [gt[k:].sum() * np.exp(raw[k]) for k in range(1, grades - 1)]])
        g = np.concatenate([np.bincount(col, weights=val * gx[row], minlength=width) + l2 * w, graw]) / n
        m1 = 0.9 * m1 + 0.1 * g
        m2 = 0.99 * m2 + 0.01 * g * g
        step = 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-9)
        w -= step[:width]
        raw -= step[width:]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", sample: int = SAMPLE) -> Ordinal:
    marked = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(toxic_col).alias("_toxic"))
    total = marked.count()
    draw = F.xxhash64(F.col("_id").cast("string"), F.lit("tox"))
    if total > sample:
        bar = int((2 * sample / total) * (1 << 30)) if total > 2 * sample else 1 << 30
        marked = marked.where(F.pmod(draw, F.lit(1 << 30)) < bar).orderBy(draw).limit(sample)
    n, toxic = marked.agg(F.count("*"), F.coalesce(F.sum("_toxic"), F.lit(0))).first()
    none = Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 500.0))
    if not 0 < toxic < n:
        return none
    # at most `sample` ids and flags
    few = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(marked), "_id")
    few = few.dropDuplicates(["_id"]).select("_toxic", "_t")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flag = b.column("_toxic").to_numpy(zero_copy_only=False)
            for i, row, f in features(b.column("_t")):
                ids, inverse = np.unique(f, return_inverse=True)
                pos = np.bincount(inverse, weights=flag[i + row], minlength=len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(np.bincount(inverse)), pa.array(pos.astype(np.int64))], names=["f", "n", "pos"])

    sums = few.mapInArrow(count, "f long, n long, pos long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    share = toxic / n
    chi = F.expr(f"pow(pos - n * {share!r}D, 2) / (n * {share * (1 - share)!r}D * greatest(1 - n / {n}D, 1e-9D))")
    chosen = sums.where("n >= 3").withColumn("chi", chi).where(F.col("chi") >= CHI).orderBy(F.desc("chi"), "f").limit(FEATURES).collect()
    if not chosen:
        return none
    ids = np.array([r["f"] for r in chosen], np.int64).view(np.uint64)
    by = np.argsort(ids)
    ids, df, pos = ids[by], np.array([r["n"] for r in chosen])[by], np.array([r["pos"] for r in chosen])[by]
    odds = ((pos + 0.5) / (toxic + 1)) / ((df - pos + 0.5) / (n - toxic + 1))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            have: list[list[int]] = [[] for _ in range(len(b))]
            for i, row, f in features(b.column("_t")):
                at = np.minimum(np.searchsorted(ids, f), len(ids) - 1)
                for r, x in zip(row[ids[at] == f].tolist(), at[ids[at] == f].tolist(), strict=True):
                    have[i + r].append(x)
            yield pa.RecordBatch.from_arrays([b.column("_toxic").cast(pa.int32()), pa.array([sorted(x) for x in have], pa.list_(pa.int32()))], names=["toxic", "f"])

    got = few.mapInArrow(pick, "toxic int, f array<int>").collect()
    rows = sorted((r["toxic"], r["f"]) for r in got)  # whatever order the tasks ended in
    return _learn(ids, odds >= MARK, rows) or none


def _learn(ids: np.ndarray, abusive: np.ndarray, rows: list[tuple[int, list[int]]]) -> Ordinal | None:
    """The model of rows (toxic, indices of their features)."""
    toxic = np.array([t for t, _ in rows], np.int64)
    if not len(rows) or toxic.min() == toxic.max():
        return None
    owner = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    col = np.array([x for _, f in rows for x in f], np.int64)
    abuse = np.bincount(owner, weights=abusive[col], minlength=len(rows))
    cuts = np.quantile(abuse[toxic == 1], [1 / 3, 2 / 3])
    grade = np.where(toxic == 1, 1 + np.searchsorted(cuts, abuse, side="left"), 0)
    return Ordinal(ids, *fit_ordinal(owner, col, np.ones(len(col)), grade, len(ids)))


def severity_column(model: Ordinal, docs: DataFrame, text: Column) -> Column:
    """struct<severity double, p_toxic double>"""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def of(texts: pa.Array) -> pa.Array:
        s, p = sent.value.severity(texts)
        return pa.StructArray.from_arrays([pa.array(s), pa.array(p)], names=["severity", "p_toxic"])

    return F.arrow_udf(of, "severity double, p_toxic double")(text)


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bar: float = REJECT) -> DataFrame:
    """The rows whose probability of any toxic grade is below the bar, with the input's columns."""
    model = train(docs, labels, id_col, text_col)
    return docs.where(severity_column(model, docs, F.col(text_col))["p_toxic"] < bar)
