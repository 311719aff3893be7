"""Quality classifier: naive Bayes support vectors over n-gram indicators.

A document's features are the distinct n-grams it has: runs of 1 to 3 bytes of UTF-8 over whole texts, and
single words and pairs, each hashed to one of 2^18 places. Indicators are scaled by the log-count ratio
of the classes (naive Bayes), scaled to unit length, and a linear hinge-loss model is fitted by dual
coordinate descent. A logistic curve fitted to margins of held-back training rows gives scores from 0 to 1.

Only labelled rows train, at most `most` of them, since the fit runs on the driver: `most` labels (those with the
smallest hash of their id), and if their ids have more texts than that, the `most` texts with the smallest hash.
What the driver gets is bounded by `most` rows of distinct features. Scoring is one pass over
whole texts with two vectors of fixed size.

Defined cases: a null or empty text has no features and scores by the bias alone; rows without a label or
with a null id don't train; equal ids train with each of their different texts; without rows of both classes every
score is the share of good labels, or 0.5; repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.llm.common import table
from tabulon.llm.words import Words, give_back, mix, slices, thrifty

BITS = 18
THRESHOLD = 0.7


def features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    found = Words(texts)
    h = found.names()[0]
    raw = found.buf.astype(np.uint64)
    top = np.uint64(64 - BITS)
    single = (mix(h ^ np.uint64(0x51)) >> top).astype(np.int32)
    double = (mix(h[:-1] * np.uint64(3) + h[1:] + np.uint64(0x52)) >> top).astype(np.int32)
    grams = []
    value = np.zeros(len(raw), np.uint64)
    for n in (1, 2, 3):
        value = value[: max(0, len(raw) - n + 1)] * np.uint64(256) + raw[n - 1 :]
        grams.append((mix(value + np.uint64(n << 40)) >> top).astype(np.int32))
    for k in range(len(found.offsets) - 1):
        a, b = int(found.offsets[k]), int(found.offsets[k + 1])
        i, j = int(found.first[k]), int(found.first[k + 1])
        parts = [single[i:j], double[i : max(i, j - 1)], *[g[a : max(a, b - n)] for n, g in enumerate(grams)]]
        every = np.concatenate(parts)
        every.sort()
        yield every[np.concatenate([[True], every[1:] != every[:-1]])] if len(every) else every


def log_count_ratios(rows: list[np.ndarray], good: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed shares of each feature."""
    counts = []
    for side in (True, False):
        c = np.full(1 << BITS, smooth)
        for r, g in zip(rows, good, strict=True):
            if g == side:
                c[r] += 1  # a row's features are distinct
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias minimising |w|^2/2 + sum of cost * hinge(y (w.x + b)), one dual variable at a time.

    The bias is a feature of value 1. A sweep visits the rows in a new order and each step is exact.
    """
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) + 1 for v in values])
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            slope = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to labels, by Newton's method with Platt's targets."""
    p, n = good.sum(), (~good).sum()
    t = np.where(good, (p + 1) / (p + 2), 1 / (n + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    at = np.array([1.0, np.log((p + 1) / (n + 1))])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (q - t) + 1e-6 * at)
        at -= step
        if np.abs(step).max() < 1e-8:
            break
    return float(at[0]), float(at[1])


def unit(values: np.ndarray) -> np.ndarray:
    size = float(np.sqrt(values @ values))
    return values / size if size else values


class Model:
    """ratio: the features' log-count ratios; weight: of the scaled features; slope and offset of the score."""

    def __init__(self, rows: list[np.ndarray], good: np.ndarray):
        self.ratio = self.weight = np.zeros(1 << BITS, np.float32)
        self.bias = self.slope = 0.0
        p = good.mean() if len(good) else 0.5
        self.offset = float(np.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6))))
        if len(rows) < 10 or not 1 < good.sum() < len(good) - 1:
            return
        margins = np.zeros(len(rows))
        part = np.arange(len(rows)) % 3
        for k in range(3):
            self.fit([r for r, x in zip(rows, part, strict=True) if x != k], good[part != k])
            for i in np.flatnonzero(part == k):
                margins[i] = self.margin(rows[i])
        self.slope, self.offset = logistic(margins, good)
        self.fit(rows, good)

    def fit(self, rows: list[np.ndarray], good: np.ndarray) -> None:
        self.ratio = log_count_ratios(rows, good).astype(np.float32)
        y = np.where(good, 1.0, -1.0)
        share = np.where(good, 0.5 / max(good.sum(), 1), 0.5 / max((~good).sum(), 1)) * len(rows)
        self.weight, self.bias = dual_descent(rows, [unit(self.ratio[r]) for r in rows], y, 4.0 * share)
        self.weight = self.weight.astype(np.float32)

    def margin(self, row: np.ndarray) -> float:
        return float(self.weight[row].astype(float) @ unit(self.ratio[row].astype(float))) + self.bias

    def score(self, row: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(row) + self.offset, -500, 500))))


def train(docs: DataFrame, labels: DataFrame, learn, most: int = 6000) -> Model:
    """Fits to the labelled rows (quality 0 or 1) of docs (doc_id, text) where the condition `learn` on doc_id holds."""
    chosen = labels.filter("doc_id IS NOT NULL AND quality IN (0, 1)").filter(learn).select("doc_id", "quality")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(most)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = [r.tobytes() for r in features(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.binary())], names=["doc_id", "quality", "row"])

    # the chosen labels are at most `most` rows, so they are sent to the texts
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    held = own.join(F.broadcast(chosen.select("doc_id", F.col("quality").cast("int").alias("quality"))), "doc_id")
    if docs.select("doc_id").join(F.broadcast(chosen), "doc_id").limit(most + 1).count() > most:  # ids or labels that repeat
        keys = ["doc_id", "quality", F.xxhash64("doc_id", "text").alias("pick")]
        texts = held.groupBy(*keys).agg(F.min("text").alias("text"))
        picked = held.select(*keys).distinct().orderBy("pick", "doc_id", "quality").limit(most)
        held = texts.join(F.broadcast(picked), ["doc_id", "quality", "pick"])
    found = held.select("doc_id", "text", "quality").mapInArrow(thrifty(extract), "doc_id long, quality int, row binary").toArrow().combine_chunks()
    ids, labels, rows = (found.column(k) for k in range(3))
    own = [np.frombuffer(r.as_buffer(), np.int32) for r in rows]  # views of what was fetched
    order = sorted(range(len(own)), key=lambda k: (ids[k].as_py(), labels[k].as_py(), own[k].tobytes()))
    model = Model([own[k] for k in order], np.array([labels[k].as_py() == 1 for k in order], bool))
    del found, ids, labels, rows, own
    give_back()
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with `score` of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != "score"]
    source = docs.select(*keep)
    at = keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        scale = (m.weight * m.ratio).astype(np.float32)
        square = (m.ratio * m.ratio).astype(np.float32)
        for whole in batches:
            for batch in slices(whole, "text"):
                z = []
                for row in features(batch.column(at)):
                    size = float(np.sqrt(square[row].sum(dtype=float)))
                    margin = float(scale[row].sum(dtype=float)) / size + m.bias if size else m.bias
                    z.append(m.slope * margin + m.offset)
                score = 1 / (1 + np.exp(-np.clip(np.array(z), -500, 500)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*keep, "score"])

    return source.mapInArrow(thrifty(run), T.StructType([*source.schema.fields, T.StructField("score", T.DoubleType())]))


def learns(column: str = "doc_id"):
    """Whether a row may train: three folds of four by the CRC of the id's digits."""
    return F.crc32(F.col(column).cast("string")) % 4 != 2


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), learns())
    return scored(docs, model).select("doc_id", (~learns()).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
