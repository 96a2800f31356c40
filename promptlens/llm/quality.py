"""Quality classifier: linear support vectors on n-gram indicators scaled by naive Bayes.

Features are the hashed byte 2-, 3- and 4-grams of the text, each counted once
(indicators).  The log-count ratio of the two classes scales them, and a
linear hinge-loss model is fitted by dual coordinate descent; a logistic curve
on a part kept from the fit turns margins into probabilities.

Only the fit uses a sample: at most ``PER_CLASS`` labelled rows of each class,
the first in hash order of their ids, and of those as many as have
``MOST_BYTES`` of features, so it is a bounded broadcast and a bounded collect.  Scoring covers every row in one pass without a shuffle.
Labels, lang, source and doc_id never enter a score.

Defined cases: null text is empty; an empty text has the score of the bias;
null labels are not used; of several texts or labels of one id the least
counts; where one class has no label, every score is (n + 1) / (n + 2) of the n
rows of label 1, or 1 / (n + 2) if all have label 0, and 0.5 without any label; rows that repeat are scored
each; a null doc_id counts as held out; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptlens.llm.common import bytes_view, release_memory, steps, text_of

PER_CLASS = 3_000
#: Bytes of features that the fit gathers at most, half of them for each class.
MOST_BYTES = 256 << 20
BITS = 17
#: Texts with fewer distinct n-grams count as having so many: few n-grams are weak evidence.
SHORT = 400
THRESHOLD = 0.7
EPOCHS = 20
COST = 4.0
#: Weight of the scaled model against a flat one of its mean size.
BETA = 0.5


def features(data: np.ndarray) -> np.ndarray:
    """Indices of the n-grams of one text, with repeats."""
    wide = data.astype(np.uint64)
    out, gram = [], wide
    for k in range(1, 4):
        if len(data) <= k:
            break
        gram = (gram[:-1] << np.uint64(8)) | wide[k:]
        out.append((gram * np.uint64(4) + np.uint64(k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BITS))
    return np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)


class Model:
    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probability(self, margin):
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -500, 500)))


def length_factor(count):
    """Every text's vector is divided by the root of its feature count, so that margins of long and short texts have one range."""
    return 1 / np.sqrt(np.maximum(count, SHORT))


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the hinge-loss model; rows hold feature indices, ``scale`` the value of each feature, ``cost`` the upper bound of each row's dual variable."""
    # Kept as weight times scale: a row's margin is a sum of these, and no row's values are held.
    rng = np.random.default_rng(7)
    scaled, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    square, factor = scale * scale, [float(length_factor(len(r))) for r in rows]
    norm = np.array([square[r].sum() * f * f + 1 for r, f in zip(rows, factor, strict=True)])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            gradient = y[i] * (scaled[rows[i]].sum() * factor[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                scaled[rows[i]] += step * factor[i] * square[rows[i]]
                bias += step
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return scaled, bias


def logistic(margin: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve, by Newton steps with smoothed targets; ``share`` of all labels are 1, whatever the sample's share."""
    good, bad = label.sum(), (1 - label).sum()
    weight = np.where(label > 0, share / max(good, 1), (1 - share) / max(bad, 1)) * len(label)
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g, w = weight * (p - target), weight * np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(rows: list[np.ndarray], label: np.ndarray, share: float = 0.5) -> Model:
    label = label.astype(float)
    if not len(rows) or label.min() == label.max():
        share = label.mean() if len(rows) else 0.5
        edge = (label.sum() + 1) / (len(rows) + 2) if len(rows) else 0.5
        return Model(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(edge / (1 - edge))) if share not in (0.5,) else 0.0)
    held = np.arange(len(rows)) % 5 == 4
    if len(set(label[held])) < 2 or len(set(label[~held])) < 2:
        held[:] = False
    counts = np.ones((2, 1 << BITS))
    for r, q in zip(rows, label, strict=True):
        counts[int(q), r] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[0] / counts[0].sum()))
    train = np.flatnonzero(~held)
    weight = np.where(label > 0, share / label.mean(), (1 - share) / (1 - label.mean()))  # the classes weigh as in all labels
    weights, bias = dual_coordinate_descent([rows[i] for i in train], label[train] * 2 - 1, ratio, COST * weight[train])
    weights = (1 - BETA) * np.abs(weights).mean() * np.sign(weights) + BETA * weights
    see = np.flatnonzero(held) if held.any() else train
    margin = np.array([weights[rows[i]].sum() * length_factor(len(rows[i])) + bias for i in see])
    return Model(weights, bias, *logistic(margin, label[see], share))


def held_out(doc_id):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """The model of a bounded sample of the labelled rows that are not held out."""
    usable = labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_quality")).where(F.col("_quality").isin(0, 1) & ~held_out("_id"))
    total = {r["_quality"]: r["n"] for r in usable.groupBy("_quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = [usable.where(F.col("_quality") == q).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for q in (0, 1)]
    chosen = sample[0].union(sample[1])  # at most 2 * per_class rows of two numbers
    texts = docs.select(F.col("doc_id").alias("_doc"), text_of().alias("text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("_id", "_quality", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            data, at = bytes_view(batch.column("text"))
            own = [np.unique(features(data[a:b])).tobytes() for a, b in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_quality"), pa.array(own, pa.binary())], ["_id", "_quality", "f"])

    # Of several texts or labels of one id the least counts, whatever the order of rows; no row is larger than 4 bytes for each bucket.
    kind = "_id long, _quality int, f binary"
    found = texts.mapInArrow(extract, kind).groupBy("_id").agg(F.min(F.struct("_quality", "f")).alias("r")).select("_id", "r.*")
    found = _bounded(found).toArrow()
    order = np.argsort(found.column("_id").to_numpy(), kind="stable")
    rows = [np.frombuffer(found.column("f")[int(i)].as_buffer(), np.int32) for i in order]
    model = fit(rows, found.column("_quality").to_numpy()[order], total.get(1, 0) / max(sum(total.values()), 1))
    del rows, found
    release_memory()
    return model


def _bounded(found: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Rows of each class, by the hash of their ids, as long as their features hold at most ``most`` bytes in all."""
    order = Window.partitionBy("_quality").orderBy(F.xxhash64("_id"), "_id")
    return found.withColumn("_sum", F.sum(F.octet_length("f").cast("long")).over(order)).where(F.col("_sum") <= most // 2).drop("_sum")


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with columns score and predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    names, types = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << BITS, bool)
        m = held.value
        for batch in steps(batches, "_text"):
            data, at = bytes_view(batch.column("_text"))
            margin = np.zeros(batch.num_rows)
            for i, (a, b) in enumerate(zip(at, at[1:], strict=False)):
                f = features(data[a:b])
                seen[f] = True
                own = np.flatnonzero(seen)
                margin[i] = m.weights[own].sum() * length_factor(len(own)) + m.bias
                seen[f] = False
            p = m.probability(margin)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    out = StructType([*types.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return docs.withColumn("_text", text_of()).mapInArrow(run, out)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")
