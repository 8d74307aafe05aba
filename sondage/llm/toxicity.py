"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed 4-, 5- and 6-grams of its bytes (ASCII letters
in lower case, runs of other ASCII signs as one space), present or not. A
feature's scale is its log-count ratio between the two labels; weights of the
scaled features come from logistic regression with an L2 penalty.

Training takes up to ``SAMPLE`` distinct labelled texts of each label, chosen by a hash of
the text, so the fit is one bounded task; scoring is a projection over Arrow
batches of whole texts. Features whose ratio is weak, or that too few texts have,
get no weight.

Defined results: an empty or null text has no features and scores the model's
prior; rows without a label (or with a null one) do not train; without both labels
every score is 0; of repeated label rows of an id each counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .frames import distinct_sample, drawn_hashes, drawn_texts, map_slices, pick, saved, text_buffer, text_hash

BITS = 20
GRAMS = (4, 5, 6)
SAMPLE = 4000
SEED = 7
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[48:58] = np.arange(48, 58)
_PLAIN[128:] = np.arange(128, 256)


def gram_hashes(low: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hash of the n-gram that begins at each byte."""
    if len(low) < n:
        return np.zeros(0, np.uint32)
    h = np.full(len(low) - n + 1, n, np.uint32)
    for k in range(n):
        h *= np.uint32(0x01000193)
        h ^= low[k:len(low) - n + 1 + k]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - bits)


def plain_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with runs of signs as one space, and where each text begins; a space parts texts."""
    raw, offsets = text_buffer(texts)
    low = _PLAIN[raw]
    keep = low != 32
    keep[1:] |= low[:-1] != 32
    inner = offsets[:-1][offsets[:-1] < len(low)]
    keep[inner] = True
    before = np.concatenate([[0], np.cumsum(keep)])
    return low[keep], before[offsets]


def features_of(low: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The distinct features of one text."""
    return np.unique(np.concatenate([gram_hashes(low, n, bits) for n in GRAMS]))


@dataclass
class Model:
    weights: np.ndarray  # by feature, the ratio multiplied in
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        low, offsets = plain_texts(texts)
        bits = int(np.log2(len(self.weights)))
        rows, found = [], []
        for n in GRAMS:
            hashes = gram_hashes(low, n, bits)
            at = np.flatnonzero(self.weights[hashes])
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + n <= offsets[row + 1]
            rows.append(row[inside])
            found.append(hashes[at[inside]])
        pairs = np.unique(np.concatenate(rows).astype(np.int64) << bits | np.concatenate(found).astype(np.int64))
        sums = np.bincount(pairs >> bits, self.weights[pairs & ((1 << bits) - 1)], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(sums + self.bias, -40, 40)))


def fit(frame: pd.DataFrame, bits: int = BITS, least: int = 4, ratio: float = 1.5, rounds: int = 300,
        penalty: float = 1e-3) -> Model:
    """Ratios from presence counts, then weights by accelerated gradient descent on the scaled features."""
    size = 1 << bits
    label = frame["label"].to_numpy() > 0
    low, offsets = plain_texts(pa.array(frame["text"], pa.string()))
    sets = [features_of(low[a:b], bits) for a, b in zip(offsets, offsets[1:])]
    if label.all() or not label.any():
        return Model(np.zeros(size), -40.0)
    yes, no = np.zeros(size), np.zeros(size)
    for found, toxic in zip(sets, label):
        (yes if toxic else no)[found] += 1
    r = np.log((yes + 1) / (label.sum() + 2)) - np.log((no + 1) / ((~label).sum() + 2))
    used = (np.abs(r) >= ratio) & (yes + no >= least)
    place = np.cumsum(used) - 1
    chosen = [place[f[used[f]]] for f in sets]
    row = np.repeat(np.arange(len(sets)), [len(c) for c in chosen])
    col = np.concatenate(chosen) if chosen else np.zeros(0, int)
    scale = r[used]
    value = scale[col]
    weight = np.where(label, 0.5 / label.sum(), 0.5 / (~label).sum())
    w, bias = np.zeros(len(scale)), 0.0
    velocity, velocity_b = np.zeros_like(w), 0.0
    lengths = np.bincount(row, value ** 2, len(sets))
    step = 4.0 / (np.average(lengths, weights=weight) + 1) * 2
    best = (np.inf, w, bias)
    for _ in range(rounds):
        ahead, ahead_b = w + 0.9 * velocity, bias + 0.9 * velocity_b
        z = np.bincount(row, ahead[col] * value, len(sets)) + ahead_b
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        loss = float((weight * np.logaddexp(0, np.where(label, -z, z))).sum() + penalty / 2 * (ahead ** 2).sum())
        if loss < best[0]:
            best = (loss, ahead.copy(), ahead_b)
        elif loss > 2 * best[0] + 0.1:
            step, velocity, velocity_b = step / 2, velocity * 0, 0.0
            w, bias = best[1].copy(), best[2]
            continue
        error = weight * (p - label)
        velocity = 0.9 * velocity - step * (np.bincount(col, error[row] * value, len(w)) + penalty * ahead)
        velocity_b = 0.9 * velocity_b - step * error.sum()
        w, bias = w + velocity, bias + velocity_b
    weights = np.zeros(size)
    weights[used] = best[1] * scale
    return Model(weights, float(best[2]))


def sample_by_label(rows: DataFrame, per_label: int) -> DataFrame:
    """About ``per_label`` distinct texts of each label, never more than twice that."""
    return distinct_sample(rows, "label", per_label, SEED)


def train(labelled: DataFrame, *, text: str = "text", label: str = "label", sample: int = SAMPLE) -> Model:
    """The model of labelled texts (label above 0: toxic)."""
    rows = pick(labelled, text=text, label=label).where("label is not null")
    rows = rows.select("text", (F.col("label") > 0).cast("int").alias("label"))
    return fitted(sample_by_label(rows, sample))


def train_by_id(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "label",
                sample: int = SAMPLE) -> Model:
    """The model of texts whose labels are in a table of their own: only ids and hashes are joined, never whole texts."""
    source = pick(docs, doc_id=doc_id, text=text)
    known = pick(labels, doc_id=doc_id, label=label).where("label is not null")
    known = known.select("doc_id", (F.col("label") > 0).cast("int").alias("label"))
    chosen = drawn_hashes(source.select("doc_id", text_hash(SEED)).join(known, "doc_id"), "label", sample)
    return fitted(drawn_texts(source, chosen, "label", SEED))


def fitted(chosen: DataFrame) -> Model:
    """The model of a bounded sample (label, text), in one task."""

    def task(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.assign(text=frame["text"].fillna("")).sort_values(["label", "text"], ignore_index=True)
        model = fit(frame)
        at = np.flatnonzero(model.weights)
        return pd.DataFrame({"bias": [model.bias], "features": [at], "weights": [model.weights[at]]})

    one = chosen.groupBy(F.lit(0).alias("all")).applyInPandas(task, "bias double, features array<bigint>, weights array<double>")
    row = saved(one, "toxicity-model").first()
    weights = np.zeros(1 << BITS)
    if row is None:
        return Model(weights, -40.0)
    weights[np.array(row["features"], int)] = row["weights"]
    return Model(weights, row["bias"])


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, score``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # one table of 2 ** BITS numbers, whatever the corpus
    source = pick(docs, doc_id=doc_id, text=text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(shared.value.scores(batch.column("text")))], ["doc_id", "score"])

    return map_slices(source, "text", work, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double")
