"""Language identification by the nearest of several centroids per language.

A text becomes a vector of hashed byte 3-grams (ASCII letters in lower case, other
ASCII as a space), weighted log(1 + count) x idf and normalised. Each language has up
to ``CENTROIDS`` centroids from spherical k-means. A text takes the language of the
centroid with the largest cosine. It is rejected if that cosine is below what the
language's training texts of about its length have (short texts lie further out than long
ones; lengths count by powers of two): below their 1st percentile over ``SLACK``, or below
a quarter of their median. Neither is set by single outliers, and the median still holds
where junk with a label makes the percentile loose. Likewise a centroid needs ``LEAST`` of
its language's texts: one text far from all others is no centroid.

Training takes about ``SAMPLE`` distinct texts per language, chosen by a hash of the text, and
fits each language in one bounded task; prediction is a projection over Arrow batches
of whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0, and
rejected; a text with letters always names a learned language (``und`` where none was
learned); null languages do not train; equal cosines go to the first language by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import column, distinct_sample, map_slices, pick, saved, text_buffer

BITS = 13
SAMPLE = 1000
CENTROIDS = 4
SLACK = 1.5
TAIL = 0.01
FAR = 4.0  # a text whose cosine is so many times smaller than the median is rejected
LEAST = 0.02
POOL = 100  # texts that a length class needs; with fewer its neighbours count too
LENGTHS = 40  # powers of two of a text's number of 3-grams
SLICE = 512 << 10
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[65:91] = np.arange(97, 123)
_PLAIN[97:123] = np.arange(97, 123)
_PLAIN[128:] = np.arange(128, 256)


def gram_counts(texts: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed 3-grams, a row per text, and which texts have a letter."""
    raw, offsets = text_buffer(texts)
    low = _PLAIN[raw]
    size = 1 << bits
    out = np.zeros((len(offsets) - 1, size), np.float32)
    letter = np.zeros(len(offsets) - 1, bool)
    x = low.astype(np.uint32)
    h = (x[:-2] * np.uint32(0x9E3779B1) ^ x[1:-1] * np.uint32(0x85EBCA77) ^ x[2:] * np.uint32(0xC2B2AE3D)) if len(x) > 2 else x[:0]
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - bits)
    blank = (x[:-2] == 32) & (x[1:-1] == 32) if len(x) > 2 else x[:0]
    for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        part = low[a:b]
        letter[i] = bool(((part >= 97) & (part <= 122)).any()) or (
            bool((part >= 128).any()) and any(c.isalpha() for c in (texts[i].as_py() or "")))
        if b - a > 2:
            out[i] = np.bincount(h[a:b - 2][~blank[a:b - 2].astype(bool)], minlength=size)
    return out, letter


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    vectors = np.log1p(counts, out=counts) * idf
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)


def size_class(counts: np.ndarray) -> np.ndarray:
    """The power of two of each text's number of 3-grams."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), LENGTHS - 1)


def cluster(vectors: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means with furthest-first seeds: centroids that hold enough vectors, and each vector's cosine to the nearest."""
    def unit(v: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(v)
        return v / norm if norm else v

    centres = [unit(vectors.mean(axis=0))]
    while len(centres) < min(k, len(vectors)):
        nearest = (vectors @ np.array(centres).T).max(axis=1)
        centres.append(vectors[int(nearest.argmin())])
    centres = np.array(centres)
    for _ in range(rounds):
        mine = (vectors @ centres.T).argmax(axis=1)
        centres = np.array([unit(vectors[mine == c].mean(axis=0)) if (mine == c).any() else centres[c]
                            for c in range(len(centres))])
    held = np.bincount((vectors @ centres.T).argmax(axis=1), minlength=len(centres))
    centres = centres[held >= LEAST * len(vectors)]
    return centres, (vectors @ centres.T).max(axis=1)


def floors_by_length(cosines: np.ndarray, lengths: np.ndarray, slack: float) -> np.ndarray:
    """For each length class the least cosine of a text that is not rejected; falling by the root of the length below the shortest text seen."""
    n = np.bincount(lengths, minlength=LENGTHS)
    floors = np.zeros(LENGTHS)
    shortest = int(lengths.min())
    for k in range(shortest, LENGTHS):
        width = 0
        while n[max(0, k - width):k + width + 1].sum() < min(POOL, len(lengths)):
            width += 1
        near = cosines[np.abs(lengths - k) <= width]
        floors[k] = max(np.quantile(near, TAIL) / slack, np.median(near) / FAR)
    floors[:shortest] = floors[shortest] / np.sqrt(2.0) ** np.arange(shortest, 0, -1)
    return floors


@dataclass
class Model:
    idf: np.ndarray
    centres: np.ndarray  # a row per centroid, by language
    names: list[str]
    floors: np.ndarray  # least cosine of the centroid's language, by length class

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and rejection of each text."""
        counts, letter = gram_counts(texts)
        if not self.names or not len(counts):
            return ["und"] * len(counts), np.zeros(len(counts)), np.ones(len(counts), bool)
        lengths = size_class(counts)
        cosines = weighted(counts, self.idf) @ self.centres.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best], 0, 1).astype(float)
        far = score < self.floors[best, lengths]
        return ([self.names[b] if ok else "und" for b, ok in zip(best, letter)],
                np.where(letter, score, 0.0), far | ~letter)


def train(docs: DataFrame, *, text: str = "text", lang: str = "lang", sample: int = SAMPLE, centroids: int = CENTROIDS,
          slack: float = SLACK) -> Model:
    """The model of the texts whose language is known."""
    rows = pick(docs, text=text, lang=lang).where("lang is not null and text is not null")
    picked = saved(distinct_sample(rows, "lang", sample, 3), "language-sample")
    if picked.isEmpty():
        return Model(np.ones(1 << BITS, np.float32), np.zeros((0, 1 << BITS), np.float32), [],
                     np.zeros((0, LENGTHS)))

    def presence(batches):
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                counts, _ = gram_counts(batch.column("text").slice(i, 200))
                total += (counts > 0).sum(axis=0)
                n += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()])], ["n", "total"])

    parts = picked.select("text").coalesce(8).mapInArrow(presence, "n bigint, total array<bigint>").collect()
    n = sum(p["n"] for p in parts)
    idf = (np.log((1 + n) / (1 + sum(np.array(p["total"]) for p in parts))) + 0.05).astype(np.float32)

    def fit(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        texts = pa.array(sorted(frame["text"]), pa.string())
        parts, lengths = [], []
        for i in range(0, len(texts), 200):
            counts, _ = gram_counts(texts.slice(i, 200))
            lengths.append(size_class(counts))
            parts.append(weighted(counts, idf))
        centres, cosines = cluster(np.concatenate(parts), centroids)
        floors = floors_by_length(cosines, np.concatenate(lengths), slack)
        return pd.DataFrame({"lang": key[0], "place": range(len(centres)), "centre": list(centres.astype(float)),
                             "floors": [floors] * len(centres)})

    fitted = picked.groupBy("lang").applyInPandas(
        fit, "lang string, place int, centre array<double>, floors array<double>").collect()
    fitted.sort(key=lambda r: (r["lang"], r["place"]))
    return Model(idf, np.array([r["centre"] for r in fitted], np.float32), [r["lang"] for r in fitted],
                 np.array([r["floors"] for r in fitted]))


def identify(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score, rejected``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few centroids per language
    source = pick(docs, doc_id=doc_id, text=text)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score, rejected = shared.value.predict(batch.column("text"))
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score), pa.array(rejected)],
            ["doc_id", "lang_pred", "score", "rejected"])

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_slices(source, "text", work, f"doc_id {kind}, lang_pred string, score double, rejected boolean", SLICE)


def keep_known(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """The rows whose text is not rejected, with their own columns only."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    wrapped = docs.select(*[column(n).alias(f"c{i}") for i, n in enumerate(docs.columns)])
    place = f"c{docs.columns.index(text)}"

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(~shared.value.predict(batch.column(place))[2]))

    kept = map_slices(wrapped, place, work, wrapped.schema, SLICE)
    return kept.toDF(*docs.columns)
