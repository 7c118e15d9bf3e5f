"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Presence of hashed character n-grams is counted by class over a bounded sample of labelled
rows (``TRAIN_ROWS``, smallest hashes of the id first). The log-count ratio of each n-gram
scales its feature. Logistic regression weighs them: the ``FEATURES`` n-grams whose ratio stands out
most from its sampling error each get a weight of their own, all others share one, on their mean
ratio in the text. So every n-gram that training saw counts, and the model is a table of fixed
size; scoring is one Arrow pass over all documents whatever their number.

Defined cases: null or empty text has no n-gram and gets the score of the intercept; rows of
``labels`` without a doc_id or a toxic mark are left out, several marks of one document count
as toxic if any is; a null doc_id is never held out; repeated rows get equal scores; an empty
``documents`` gives an empty result; without labels every score is 1/3.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from denspark.lineage import table
from denspark.llm import textops

#: Bounds of the model: labelled rows learned from, hash buckets of n-grams, n-grams with a weight of their own.
TRAIN_ROWS, BUCKETS, FEATURES = 12_000, 1 << 18, 2048
SIZES = (4, 5)
SMOOTHING, PENALTY, STEPS = 1.0, 2.0, 120
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


@dataclass(frozen=True)
class Model:
    """``slot`` maps a bucket to a feature (-1: none); ``weight`` has the scaled weight of each feature, ``rest`` that of other buckets."""

    slot: np.ndarray
    weight: np.ndarray
    rest: np.ndarray
    intercept: float


def characters(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points with A-Z folded to a-z, and their offsets by document."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).copy()
    upper = (points >= 65) & (points <= 90)
    points[upper] += np.uint32(32)
    starts = np.concatenate([[0], np.cumsum(textops.code_points(raw), dtype=np.int64)])
    return points, starts[offs]


def buckets(points: np.ndarray, offs: np.ndarray, size: int) -> np.ndarray:
    """Bucket of the n-gram that starts at each character; n-grams over a document's end are marked by BUCKETS."""
    n = max(0, len(points) - size + 1)
    h = np.full(n, size * 0x1B873593 & 0xFFFFFFFF, np.uint32)
    for j in range(size):
        h += points[j : j + n] * _ODD[j]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    out = (h >> np.uint32(14)).astype(np.int32)
    inner = offs[1:-1]
    for back in range(1, size):
        cut = inner - back
        out[cut[(cut >= 0) & (cut < n)]] = BUCKETS
    return out


def presence(raw: np.ndarray, offs: np.ndarray, slot: np.ndarray, n_features: int, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents x features: which features each document of a slice holds; and the mean of ``rest`` over its n-grams."""
    points, ends = characters(raw, offs)
    n = len(offs) - 1
    held = np.zeros((n, n_features), bool)
    total, grams = np.zeros(n), np.zeros(n)
    doc = np.repeat(np.arange(n, dtype=np.int32), np.diff(ends))
    for size in SIZES:
        bucket = buckets(points, ends, size)
        own = doc[: len(bucket)]
        feature = slot[bucket]
        at = np.flatnonzero(feature >= 0)
        held[own[at], feature[at]] = True
        total += np.bincount(own, rest[bucket], n)
        grams += np.maximum(np.diff(ends) - size + 1, 0)
    return held, total / np.maximum(grams, 1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, BUCKETS + 1), np.int64)
    for batch in batches:
        toxic = batch.column(batch.schema.get_field_index("toxic")).to_numpy(zero_copy_only=False)
        for row, raw, offs in textops.slices(textops.text_column(batch)):
            points, ends = characters(raw, offs)
            for d in range(len(offs) - 1):
                own = points[ends[d] : ends[d + 1]]
                seen = np.concatenate([buckets(own, np.array([0, len(own)]), k) for k in SIZES])
                counts[int(toxic[row + d]), np.unique(seen)] += 1
    used = np.flatnonzero(counts.sum(0)[:BUCKETS])
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[1, used]), pa.array(counts[0, used])], names=["bucket", "toxic", "clean"])


def _fit(x: np.ndarray, mean: np.ndarray, y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Logistic regression on features scaled by ``ratio`` and on ``mean``: full-batch gradient with momentum. Weights, that of ``mean``, intercept."""
    middle, spread = float(mean.mean()), float(max(mean.std(), 1e-9))
    x = np.hstack([x.astype(np.float32) * ratio.astype(np.float32), ((mean - middle) / spread)[:, None].astype(np.float32)])
    w, b = np.zeros(x.shape[1], np.float32), float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    step = np.float32(4 / max(1e-9, float((x * x).sum(1).mean())))
    vw, vb = np.zeros_like(w), 0.0
    for k in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        e = (p - y).astype(np.float32)
        keep = np.float32(k / (k + 3))
        vw = keep * vw - step * (e @ x / len(y) + np.float32(PENALTY / len(y)) * w)
        vb = float(keep) * vb - float(e.mean())
        w, b = w + vw, b + vb
    return w[:-1] * ratio, float(w[-1]) / spread, b - float(w[-1]) * middle / spread


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learns from ``labels`` rows whose crc32 of the id as text isn't divisible by 5, ``rows`` at most."""
    own = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic is not null")
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    sample = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # At most ``rows`` ids of 12 bytes are broadcast.
    learned = table(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic").repartition(16))
    sizes = learned.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    n_toxic, n = sizes["t"] or 0, sizes["n"]
    slot = np.full(BUCKETS + 1, -1, np.int16)
    if not 0 < n_toxic < n:
        return Model(slot, np.zeros(1), np.zeros(BUCKETS + 1, np.float32), float(np.log((n_toxic + 0.5) / (n - n_toxic + 1))))
    # BUCKETS rows at most reach the driver.
    counts = learned.mapInArrow(_count, "bucket int, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).toArrow()
    bucket, t, c = (counts.column(k).to_numpy() for k in ("bucket", "t", "c"))
    ratio = np.log((t + SMOOTHING) / (n_toxic + 2 * SMOOTHING)) - np.log((c + SMOOTHING) / (n - n_toxic + 2 * SMOOTHING))
    clear = np.abs(ratio) / np.sqrt(1 / (t + SMOOTHING) + 1 / (c + SMOOTHING))
    best = np.lexsort((bucket, -clear))[:FEATURES]
    slot[bucket[best]] = np.arange(len(best))
    rest = np.zeros(BUCKETS + 1, np.float32)
    rest[bucket] = ratio
    rest[bucket[best]] = 0

    def design(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(batch.schema.get_field_index("toxic"))
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                held, mean = presence(raw, offs, slot, len(best), rest)
                bits = np.packbits(held, axis=1)
                yield pa.RecordBatch.from_arrays([toxic.slice(row, len(bits)).cast(pa.int32()), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(mean)], names=["toxic", "bits", "mean"])

    # ``rows`` rows of FEATURES bits at most reach the driver.
    seen = learned.mapInArrow(design, "toxic int, bits binary, mean double").toArrow()
    packed = np.frombuffer(b"".join(seen.column("bits").to_pylist()), np.uint8).reshape(seen.num_rows, -1)
    mean = seen.column("mean").to_numpy()
    order = np.lexsort((mean, *packed[:, :8].T))
    x = np.unpackbits(packed[order], axis=1)[:, : len(best)]
    weight, common, intercept = _fit(x, mean[order], seen.column("toxic").to_numpy()[order], ratio[best])
    return Model(slot, weight, rest * np.float32(common), intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for row, raw, offs in textops.slices(textops.text_column(batch)):
                held, mean = presence(raw, offs, model.slot, len(model.weight), model.rest)
                z = held @ model.weight.astype(np.float32) + mean + model.intercept
                yield pa.RecordBatch.from_arrays([ids.slice(row, len(z)), pa.array(1 / (1 + np.exp(-np.clip(z.astype(float), -30, 30))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(judge, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on ``labels`` and scores every document."""
    return score(docs, train(docs, labels, rows))
