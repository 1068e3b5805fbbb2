"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning takes a bounded sample of the labelled rows (``max_rows``), deals it into shards of
``shard_rows`` and runs FTRL on each in its own task; the shards' weights are averaged.  Per-coordinate
rates let rare telling words learn fast, and L1 keeps most coordinates at exactly zero, so what is sent
to the scoring tasks is a few thousand numbers whatever the corpus (``2 ** bits`` at most).

Scoring reads every text whole, in Arrow batches, and needs no shuffle.  Features are present or not;
they are looked up first, and only those with a weight are made distinct per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.batches import text_slices

# word characters are 0-9, A-Z (lower-cased), a-z and everything outside ASCII
_WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
# text bytes whose words are hashed together
CHUNK_BYTES = 1 << 20


@dataclass(frozen=True)
class FTRLConfig:
    """Settings of learner and features.

    ``max_rows`` bounds the labelled rows learned from, ``shard_rows`` those of one task.  Features seen
    in fewer than ``min_df`` rows of a shard, or in more than ``max_df`` of them, are not learned.
    ``positive_weight`` multiplies the loss of toxic rows, which are the rarer class.
    """

    bits: int = 20
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 0.0
    epochs: int = 6
    positive_weight: float = 4.0
    max_rows: int = 16_000
    shard_rows: int = 4_000
    min_df: int = 4
    max_df: float = 0.2


@dataclass(frozen=True)
class ToxicityModel:
    """Sparse weights: ``features`` ascending, with ``weights`` beside them."""

    bits: int
    bias: float
    features: np.ndarray
    weights: np.ndarray


def _mix(x: np.ndarray, bits: int) -> np.ndarray:
    """Spread 64-bit values over ``bits`` bits."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def hashed_features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``texts`` and hashed features: words, neighbouring pairs, pairs with one word between."""
    words = [t.translate(_WORD_BYTES).split() for t in texts]
    counts = np.array([len(w) for w in words])
    doc = np.repeat(np.arange(len(texts)), counts)
    h = np.fromiter((crc32(x) for w in words for x in w), dtype=np.uint64, count=int(counts.sum()))
    docs, features = [doc], [_mix(h + np.uint64(1 << 40), bits)]
    for gap in (1, 2):
        same = doc[gap:] == doc[:-gap]
        pair = (h[:-gap] << np.uint64(32)) ^ h[gap:] ^ np.uint64(gap << 20)
        docs.append(doc[gap:][same])
        features.append(_mix(pair * np.uint64(0xD6E8FEB86659FD93), bits)[same])
    return np.concatenate(docs), np.concatenate(features)


def distinct_by_text(doc: np.ndarray, feature: np.ndarray, n: int) -> list[np.ndarray]:
    """The distinct features of each of ``n`` texts, ascending."""
    pairs = np.unique(doc << 32 | feature)
    edges = np.searchsorted(pairs, np.arange(n + 1) << 32)
    return [(pairs[a:b] & 0xFFFFFFFF).astype(np.int32) for a, b in zip(edges[:-1], edges[1:])]


def _chunks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


def fit_ftrl(rows: list[np.ndarray], labels: np.ndarray, cfg: FTRLConfig) -> tuple[float, np.ndarray, np.ndarray]:
    """Bias, features and weights learned from rows of distinct features, in the order given."""
    if not rows:
        return 0.0, np.zeros(0, np.int64), np.zeros(0)
    seen, df = np.unique(np.concatenate(rows), return_counts=True)
    seen = seen[(df >= cfg.min_df) & (df <= max(cfg.min_df, cfg.max_df * len(rows)))]
    # the last coordinate is the bias, free of L1
    last = len(seen)
    local = [np.append(np.flatnonzero(np.isin(seen, r, assume_unique=True)), last) for r in rows]
    z, n = np.zeros(last + 1), np.zeros(last + 1)
    l1 = np.full(last + 1, cfg.l1)
    l1[last] = 0.0

    def weight(zi, ni, l1i):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1i, 0.0)
        return -shrunk / ((cfg.beta + np.sqrt(ni)) / cfg.alpha + cfg.l2)

    for _ in range(cfg.epochs):
        for at, y in zip(local, labels):
            zi, ni = z[at], n[at]
            w = weight(zi, ni, l1[at])
            gradient = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            gradient *= cfg.positive_weight if y else 1.0
            grown = ni + gradient * gradient
            z[at] = zi + gradient - (np.sqrt(grown) - np.sqrt(ni)) / cfg.alpha * w
            n[at] = grown
    w = weight(z, n, l1)
    kept = np.flatnonzero(w[:last])
    return float(w[last]), seen[kept], w[kept]


def train(labelled: DataFrame, cfg: FTRLConfig = FTRLConfig()) -> ToxicityModel:
    """Learn from ``labelled(doc_id, text, label)``, at most ``max_rows`` rows of it.

    The caller bounds the rows; no rows give a model whose scores are all one half.
    """
    n_rows = labelled.count()
    shards = max(1, -(-n_rows // cfg.shard_rows))
    shard = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(shards)).cast("int")
    dealt = labelled.select(shard.alias("shard"), "doc_id", F.col("text").cast("binary").alias("text"), "label")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(order=[crc32(str(i).encode()) for i in group["doc_id"]])
        group = group.sort_values(["order", "doc_id", "label"], kind="stable")
        texts = [t or b"" for t in group["text"]]
        rows: list[np.ndarray] = []
        for _, part in _chunks(texts):
            doc, feature = hashed_features(part, cfg.bits)
            rows += distinct_by_text(doc, feature, len(part))
        bias, features, weights = fit_ftrl(rows, group["label"].to_numpy(float), cfg)
        frame = pd.DataFrame({"feature": np.append(features, -1), "weight": np.append(weights, bias)})
        return frame.assign(rows=len(group))

    # 2 ** bits rows per shard at most
    fitted = dealt.groupBy("shard").applyInPandas(fit, "feature long, weight double, rows long").toPandas()
    bias_rows = fitted[fitted["feature"] < 0]
    total = max(1, int(bias_rows["rows"].sum()))
    fitted["part"] = fitted["weight"] * fitted["rows"] / total
    summed = fitted.groupby("feature")["part"].sum().sort_index()
    summed = summed[summed != 0]
    bias = float(summed.get(-1, 0.0))
    summed = summed[summed.index >= 0]
    return ToxicityModel(cfg.bits, bias, summed.index.to_numpy(np.int64), summed.to_numpy(float))


def score_texts(texts: list[bytes], model: ToxicityModel, table: np.ndarray) -> np.ndarray:
    """Scores from 0 to 1; ``table`` holds the weights by feature."""
    doc, feature = hashed_features(texts, model.bits)
    hit = np.flatnonzero(table[feature])
    pairs = np.unique(doc[hit] << model.bits | feature[hit])
    sums = np.bincount(pairs >> model.bits, table[pairs & (len(table) - 1)], minlength=len(texts))
    return 1.0 / (1.0 + np.exp(-np.clip(model.bias + sums, -30, 30)))


def dense_table(model: ToxicityModel) -> np.ndarray:
    table = np.zeros(1 << model.bits)
    table[model.features] = model.weights
    return table


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): one row per row of ``docs``, null texts as empty ones.

    An empty text gets the bias alone.  Other columns are not read; repeated rows stay repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dense_table(model)
        for batch in batches:
            for part, texts in text_slices(batch, 1):
                scores = pa.array(score_texts([t or b"" for t in texts], model, table), pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores], ["doc_id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double")


def rows_below(docs: DataFrame, model: ToxicityModel, limit: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose own score is below ``limit``, all columns unchanged; no row is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = dense_table(model)
        for batch in batches:
            for part, texts in text_slices(batch, at):
                scores = score_texts([(t or "").encode() for t in texts], model, table)
                yield part.filter(pa.array(scores < limit))

    return docs.mapInArrow(run, docs.schema)


def fold(id_col: str, folds: int) -> Column:
    """Fold of a document: CRC-32 of its id as text."""
    return F.crc32(F.col(id_col).cast("string")) % folds


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, label) for at most ``max_rows`` rows of labelled ids in a fixed hash order.

    ``labels(doc_id, label)``: null labels and ids are left out; an id labelled twice takes the larger
    label.  The sample is bounded, so it is sent to the documents instead of shuffling their texts.  Where ids repeat, the
    rows of the sampled ids may be more: then equal rows count once and the first rows by a hash of id and text are taken.
    """
    one = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), "text")
    rows = slim.join(F.broadcast(sample), "doc_id")
    if docs.select(F.col(id_col).cast("long").alias("doc_id")).join(F.broadcast(sample.select("doc_id")), "doc_id").count() <= max_rows:
        return rows
    # hashes instead of texts are ordered; rows under the last one are taken as far as they fit
    placed = rows.withColumn("_h", F.xxhash64("doc_id", "text"))
    first = placed.select("_h").distinct().orderBy("_h").limit(max_rows).agg(F.max("_h").alias("_last"))
    kept = placed.join(F.broadcast(first), F.col("_h") <= F.col("_last")).drop("_last")
    return kept.groupBy("_h").agg(*[F.min(c).alias(c) for c in ("doc_id", "text", "label")]).drop("_h")
