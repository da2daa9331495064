"""Toxicity by subword-bag embeddings under a linear softmax.

A text is a bag of its words' character n-grams (3 to 5 bytes of UTF-8, word
ends marked), each hashed to a row of an embedding table; a word that occurs n
times counts as the root of n. The rows' mean, over NEUTRAL more rows of zeros,
goes through a linear softmax. Table and softmax are trained jointly in numpy, so
a misspelling or inflection never seen shares the vectors of its n-grams. Rows
the training never met stay zero and say nothing.

Training reads a bounded, documented sample: the labelled documents first in the
order of a hash, at most PER_CLASS of each class, of texts up to MOST_CHARS
long. One scan of the documents finds them, and one task trains: no text comes
to the driver, and a lost executor costs one more training. Scoring covers every
whole text. Since the softmax is linear, embedding and softmax fold into one
weight a row when scoring: 1 MB of floats for each class but the first, a fixed
size, sent to the executors. There is no shuffle in scoring.

Defined cases: null and empty texts have no n-grams and score by the bias
alone. Texts of any length are scored whole, in chunks of rows, one long text
alone. Labels that are null do not count; of several for a doc_id the greatest
does; of several texts for a doc_id training sees the least. Ties in the order of
the sample go by doc_id. Without labels of two classes every score is the
classes' share (a half without any label). Empty tables give no rows. Repeated
rows each get a row; rows with a null doc_id are not held out. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_texts, frugal, pick
from .wordhash import buffers, chunks, lower_bytes, mix, span_hashes, word_spans

BUCKET_BITS = 18
NGRAMS = (3, 4, 5)
DIM = 8
PER_CLASS = {0: 3500, 1: 1400}
MOST_CHARS = 20_000
EPOCHS = 10
BATCH = 40
RATE = 0.6
GAIN = 40.0
#: N-grams that a bag holds besides the text's, which say nothing: a few words prove little.
NEUTRAL = 600.0
THRESHOLD = 0.3
CHUNK_BYTES = 2 << 20

_VALUES = lower_bytes()


def _grams(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: the buckets of all n-grams of the words with their ends marked, and the bounds of each word among them."""
    data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])]).astype(np.int64)
    value, inside = _VALUES[data], data != 32
    odd = np.uint64(0x9E3779B97F4A7C15)
    hashed, clean = value, np.ones(max(0, len(data) - 1), bool)
    for n in range(2, max(NGRAMS) + 1):
        m = len(data) - n + 1
        if m <= 0:
            break
        # clean: the bytes strictly between the ends are of one word.
        if n > 2:
            clean = clean[:m] & inside[n - 2 : n - 2 + m]
        hashed = hashed[:m] * odd + value[n - 1 : n - 1 + m]
        if n in NGRAMS:
            at = np.flatnonzero(clean)
            bucket = (mix(hashed[at] + np.uint64(n)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
            yield bucket, np.searchsorted(at, starts)


def _weighed_words(texts: pa.Array) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts, and for each text and distinct word of it: text, word, root of its count."""
    data, off = buffers(texts)
    starts, ends, counts = word_spans(data, off)
    h = span_hashes(data, starts, ends, _VALUES)
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    words = [raw[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
    pair, n = np.unique(np.repeat(np.arange(len(counts)), counts) * max(1, len(words)) + which, return_counts=True)
    return words, pair // max(1, len(words)), pair % max(1, len(words)), np.sqrt(n)


@dataclass
class Model:
    """Log odds of each class but the first against the first: weights of each bucket, and biases."""

    weight: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The classes' probabilities of each text, and its number of words."""
        words, text, word, much = _weighed_words(texts)
        k = self.weight.shape[1]
        total, count = np.zeros((len(words), k)), np.zeros(len(words))
        if words:
            for bucket, bounds in _grams(words):
                for j in range(k):
                    sums = np.concatenate([[0.0], np.cumsum(self.weight[bucket, j], dtype=np.float64)])
                    total[:, j] += sums[bounds[1:]] - sums[bounds[:-1]]
                count += np.diff(bounds)
        size = np.bincount(text, much * count[word], len(texts)) + NEUTRAL
        odds = np.zeros((len(texts), k + 1))
        for j in range(k):
            odds[:, j + 1] = self.bias[j] + GAIN * np.bincount(text, much * total[word, j], len(texts)) / size
        p = np.exp(odds - odds.max(1, keepdims=True))
        n_words = np.rint(np.bincount(text, much**2, len(texts))).astype(np.int64)
        return p / p.sum(1, keepdims=True), n_words

    def scores(self, texts: pa.Array) -> np.ndarray:
        """The probability of class 1."""
        return self.posteriors(texts)[0][:, 1]


def _bags(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets and shares of each text's bag, one after the other, and the bounds of the texts."""
    ids, shares, bounds = [], [], [0]
    for t in texts:
        words, _, word, much = _weighed_words(pa.array([t]))
        of_word = np.empty(len(words))
        of_word[word] = much
        parts = [(b[w[0] : w[-1]], np.repeat(of_word, np.diff(w))) for b, w in _grams(words)] if words else []
        found, which = np.unique(np.concatenate([b for b, _ in parts]), return_inverse=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        sums = np.bincount(which, np.concatenate([x for _, x in parts]), len(found)) if parts else np.zeros(0)
        ids.append(found.astype(np.int32))
        shares.append((sums / (sums.sum() + NEUTRAL)).astype(np.float32))
        bounds.append(bounds[-1] + len(found))
    # One list at a time: memory is short.
    every_id = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    del ids
    return every_id, np.concatenate(shares) if shares else np.zeros(0, np.float32), np.array(bounds)


def _odds(shares: np.ndarray) -> np.ndarray:
    logs = np.log(np.asarray(shares, float) + 1e-9)
    return logs[1:] - logs[0]


def train(texts: list[str], labels: np.ndarray, shares: list[float] | None = None, classes: int = 2, seed: int = 7) -> Model:
    """Embedding table and softmax, jointly, by Adagrad on the log loss.

    shares: of the classes where the model is used, if not those of the sample.
    """
    labels = np.asarray(labels, int)
    sampled = np.bincount(labels, minlength=classes) / max(1, len(labels))
    shares = sampled if shares is None else np.asarray(shares, float)
    if (sampled > 0).sum() < 2:
        return Model(np.zeros((1 << BUCKET_BITS, classes - 1), np.float32), _odds(shares))
    rng = np.random.default_rng(seed)
    ids, weights, bounds = _bags(texts)
    # Rows met in a few texts only would learn those texts by heart.
    few = np.bincount(ids, minlength=1 << BUCKET_BITS) < min(5, 1 + len(texts) // 400)
    weights[few[ids]] = 0
    table = np.zeros((1 << BUCKET_BITS, DIM), np.float32)
    table_seen = np.full((1 << BUCKET_BITS, 1), 1e-8, np.float32)
    soft = rng.choice([-1.0, 1.0], (DIM, classes)).astype(np.float32) / np.sqrt(DIM)
    soft -= soft.mean(1, keepdims=True)
    soft_seen = np.full((DIM, classes), 1e-2, np.float32)
    offset = np.log(sampled + 1e-9)
    for _ in range(EPOCHS):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), BATCH):
            rows = order[k : k + BATCH]
            n = bounds[rows + 1] - bounds[rows]
            item = np.repeat(np.arange(len(rows)), n)
            at = np.arange(len(item)) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n)
            b, x = ids[at], GAIN * weights[at]
            embed = np.stack([np.bincount(item, table[b, d] * x, len(rows)) for d in range(DIM)], 1)
            logits = embed @ soft + offset
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1
            p /= len(rows)
            d_soft, d_embed = embed.T @ p, p @ soft.T
            met, where = np.unique(b, return_inverse=True)
            d_table = np.stack([np.bincount(where, d_embed[item, d] * x, len(met)) for d in range(DIM)], 1)
            table_seen[met, 0] += (d_table**2).mean(1)
            table[met] -= RATE * d_table / np.sqrt(table_seen[met])
            soft_seen += d_soft**2
            soft -= RATE / 4 * d_soft / np.sqrt(soft_seen)
    return Model((table @ (soft[:, 1:] - soft[:, :1])).astype(np.float32), _odds(shares))


def held_out() -> F.Column:
    """True for documents whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, per_class: dict[int, int]) -> tuple[DataFrame, list[float]]:
    """(label, place, doc_id, text) to learn from, and the classes' shares among all labels.

    labels: (doc_id, label) of distinct documents. At most 2 * sum(per_class) rows, found by one scan of the documents.
    """
    counts = {r["label"]: r["n"] for r in labels.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(counts.values()))
    place = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(2**53)
    ids = None
    for c, n in per_class.items():
        # More ids than needed, since some of them may have no text here or a long one. The first by hash are picked
        # in two steps, so that the ordering sees about three times as many as are wanted and not all labels.
        near = labels.where((F.col("label") == c) & (place < min(1.0, 3 * n / max(1, counts.get(c, 0)) + 1e-6)))
        first = near.orderBy(place, "doc_id").limit(2 * n)
        ids = first if ids is None else ids.unionByName(first)
    texts = doc_texts(docs).where(F.length("text") <= MOST_CHARS)
    found = texts.join(F.broadcast(ids), "doc_id")  # at most 2 * sum(per_class) ids
    sample = found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return sample.select("label", place.alias("place"), "doc_id", "text"), [counts.get(c, 0) / total for c in per_class]


def _learn(batches: Iterator[pa.RecordBatch], per_class: dict[int, int], shares: list[float]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple[int, float, int, str]] = []
    for batch in batches:
        rows += zip(*[batch.column(c).to_pylist() for c in ("label", "place", "doc_id", "text")], strict=True)
    rows.sort()
    left, texts, classes = dict(per_class), [], []
    for label, _, _, text in rows:
        if left[label]:
            left[label] -= 1
            texts.append(text)
            classes.append(label)
    del rows
    model = train(texts, np.array(classes, int), shares, len(per_class))
    yield pa.record_batch([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary())], names=["weight", "bias"])


def trained(docs: DataFrame, labels: DataFrame, per_class: dict[int, int]) -> Model:
    """The model of the sample, trained in one task; its weights, of a fixed size, come to the driver."""
    sample, shares = training_sample(docs, labels, per_class)
    found = sample.repartition(1).mapInArrow(lambda it: frugal(_learn(it, per_class, shares)), "weight binary, bias binary").collect()
    if not found:  # no sample, no task
        return train([], np.zeros(0, int), shares, len(per_class))
    weight, bias = np.frombuffer(found[0]["weight"], np.float32), np.frombuffer(found[0]["bias"], np.float64)
    return Model(weight.reshape(1 << BUCKET_BITS, -1), bias)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """The model of a 0/1 column of labels, learned from the rows that are not held out."""
    rows = pick(labels, "doc_id", label).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = rows.where("doc_id IS NOT NULL AND label IN (0, 1)").where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return trained(docs, known, PER_CLASS)


def _score(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch, "text", CHUNK_BYTES):
            scores = model.scores(chunk.column("text"))
            yield pa.record_batch([chunk.column("doc_id"), chunk.column("held_out"), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels, label)
    scored = doc_texts(docs).withColumn("held_out", held_out()).mapInArrow(lambda it: frugal(_score(it, model)), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _keep(batches: Iterator[pa.RecordBatch], model: Model, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in chunks(batch, column, CHUNK_BYTES):
            stay = model.scores(chunk.column(column)) < THRESHOLD
            yield chunk.filter(pa.array(stay))


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """The documents that are not predicted toxic, all their columns."""
    model = fit(docs, labels, label)
    # Positions for names: Arrow batches may not hold names that differ in case only.
    names = [f"_c{i}" for i in range(len(docs.columns))]
    flat = docs.toDF(*names).withColumn("_scored", F.coalesce(F.col(names[docs.columns.index("text")]), F.lit("")))
    kept = flat.mapInArrow(lambda it: frugal(_keep(it, model, "_scored")), flat.schema)
    return kept.select(*names).toDF(*docs.columns)
