"""Quality classifier: n-gram indicators scaled by naive Bayes log-count ratios, then a linear hinge-loss model.

Indicators of a text: its words and word pairs, and runs of one to three word shapes.
A shape keeps the kinds of characters of a word (capitals, other letters, digits,
each other character) without repetition, and tells whether the word repeats the
one before. All are hashed to a fixed number of features. The model is fitted on a
bounded sample of labelled rows, TRAIN_ROWS by default, by dual coordinate
descent; margins of held-out folds give the sigmoid that turns margins to scores.
Scoring is one pass over whole texts; the weights it sends have a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import seeded_order
from auditloom.llm.words import hash_words, mix64, text_buffers

FEATURES = 1 << 18
#: Labelled rows that the model is fitted on at most, the first by a seeded digest.
TRAIN_ROWS = 8000
SEED = 41
FOLDS = 3
EPOCHS = 12
COST = 1.0
SMOOTHING = 1.0
THRESHOLD = 0.7
HELD_OUT = 2
SLICE_BYTES = 1 << 19
_U = np.uint64


def _raw_values() -> np.ndarray:
    values = mix64(np.arange(1001, 1257, dtype=np.uint64)) | _U(1)
    values[[0x20, *range(0x09, 0x0E)]] = 0
    return values


RAW = _raw_values()
_KIND = np.arange(256, dtype=np.uint8)
_KIND[65:91], _KIND[97:123], _KIND[128:], _KIND[48:58] = 65, 97, 97, 48


def indicators(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, features, owners) of runs of rows: sorted distinct features of each row, end to end."""
    data, offsets = text_buffers(texts)
    row, n = 0, len(texts)
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + SLICE_BYTES, side="right")) - 1)
        part = offsets[row : end + 1]
        yield row, end, *_slice_features(data[part[0] : part[-1]], part - part[0])
        row = end


def _slice_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words, at = hash_words(data, offsets, RAW)
    kinds = _KIND[data]
    keep = np.ones(len(data), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | (RAW[data[1:]] == 0)
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    kept = np.concatenate([[0], np.cumsum(keep)])
    shapes, _ = hash_words(kinds[keep], kept[offsets], RAW)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    shapes = mix64(shapes + again.astype(np.uint64))
    grams, owners = [mix64(words + _U(11))], [owner]
    for base, sizes, salt in ((words, (2,), 22), (shapes, (1, 2, 3), 33)):
        for size in sizes:
            m = max(len(base) - size + 1, 0)
            out = base[:m].copy()
            for k in range(1, size):
                out = mix64(out * _U(0x9E3779B97F4A7C15) + base[k : m + k])
            inside = owner[:m] == owner[size - 1 : size - 1 + m]
            grams.append(mix64(out + _U(salt + size))[inside])
            owners.append(owner[:m][inside])
    feature = (np.concatenate(grams) >> _U(46)).astype(np.int64)  # 18 bits
    keys = np.unique(np.concatenate(owners) * FEATURES + feature)
    return keys % FEATURES, keys // FEATURES


class Model:
    """weights over features (log-count ratios taken in), bias, and the sigmoid's slope and shift."""

    def __init__(self, ratio, weights, bias, slope, shift):
        self.ratio, self.plain, self.bias, self.slope, self.shift = ratio, weights, float(bias), slope, shift
        self.ratio2, self.weights = ratio**2, ratio * weights

    def scores(self, features: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
        return scores_of((self.ratio2, self.weights, self.bias, self.slope, self.shift), features, owners, rows)


def scores_of(parts: tuple, features: np.ndarray, owners: np.ndarray, rows: int) -> np.ndarray:
    """Scores of rows by squared ratios, weights, bias, slope and shift."""
    ratio2, weights, bias, slope, shift = parts
    dot = np.bincount(owners, weights=weights[features], minlength=rows)
    norm = np.sqrt(np.bincount(owners, weights=ratio2[features], minlength=rows))
    margin = dot / np.where(norm > 0, norm, 1.0) + bias
    return 1 / (1 + np.exp(np.clip(-(slope * margin + shift), -500, 500)))


def _log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    counts = []
    for label in (1, 0):
        own = [r for r, y in zip(rows, labels) if y == label]
        c = np.bincount(np.concatenate(own), minlength=FEATURES) + SMOOTHING if own else np.full(FEATURES, SMOOTHING)
        counts.append(c / c.sum())
    return np.log(counts[0] / counts[1])


def _coordinate_descent(rows, values, labels, epochs=EPOCHS, cost=COST, seed=SEED):
    """Hinge loss with a bias: maximises the dual one row at a time within its box."""
    signs = np.where(labels == 1, 1.0, -1.0)
    share = np.array([max((labels == 0).sum(), 1), max((labels == 1).sum(), 1)])
    box = cost * len(labels) / (2 * share[labels])
    alpha, weights, bias = np.zeros(len(rows)), np.zeros(FEATURES), 0.0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            x, v, y = rows[i], values[i], signs[i]
            gradient = y * (weights[x] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / (v @ v + 1), 0.0), box[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                weights[x] += step * v
                bias += step
                alpha[i] = new
    return weights, bias


def _values(rows, ratio):
    out = []
    for r in rows:
        v = ratio[r]
        n = np.sqrt(v @ v)
        out.append(v / n if n > 0 else v)
    return out


def _sigmoid_fit(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of greatest likelihood, by damped Newton steps, with targets drawn in a little."""
    pos, neg = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x = np.stack([margins, np.ones_like(margins)], axis=1)
    beta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(np.clip(-x @ beta, -500, 500)))
        gradient = x.T @ (p - target) + 1e-6 * beta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """The model of labelled rows given as feature arrays; without rows of both labels it scores their share."""
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 1) / (len(labels) + 2)
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0, float(np.log(share / (1 - share))))
    margins = np.zeros(len(rows))
    fold = np.random.default_rng(SEED).permutation(len(rows)) % FOLDS
    for f in range(FOLDS):
        kept = np.flatnonzero(fold != f)
        ratio = _log_count_ratio([rows[i] for i in kept], labels[kept])
        weights, bias = _coordinate_descent([rows[i] for i in kept], _values([rows[i] for i in kept], ratio), labels[kept])
        for i in np.flatnonzero(fold == f):
            v = _values([rows[i]], ratio)[0]
            margins[i] = weights[rows[i]] @ v + bias
    slope, shift = _sigmoid_fit(margins, labels)
    ratio = _log_count_ratio(rows, labels)
    weights, bias = _coordinate_descent(rows, _values(rows, ratio), labels)
    return Model(ratio, weights, bias, slope, shift)


def held_out():
    """The rows that fitting never sees; a null doc_id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % 4 == HELD_OUT


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fits on at most ``train_rows`` labelled documents outside the held-out fold.

    Labels that are null or not 0 or 1, and ids with both labels, are left out. Of rows that
    share an id the first by features counts. One task fits: it gets a row for each
    sampled id, of at most ``FEATURES`` numbers, and the driver gets the weights alone.
    """
    usable = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").groupBy("doc_id")
    usable = usable.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").where(~held_out())
    sample = usable.select("doc_id", "quality").orderBy(seeded_order(F.col("doc_id"), SEED), "doc_id").limit(train_rows)

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.select(["doc_id", "quality"])
            for first, end, features, owners in indicators(batch.column("text")):
                at = np.searchsorted(owners, np.arange(end - first + 1))
                rows = [features[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield from pa.Table.from_batches([known.slice(first, end - first)]).append_column("features", pa.array(rows, pa.binary())).to_batches()

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            rows += [np.frombuffer(r, np.int32) for r in batch.column("features").to_pylist()]
            labels += batch.column("quality").to_pylist()
        if rows:
            m = fit(rows, np.array(labels, dtype=np.int64))
            told = [[m.ratio.tobytes()], [m.plain.tobytes()], [m.bias], [m.slope], [m.shift]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in told], ["ratio", "weights", "bias", "slope", "shift"])

    kind = docs.select("doc_id").schema.simpleString()[len("struct<") : -1].split(":", 1)[1]
    labelled = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", F.col("quality").cast("int").alias("quality"), "text")
    each = labelled.mapInArrow(featurize, f"doc_id {kind}, quality int, features binary").groupBy("doc_id", "quality").agg(F.min("features").alias("features"))
    ordered = each.select("quality", "features").repartition(1).sortWithinPartitions("quality", "features")
    got = ordered.mapInArrow(fitted, "ratio binary, weights binary, bias double, slope double, shift double").collect()
    if not got:
        return fit([], np.zeros(0, np.int64))
    r = got[0]
    return Model(np.frombuffer(r.ratio), np.frombuffer(r.weights), r.bias, r.slope, r.shift)


def score(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) with score and predicted of every row; null and empty texts score the bias.

    Repeated and null ids give a row each; other columns are not read. No rows: no rows.
    """
    keep = keep or ["doc_id"]
    sent = docs.sparkSession.sparkContext.broadcast((model.ratio2, model.weights, model.bias, model.slope, model.shift))
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = batch.select(keep)
            for first, end, features, owners in indicators(batch.column("text")):
                scores = scores_of(sent.value, features, owners, end - first)
                part = pa.Table.from_batches([kept.slice(first, end - first)]).append_column("score", pa.array(scores))
                yield from part.append_column("predicted", pa.array((scores >= THRESHOLD).astype(np.int32))).to_batches()

    return docs.select("text", *[c for c in keep if c != "text"]).mapInArrow(give, schema)


def accepted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of ``docs``, in its columns, that the classifier accepts."""
    model = train(docs, labels, train_rows)
    packed = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))
    return score(packed, model, ["__row"]).where("predicted = 1").select("__row.*")
