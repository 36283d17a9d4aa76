"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

1. One pass over whole texts turns each document into STATISTICS numbers; they are
   standardised with means and deviations over all documents.
2. cos(Wx + b) with Gaussian W approximates a Gaussian kernel over those numbers.
3. Each partition of labelled rows sums its normal equations (Z'Z, Z'y) for two folds;
   the sums are added in a tree and two small systems are solved on the driver. Their
   size is DIM squared, whatever the number of rows.
4. Scores of each fold under the other fold's weights, counted in BINS bins, are made
   monotone by pooling adjacent violators; that curve turns scores into probabilities.

Labels, language, source and id are never inputs of a score. Defined results: null text
counts as empty; empty texts have all statistics zero and a score like any other; rows
with a null id are scored but never learned from; repeated rows are scored once each;
without labelled rows of both classes every score is the mean label (0.5 if there is none);
very long texts are measured whole; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Words, batches, chunks, discard, forget, materialize, one_thread, raw, small_batches, windows

DIM = 256
#: Kernel width in units of the square root of the number of statistics.
WIDTH = 0.7
RIDGE = 1e-3
BINS = 2000
#: So many partial sums are added at each level of the tree that leads to the driver.
FAN = 64
SEED = 11

STATISTICS = (
    "log_words", "log_bytes", "word_length", "long_words", "distinct_words", "top_word", "same_as_before", "repeated_windows", "log_lines", "words_per_line",
    "repeated_lines", "lines_ended", "letters", "upper", "digits", "white", "symbols", "exclamations", "bars", "stops", "other_marks", "above_ascii", "byte_entropy",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256)
    out[list(chars)] = 1
    return out


_CLASSES = np.stack([
    _class(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + bytes(range(0xC2, 0xF5))), _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"0123456789"), _class(b" \t\n\r\x0b\x0c"),
    _class(b"#*$%&<>@^~=+_\\{}[]"), _class(b"!"), _class(b"|"), _class(b".,;:?"), _class(b"'\"()-/`"), _class(bytes(range(0x80, 0x100))),
], 1)


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    return np.concatenate([_statistics(texts[a:b]) for a, b in chunks(texts)]) if texts else np.zeros((0, len(STATISTICS)))


def _statistics(texts: list[bytes]) -> np.ndarray:
    words = Words(texts)
    out = np.zeros((len(texts), len(STATISTICS)))
    lengths = words.end - words.start
    for i, text in enumerate(texts):
        n_bytes = len(text)
        if not n_bytes:
            continue
        a, b = words.at[i], words.at[i + 1]
        n, ids = b - a, words.hash[a:b]
        counts = np.bincount(words.buf[words.text_start[i] : words.text_start[i] + n_bytes], minlength=256)
        lines = [x for x in text.split(b"\n") if x]
        row = out[i]
        row[0], row[1] = np.log1p(n), np.log1p(n_bytes)
        if n:
            size = lengths[a:b]
            ordered = np.sort(ids)
            steps = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            w = np.sort(windows(ids))
            row[2:8] = size.mean() / 10, (size > 12).mean(), (len(steps) - 1) / n, np.diff(steps).max() / n, (ids[1:] == ids[:-1]).sum() / n, (w[1:] == w[:-1]).sum() / n
        if lines:
            row[8:12] = np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
        row[12:22] = counts @ _CLASSES / n_bytes
        p = counts[counts > 0] / n_bytes
        row[22] = -(p * np.log2(p)).sum() / 8
    return out


def features(docs: DataFrame) -> DataFrame:
    """doc_id and `x`, array<double> of STATISTICS."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        for b in batches(it):
            x = statistics(raw(b.column(1)))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "x": flat})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, x array<float>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]  # of all rows, then of each fold's rows alone
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def lift(self, x: np.ndarray) -> np.ndarray:
        """Random Fourier features, with a constant."""
        rng = np.random.Generator(np.random.PCG64(SEED))
        d = x.shape[1]
        w, b = rng.normal(0, 1 / (WIDTH * np.sqrt(d)), (d, DIM - 1)), rng.uniform(0, 2 * np.pi, DIM - 1)
        z = np.sqrt(2 / (DIM - 1)) * np.cos(np.clip((x - self.mean) / self.scale, -8, 8) @ w + b)
        return np.concatenate([z, np.ones((len(z), 1))], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(x), self.prior)
        s = self.lift(x) @ self.weights[0]
        # The curve is flat where it pooled; a small slope keeps the order of scores within a flat part.
        return np.clip(0.99 * np.interp(s, *self.knots) + 0.01 * np.clip((s + 1) / 3, 0, 1), 0, 1)


def matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _sums(model: Model):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        total = np.zeros((2, DIM, DIM + 1))
        for b in batches(it):
            z, y, fold = model.lift(matrix(b.column(0))), np.asarray(b.column(1)), np.asarray(b.column(2))
            for f in (0, 1):
                own = z[fold == f]
                total[f] += own.T @ np.concatenate([own, y[fold == f][:, None]], 1)
        if total.any():
            yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId() // FAN], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    return run


def _add(pdf):
    import pandas as pd

    return pd.DataFrame({"k": pdf.k[:1], "sums": [sum(np.frombuffer(s) for s in pdf.sums).tobytes()]})


def pooled(level: np.ndarray, weight: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: block centres and their means."""
    blocks: list[list[float]] = []  # level * weight, weight, value * weight
    for x, w, v in zip(level, weight, value, strict=True):
        blocks.append([x * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    a = np.array(blocks)
    return a[:, 0] / a[:, 1], a[:, 2] / a[:, 1]


def fit(x: DataFrame, labels: DataFrame, train: Column) -> Model:
    """x: features(); labels: (doc_id, y) to learn from where `train` holds."""
    n = len(STATISTICS)
    stats = x.select(*[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(n)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(n)]).first()
    mean = np.array([stats[i] or 0.0 for i in range(n)])
    scale = np.array([max(stats[n + i] or 0.0, 1e-6) for i in range(n)])
    model = Model(mean, scale, [], (np.zeros(1), np.zeros(1)), 0.5)
    rows = x.join(labels.where(train).select("doc_id", F.col("y").cast("double").alias("y")).where("y is not null"), "doc_id")
    rows = rows.select("x", "y", ((F.crc32(F.col("doc_id").cast("string")) / 64).cast("long") % 2).cast("int").alias("fold"))
    sums = rows.mapInArrow(_sums(model), "k int, sums binary").groupBy("k").applyInPandas(_add, "k int, sums binary")
    parts = sums.groupBy(F.floor(F.col("k") / FAN).alias("up")).applyInPandas(_add, "k int, sums binary").collect()
    if not parts:
        return model
    total = sum(np.frombuffer(r.sums) for r in parts).reshape(2, DIM, DIM + 1)
    both = total.sum(0)
    count, positive = both[DIM - 1, DIM - 1], both[DIM - 1, DIM]
    model.prior = float(positive / count) if count else 0.5
    if not 0 < positive < count:
        return model

    def solve(s: np.ndarray) -> np.ndarray:
        return np.linalg.solve(s[:, :DIM] + RIDGE * max(1.0, s[DIM - 1, DIM - 1] / 100) * np.eye(DIM), s[:, DIM])

    model.weights = [solve(both), solve(total[0]), solve(total[1])]

    def binned(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        for b in batches(it):
            z, fold = model.lift(matrix(b.column(0))), np.asarray(b.column(2))
            s = np.where(fold == 0, z @ model.weights[2], z @ model.weights[1])
            bins = np.round((np.clip(s, -1, 2) + 1) / 3 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(bins), "y": b.column(1)})

    counts = rows.mapInArrow(binned, "bin int, y double").groupBy("bin").agg(F.count("y").alias("n"), F.avg("y").alias("y")).collect()
    counts.sort()
    model.knots = pooled(*(np.array(c, float) for c in zip(*[(r.bin / BINS * 3 - 1, r.n, r.y) for r in counts], strict=True)))
    return model


def score(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """doc_id and score for every document. labels: (doc_id, y); `train`: which of its rows to learn from."""
    x = materialize(features(docs))
    model = fit(x, labels, train)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        for b in batches(it):
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(model.score(matrix(b.column(1))))})

    return x.mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that are predicted good. labels: doc_id, quality."""
    x = materialize(features(docs))
    model = fit(x, labels.select("doc_id", F.col("quality").alias("y")), ~held_out())
    discard(x)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        for b in batches(it):
            yield b.filter(pa.array(model.score(statistics(raw(b.column(at)))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels has doc_id and quality."""
    known = labels.select("doc_id", F.col("quality").alias("y"))
    scored = score(docs, known, ~held_out())
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
