"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct words and the first PREFIX letters of each (insults in
inflected languages share a stem), hashed to BUCKETS. The machine scores
    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>
over the terms present, so that a pair such as an insult with a group mention can weigh
more than its parts. It is fitted on at most TRAIN_ROWS labelled rows (those with the
smallest hash of their id, so the same rows whatever the partitions; so many of either
class) by AdaGrad on the logistic loss; the bias is then set back from the sample's rate of
toxic rows to that of all labelled rows. Terms take part whose share among
toxic and other rows of that sample differs by SCREEN standard errors, and terms of a pair
whose rows differ by PAIR_SCREEN standard errors from what its two terms say each by itself: a
pair counts though its parts are neutral. Pairs are tested in blocks of terms, a task for each
two blocks, among terms in at least PAIR_SHARE of the sample; no list of pairs is made. The
others weigh nothing. The fitted weights, bounded by ACTIVE terms, go to every task.

Labels, language, source and id are never inputs of a score. Defined results: null and
empty texts have no terms and score as the bias alone; rows with a null id are scored
but never learned from; repeated rows are scored once each; without labelled rows of
both classes every score is the mean label (0 if there is none); very long texts are read whole;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import STEP, batches, discard, materialize, one_thread, raw, small_batches
from gridloom.llm.near_dedup import shingle_sets

BUCKETS = 1 << 20
PREFIX = 4
#: The documented bound of the training sample: so many rows of either class.
TRAIN_ROWS = 8000
SCREEN = 4.0
ACTIVE = 1 << 15
PAIR_SCREEN = 6.0
#: Rows of the sample that hold a term, as a share and at least, for it to be tested in pairs; and rows that hold a pair.
PAIR_SHARE = 0.005
PAIR_ROWS = 16
#: Terms in a block, and rows multiplied at a time.
PAIR_BLOCK = 1024
FACTORS = 8
EPOCHS = 40
BATCH = 256
RATE = 0.1
DECAY = 1e-4
WORD = re.compile(r"[^\W_]+")


class Terms(dict):
    """word -> its two buckets, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= 1 << 18:
            self.clear()
        stem = "^" + word[:PREFIX]
        out = self[word] = (xxhash.xxh3_64_intdigest(word) % BUCKETS, xxhash.xxh3_64_intdigest(stem) % BUCKETS)
        return out

    def of(self, text: str | None) -> set[int]:
        return {t for w in set(WORD.findall((text or "").lower())) for t in self[w]}


def ragged(lists: list) -> pa.Array:
    return pa.array([sorted(x) for x in lists], pa.list_(pa.int32()))


def _terms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for b in batches(it):
        sets = shingle_sets(raw(b.column(1)))
        # Rows with a least shingle in common are taken for copies, by either of two orders of the shingles.
        least = [[int(s.min()) >> 1, int((s * STEP[1]).min()) >> 1] if len(s) else [-1, -1] for s in sets]
        yield pa.RecordBatch.from_pydict({"h": b.column(0), "terms": ragged([terms.of(t) for t in b.column(1).to_pylist()]), "least": pa.array(least, pa.list_(pa.int64())), "y": b.column(2)})


@dataclass
class Machine:
    bias: float
    index: np.ndarray  # sorted active buckets
    w: np.ndarray
    v: np.ndarray

    def margin(self, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Scores of n rows, given pairs (row, position in index) with ascending rows."""
        out = np.full(n, self.bias)
        if len(at):
            starts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
            own = rows[starts]
            v = self.v[at]
            out[own] += np.add.reduceat(self.w[at], starts) + 0.5 * (np.add.reduceat(v, starts) ** 2 - np.add.reduceat(v * v, starts)).sum(1)
        return out


def _fit(index: np.ndarray, lists: list[np.ndarray], y: np.ndarray) -> Machine:
    """index: the active buckets in order; lists: the places in it of each row's terms."""
    n, positive = len(y), float(y.sum())
    if not 0 < positive < n:
        return Machine(20.0 if positive else -20.0, np.zeros(0, np.int32), np.zeros(0), np.zeros((0, FACTORS)))
    rate = positive / n
    at, rows = np.concatenate(lists), np.repeat(np.arange(n), [len(x) for x in lists])
    rng = np.random.Generator(np.random.PCG64(5))
    m = Machine(float(np.log(rate / (1 - rate))), index, np.zeros(len(index)), rng.normal(0, 0.01, (len(index), FACTORS)))
    edges = np.searchsorted(rows, np.arange(n + 1))
    gb, gw, gv = 1e-6, np.full(len(index), 1e-6), np.full((len(index), FACTORS), 1e-6)
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for begin in range(0, n, BATCH):
            own = order[begin : begin + BATCH]
            size = edges[own + 1] - edges[own]
            r = np.repeat(np.arange(len(own)), size)
            where = at[np.repeat(edges[own] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())]
            slope = (1 / (1 + np.exp(-np.clip(m.margin(r, where, len(own)), -30, 30))) - y[own]) / len(own) * 32
            g = slope.sum()
            gb += g * g
            m.bias -= RATE * g / np.sqrt(gb)
            if not len(where):
                continue
            v = m.v[where]
            total = np.stack([np.bincount(r, v[:, k], len(own)) for k in range(FACTORS)], 1)
            each = slope[r]
            change = each[:, None] * (total[r] - v)
            dw = np.bincount(where, each, len(index))
            dv = np.stack([np.bincount(where, change[:, k], len(index)) for k in range(FACTORS)], 1)
            on = np.unique(where)
            dw[on] += DECAY * m.w[on]
            dv[on] += DECAY * m.v[on]
            gw[on] += dw[on] ** 2
            gv[on] += dv[on] ** 2
            m.w[on] -= RATE * dw[on] / np.sqrt(gw[on])
            m.v[on] -= RATE * dv[on] / np.sqrt(gv[on])
    return m


def pair_terms(rows: list[np.ndarray], y: np.ndarray, d: int, i: int, j: int) -> np.ndarray:
    """Of two blocks of terms, those with a pair that says more than its parts. rows: places of the terms, below d, in each row."""
    n, rate = len(y), y.mean()
    starts = (i * PAIR_BLOCK, j * PAIR_BLOCK)
    sizes = [min(PAIR_BLOCK, d - s) for s in starts]
    count, toxic = np.zeros(sizes, np.float32), np.zeros(sizes, np.float32)
    df, sums = [np.zeros(m) for m in sizes], [np.zeros(m) for m in sizes]
    for at in range(0, n, PAIR_BLOCK):
        part, own = rows[at : at + PAIR_BLOCK], y[at : at + PAIR_BLOCK].astype(np.float32)
        x = []
        for k, (begin, m) in enumerate(zip(starts, sizes, strict=True)):
            dense = np.zeros((len(part), m), np.float32)
            flat = np.concatenate(part)
            of = np.repeat(np.arange(len(part)), [len(r) for r in part])
            here = (flat >= begin) & (flat < begin + m)
            dense[of[here], flat[here] - begin] = 1
            df[k] += dense.sum(0)
            sums[k] += own @ dense
            x.append(dense)
        count += x[0].T @ x[1]
        toxic += (x[0] * own[:, None]).T @ x[1]
    effect = [s / np.maximum(f, 1) - rate for f, s in zip(df, sums, strict=True)]
    expected = np.clip(rate + effect[0][:, None] + effect[1][None, :], 0, 1)
    z = np.abs(toxic - count * expected) / np.sqrt(count * rate * (1 - rate) + 0.5)
    good = (z >= PAIR_SCREEN) & (count >= PAIR_ROWS)
    if i == j:
        np.fill_diagonal(good, False)
    return np.unique(np.concatenate([np.flatnonzero(good.any(1)) + starts[0], np.flatnonzero(good.any(0)) + starts[1]]))


def paired(sample: DataFrame, frequent: np.ndarray, y_rate: float) -> np.ndarray:
    """Of the frequent terms, those that some pair shows. The sample is bounded, so its rows of frequent terms go to every task."""
    spark = sample.sparkSession
    if not len(frequent) or not 0 < y_rate < 1:
        return np.zeros(0, np.int32)
    got = sorted((r.h, tuple(r.least), bytes(r["at"]), r.y) for r in sample.mapInArrow(_places(frequent), _PLACED).collect())
    for k in (0, 1):
        got = list({least[k]: (h, least, x, y) for h, least, x, y in reversed(got)}.values())[::-1]
    shared = spark.sparkContext.broadcast(([np.frombuffer(x, np.int32) for *_, x, _ in got], np.array([y for *_, y in got], float)))
    d = len(frequent)
    blocks = -(-d // PAIR_BLOCK)
    two = [(i, j) for i in range(blocks) for j in range(i, blocks)]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches(it):
            for k in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(pair_terms(*shared.value, d, *two[k]).astype(np.int32))], ["t"])

    out = [r.t for r in spark.range(0, len(two), 1, len(two)).mapInArrow(run, "t int").distinct().collect()]
    return frequent[np.array(sorted(out), np.int64)]


def _places(index: np.ndarray):
    """The places in index, sorted, of each row's terms."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            out = [np.searchsorted(index, x[np.isin(x, index)]).astype(np.int32).tobytes() for x in (np.array(t, np.int32) for t in b.column(1).to_pylist())]
            yield pa.RecordBatch.from_pydict({"h": b.column(0), "least": b.column(2), "at": pa.array(out, pa.binary()), "y": b.column(3)})

    return run


_PLACED = "h long, least array<long>, at binary, y double"


def fit(docs: DataFrame, labels: DataFrame, train: Column) -> Machine:
    """labels: (doc_id, y) to learn from where `train` holds."""
    small_batches(docs.sparkSession)
    known = labels.where(train).select("doc_id", F.col("y").cast("double").alias("y")).where("y is not null and doc_id is not null")
    h = F.xxhash64("doc_id")
    # The bound is set on ids, before any text is read.
    chosen = known.where("y > 0.5").orderBy(h, "doc_id").limit(TRAIN_ROWS).unionByName(known.where("y <= 0.5").orderBy(h, "doc_id").limit(TRAIN_ROWS))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(h.alias("h"), "text", "y")  # at most 2 * TRAIN_ROWS rows of two numbers
    sample = materialize(rows.mapInArrow(_terms, "h long, terms array<int>, least array<long>, y double"))
    size = sample.agg(F.count("y").alias("n"), F.sum("y").alias("positive")).first()
    y_rate = (size.positive or 0.0) / max(size.n, 1)
    rate = F.lit(y_rate)
    seen = materialize(sample.select(F.explode("terms").alias("t"), "y").groupBy("t").agg(F.count("y").alias("df"), F.sum("y").alias("toxic")))
    z = F.abs((F.col("toxic") - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate) + 0.5))
    strong = [r.t for r in seen.where((F.col("df") >= 2) & (z >= SCREEN)).orderBy(z.desc(), "t").limit(ACTIVE).select("t").collect()]
    frequent = [r.t for r in seen.where(F.col("df") >= max(PAIR_ROWS, PAIR_SHARE * size.n)).select("t").collect()]
    index = np.union1d(np.array(strong, np.int32), paired(sample, np.array(sorted(frequent), np.int32), y_rate)).astype(np.int32)
    total = known.agg(F.count_if(F.col("y") > 0.5).alias("toxic"), F.count_if(F.col("y") <= 0.5).alias("other")).first()
    got = sorted((r.h, bytes(r["at"]), r.y) for r in sample.mapInArrow(_places(index), _PLACED).collect())
    discard(sample)
    discard(seen)
    m = _fit(index, [np.frombuffer(x, np.int32) for _, x, _ in got], np.array([y for *_, y in got], float))
    # A class of which only one row in n was taken stands n times too low in the odds.
    m.bias += np.log(max(1.0, total.toxic / TRAIN_ROWS)) - np.log(max(1.0, total.other / TRAIN_ROWS))
    return m


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, words = shared.value, {}
        lookup = dict(zip(m.index.tolist(), range(len(m.index)), strict=True))
        terms = Terms()
        for b in batches(it):
            rows, at = [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                found: set[int] = set()
                for w in set(WORD.findall((text or "").lower())):
                    hit = words.get(w)
                    if hit is None:
                        if len(words) >= 1 << 18:
                            words.clear()
                        hit = words[w] = tuple(lookup[t] for t in terms[w] if t in lookup)
                    found.update(hit)
                rows += [i] * len(found)
                at += sorted(found)
            s = 1 / (1 + np.exp(-np.clip(m.margin(np.array(rows, np.int64), np.array(at, np.int64), b.num_rows), -40, 40)))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "score": pa.array(s)})

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; labels has doc_id and toxic."""
    machine = fit(docs, labels.select("doc_id", F.col("toxic").alias("y")), ~held_out())
    return score(docs, machine).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
