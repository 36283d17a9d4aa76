"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed terms, counted over all documents, give TF-IDF weights.
2. Every text is read as passages of 2 * BLOCK words, half overlapping. A randomised SVD of
   all passages - those of the benchmark weighted up, so that its vocabulary is not drowned -
   is made in one distributed pass: tasks add up A'(A W) for a Gaussian W over the terms of
   the benchmark (through A'A where that is small), the sums meet in a tree, and the small
   factors (Nystroem form) are solved on the driver. Their size depends on the benchmark and
   RANK, not on the corpus.
3. All passages and items meet in the latent space; pairs of cosine COSINE or more of which the
   passage holds enough of the item are candidates. The passage's norm counts all its terms,
   also those that no item has. Items of which the basis keeps less than KEPT - any number of
   them, once there are more items than RANK - also meet the passages term by term, with the
   exact products in place of the latent ones, so that no candidate hangs on the rank.
4. A candidate is a leak if the longest common subsequence of item and passage, weighted by
   rarity, holds VERBATIM of the item; or PARAPHRASE of it when the answer check agrees too:
   ANSWER of the item's rarest quarter of words stand in the passage.

Defined results: null and empty texts have no passages and never leak; items without words
are never found; repeated rows of either table give their pairs once; rows with null ids are
ignored; very long texts are passages like any others, a few thousand at a time; empty tables give
no pairs; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Words, batches, chunks, forget, one_thread, raw, small_batches

BUCKETS_LOG2 = 18
BLOCK = 24
RANK = 256
OVERSAMPLE = 16
#: Terms of more than this share of all items weigh nothing in the search.
COMMON = 0.05
#: Up to so many terms a task adds up A'A itself, which takes fewer steps than A'(A W) and gives the same.
SQUARE = 6000
#: A candidate: cosine, and the share of the item's squared weight that the passage holds.
COSINE = 0.2
HELD = 0.3
#: Items of which the basis keeps a smaller share of the squared weight are also looked up exactly.
KEPT = 0.9
#: Products of passages and items held at once.
PRODUCTS = 1 << 22
VERBATIM = 0.75
PARAPHRASE = 0.5
ANSWER = 0.6
#: Partial sums added at each level of the tree.
FAN = 16
#: Bytes of items that are fitted, sent to the tasks and searched together; a larger benchmark goes in several such blocks.
ITEM_BYTES = 16 << 20
#: Tokens projected at once.
TOKENS = 1 << 15

#: Lower case, with ASCII punctuation as space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))


def fold(text: bytes) -> bytes:
    return (text if text.isascii() else text.decode("utf-8", "replace").lower().encode()).translate(_FOLD)


class Passages:
    """Words of several texts and the blocks of BLOCK words they fall into; a passage is two blocks of one text."""

    def __init__(self, texts: list[bytes]):
        words = Words([fold(t) for t in texts])
        self.hash, self.at = words.hash, words.at
        self.term = (self.hash >> np.uint64(64 - BUCKETS_LOG2)).astype(np.int64)
        n = np.diff(self.at)
        self.text = np.repeat(np.arange(len(texts)), n)
        blocks = -(-n // BLOCK)
        first = np.concatenate([[0], np.cumsum(blocks)])
        self.block = first[:-1][self.text] + (np.arange(len(self.text)) - self.at[:-1][self.text]) // BLOCK
        self.n_blocks = int(first[-1])
        self.block_text = np.repeat(np.arange(len(texts)), blocks)
        self.block_start = np.searchsorted(self.block, np.arange(self.n_blocks + 1))
        # A passage begins at every block but the last of a text; a text of one block is one passage.
        last = np.zeros(self.n_blocks, bool)
        last[first[1:][blocks > 0] - 1] = True
        alone = last.copy()
        alone[1:] &= self.block_text[1:] != self.block_text[:-1]
        self.passage = np.flatnonzero(~last | alone)
        self.pair = np.where(last[self.passage], self.passage, self.passage + 1)

    def sums(self, values: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Sum of values (ordered by block) for each passage."""
        out = np.zeros((self.n_blocks, *values.shape[1:]), values.dtype)
        if len(values):
            new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            out[block[new]] = np.add.reduceat(values, new)
        return self.of_passages(out)

    def of_passages(self, by_block: np.ndarray) -> np.ndarray:
        out = by_block[self.passage]
        two = self.pair != self.passage
        out[two] += by_block[self.pair[two]]
        return out


def tree_sum(parts: DataFrame, tasks: int) -> np.ndarray | None:
    """The sum of `sums` (float32 vectors, one row a task) by levels of FAN rows."""

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(pdf.sums.iloc[0], np.float32).copy()
        for s in pdf.sums.iloc[1:]:
            total += np.frombuffer(s, np.float32)
        return pd.DataFrame({"k": pdf.k.iloc[:1] // FAN, "sums": [total.tobytes()]})

    while tasks > FAN:
        parts = parts.groupBy(F.floor(F.col("k") / FAN).alias("up")).applyInPandas(add, "k int, sums binary")
        tasks = -(-tasks // FAN)
    total = None
    for row in parts.toLocalIterator():
        x = np.frombuffer(row.sums, np.float32)
        total = x.copy() if total is None else total + x
    return total


def _one(total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId()], pa.int32()), "sums": pa.array([np.asarray(total, np.float32).tobytes()], pa.binary())})


def _counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n = np.zeros(1 << BUCKETS_LOG2, np.int64), 0
    for b in batches(it):
        texts = raw(b.column(0))
        for a, z in chunks(texts):
            p = Passages(texts[a:z])
            pairs = np.unique(p.text << BUCKETS_LOG2 | p.term)
            df += np.bincount(pairs & ((1 << BUCKETS_LOG2) - 1), minlength=len(df))
            n += z - a
    yield _one(np.concatenate([df, [n]]))


class Retrieval:
    """Weights, the benchmark's items and, once solved, the latent basis."""

    def __init__(self, idf: np.ndarray, items: list[tuple[int, bytes]]):
        self.idf = idf.astype(np.float32)
        self.items = [(i, t) for i, t in items if fold(t).split()]
        self.ids = np.array([i for i, _ in self.items], np.int64)
        p = self.passages = Passages([t for _, t in self.items])
        self.words = [p.hash[a:b] for a, b in zip(p.at[:-1], p.at[1:], strict=True)]
        self.weights = [self.idf[p.term[a:b]] for a, b in zip(p.at[:-1], p.at[1:], strict=True)]
        # Terms of many items tell no item from another and weigh nothing in the search; the checks count them.
        of_items = np.bincount(np.unique(p.text << BUCKETS_LOG2 | p.term) & (len(idf) - 1), minlength=len(idf))
        often = of_items > max(2, COMMON * len(self.items))
        few = np.bincount(p.text, weights=~often[p.term], minlength=len(self.items)) < 4
        often[np.unique(p.term[few[p.text]])] = False
        self.weight = np.where(often, 0, self.idf).astype(np.float32)
        self.vocabulary = np.unique(p.term[~often[p.term]])
        self.place = np.full(1 << BUCKETS_LOG2, -1, np.int32)
        self.place[self.vocabulary] = np.arange(len(self.vocabulary))
        self.basis: np.ndarray | None = None

    def projected(self, p: Passages, basis: np.ndarray, alive: np.ndarray | None = None) -> np.ndarray:
        """Latent coordinates of each passage: the sum of its weighted terms' rows. alive: the blocks that matter."""
        basis = basis * self.weight[self.vocabulary][:, None]
        out = np.zeros((p.n_blocks, basis.shape[1]), np.float32)
        b = 0
        while b < p.n_blocks:
            e = max(b + 1, int(np.searchsorted(p.block_start, p.block_start[b] + TOKENS, "right")) - 1)
            term = p.term[p.block_start[b] : p.block_start[e]]
            row = self.place[term]
            known = row >= 0
            if alive is not None:
                known &= alive[p.block[p.block_start[b] : p.block_start[e]]]
            known = np.flatnonzero(known)
            if len(known):
                block = p.block[p.block_start[b] : p.block_start[e]][known]
                new = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                out[block[new]] = np.add.reduceat(basis[row[known]], new)
            b = e
        return p.of_passages(out)

    def norms(self, p: Passages) -> np.ndarray:
        return np.sqrt(np.maximum(p.sums(self.weight[p.term] ** 2, p.block), 1e-12))

    def gram(self, p: Passages, omega: np.ndarray, total: np.ndarray, weight: float = 1.0) -> None:
        """total += A'(A omega) over unit passages, terms of the benchmark only."""
        y = self.projected(p, omega) / self.norms(p)[:, None] ** 2 * np.float32(weight)
        # Each block of a passage spreads the passage's row to its terms.
        by_block = np.zeros((p.n_blocks, omega.shape[1]), np.float32)
        by_block[p.passage] += y
        two = p.pair != p.passage
        by_block[p.pair[two]] += y[two]
        row = self.place[p.term]
        known = np.flatnonzero(row >= 0)
        known = known[np.argsort(row[known], kind="stable")]
        for a in range(0, len(known), TOKENS):
            own = known[a : a + TOKENS]
            r = row[own]
            new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            total[r[new]] += np.add.reduceat(by_block[p.block[own]] * self.weight[p.term[own]][:, None], new)

    def squared(self, p: Passages, total: np.ndarray) -> None:
        """total += the part above the diagonal, and half the diagonal, of A'A over unit passages; of any two terms, either way round."""
        row = self.place[p.term]
        known = np.concatenate([[0], np.cumsum(row >= 0)])
        row = row[row >= 0].astype(np.int64)
        x = self.weight[self.vocabulary[row]]
        first, size = known[p.block_start[p.passage]], known[p.block_start[p.pair + 1]] - known[p.block_start[p.passage]]
        scale, flat = 1 / self.norms(p) ** 2, total.reshape(-1)
        for n in np.unique(size[size > 0]).tolist():
            i, j = np.triu_indices(n)
            half = np.where(i == j, np.float32(0.5), np.float32(1))
            own = np.flatnonzero(size == n)
            for a in range(0, len(own), max(1, TOKENS * 8 // len(i))):
                some = own[a : a + max(1, TOKENS * 8 // len(i))]
                at = first[some][:, None] + np.arange(n)
                r, w = row[at], x[at]
                np.add.at(flat, (r[:, i] * len(total) + r[:, j]).ravel(), (w[:, i] * w[:, j] * half * scale[some][:, None]).ravel().astype(np.float32))

    def solve(self, y: np.ndarray, omega: np.ndarray) -> None:
        """Right singular vectors from one pass: C ~ Y (W'Y)^-1 Y'."""
        y, omega = y.astype(np.float64), omega.astype(np.float64)
        shift = 1e-7 * np.linalg.norm(y)
        y = y + shift * omega
        core = omega.T @ y
        values, vectors = np.linalg.eigh((core + core.T) / 2)
        good = values > values.max() * 1e-10
        u, s, _ = np.linalg.svd((y @ vectors[:, good]) / np.sqrt(values[good]), full_matrices=False)
        self.singular = np.sqrt(np.maximum(s**2 - shift, 0))[:RANK]
        self.basis = np.ascontiguousarray(u[:, :RANK], np.float32)
        self.item_norms = self.norms(self.passages)
        self.item_rows = self.projected(self.passages, self.basis) / self.item_norms[:, None]
        pairs, n = np.unique(self.passages.text << BUCKETS_LOG2 | self.passages.term, return_counts=True)
        self.most = np.zeros(len(self.weight), np.float32)  # what one occurrence of a term can add to a product with an item
        np.maximum.at(self.most, pairs & (len(self.weight) - 1), n)
        self.most *= self.weight**2
        self.item_of = self.passages.block_text[self.passages.passage]
        self.poor = np.flatnonzero((self.item_rows**2).sum(1) < KEPT)
        self.index_terms()

    def index_terms(self) -> None:
        """For each term of the vocabulary, the poorly kept item passages (places in `poor`) that have it, and what one occurrence adds to their product."""
        p, n = self.passages, len(self.vocabulary)
        a, z = p.block_start[p.passage[self.poor]], p.block_start[p.pair[self.poor] + 1]
        row = np.concatenate([np.empty(0, np.int64), *(self.place[p.term[x:y]] for x, y in zip(a, z, strict=True))]).astype(np.int64)
        own = np.repeat(np.arange(len(self.poor)), z - a)[row >= 0]
        row = row[row >= 0]
        pairs, count = np.unique(row * max(1, len(self.poor)) + own, return_counts=True)
        row, self.posted = np.divmod(pairs, max(1, len(self.poor)))
        self.adds = count * self.weight[self.vocabulary[row]].astype(np.float64) ** 2
        self.posts = np.searchsorted(row, np.arange(n + 1))

    def exact(self, p: Passages, which: np.ndarray) -> np.ndarray:
        """Products of the passages `which` with the poorly kept item passages, without the basis."""
        first, size = p.block_start[p.passage[which]], p.block_start[p.pair[which] + 1] - p.block_start[p.passage[which]]
        edge = np.cumsum(size) - size
        row = self.place[p.term[np.repeat(first - edge, size) + np.arange(size.sum())]]
        own, row = np.repeat(np.arange(len(which)), size)[row >= 0], row[row >= 0]
        out, many = np.zeros(len(which) * len(self.poor)), self.posts[row + 1] - self.posts[row]
        done = np.concatenate([[0], np.cumsum(many)])
        a = 0
        while a < len(row):
            z = max(a + 1, int(np.searchsorted(done, done[a] + PRODUCTS, "right")) - 1)
            at = np.repeat(self.posts[row[a:z]] - (done[a:z] - done[a]), many[a:z]) + np.arange(done[z] - done[a])
            np.add.at(out, np.repeat(own[a:z], many[a:z]) * len(self.poor) + self.posted[at], self.adds[at])
            a = z
        return out.reshape(len(which), len(self.poor))

    def candidates(self, p: Passages, passing: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(passage, item passage, cosine); rows: latent coordinates of the passages."""
        norms, step = self.norms(p), max(1, PRODUCTS // len(self.item_norms))
        for a in range(0, len(passing), step):
            own = passing[a : a + step]
            size = norms[own][:, None]
            cosine = rows[own] @ self.item_rows.T / size
            if len(self.poor):
                exact = self.exact(p, own) / (size * self.item_norms[self.poor])
                cosine[:, self.poor] = np.maximum(cosine[:, self.poor], exact)
            which, item = np.nonzero((cosine >= COSINE) & (cosine * (size / self.item_norms) >= HELD))
            yield from zip(own[which].tolist(), item.tolist(), cosine[which, item].tolist(), strict=True)

    def leaks(self, texts: list[bytes]) -> Iterator[tuple[int, int, float, float, float]]:
        """(text, item, cosine, share of the common subsequence, share of the answer words)."""
        p = Passages(texts)
        # A passage whose known terms together weigh less than any item needs cannot be a candidate.
        mass = p.sums(self.most[p.term], p.block)
        passing = np.flatnonzero(mass >= HELD * self.item_norms.min() ** 2)
        if not len(passing):
            return
        alive = np.zeros(p.n_blocks, bool)
        alive[p.passage[passing]] = alive[p.pair[passing]] = True
        rows = self.projected(p, self.basis, alive)
        best: dict[tuple[int, int], tuple] = {}
        for w, k, cosine in self.candidates(p, passing, rows):
            text, i = int(p.block_text[p.passage[w]]), int(self.item_of[k])
            margin = max(BLOCK, len(self.words[i]) - BLOCK)
            a = max(int(p.at[text]), int(p.block_start[p.passage[w]]) - margin)
            z = min(int(p.at[text + 1]), int(p.block_start[p.pair[w] + 1]) + margin)
            common, answer = self.check(i, p.hash[a:z])
            if common >= VERBATIM or common >= PARAPHRASE and answer >= ANSWER:
                found = (common, answer, cosine)
                best[text, i] = max(best.get((text, i), found), found)
        for (text, i), (common, answer, c) in best.items():
            yield text, int(self.ids[i]), c, common, answer

    def check(self, item: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of the item, by weight: in a common subsequence with the passage; of its rarest words, in the passage."""
        words, weights = self.words[item], self.weights[item]
        row = np.zeros(len(passage) + 1)
        present = np.isin(words, passage)
        if weights[present].sum() < PARAPHRASE * weights.sum():
            return 0.0, 0.0
        for w, x in zip(words[present], weights[present], strict=True):
            step = np.maximum(row[1:], row[:-1] + x * (passage == w))
            row[1:] = np.maximum.accumulate(step)
        rare = weights >= np.quantile(weights, 0.75)
        return float(row[-1] / max(weights.sum(), 1e-9)), float(present[rare].mean())


def retrieval(docs: DataFrame, benchmark: DataFrame) -> Retrieval | None:
    """Fit weights and basis over all documents. benchmark: (item_id, text), of some ITEM_BYTES at most."""
    small_batches(docs.sparkSession)
    items = sorted({(r.item_id, (r.text or "").encode()) for r in benchmark.select("item_id", "text").where("item_id is not null").collect()})
    texts = docs.select("text").where("text is not null")
    tasks = texts.rdd.getNumPartitions()
    counted = tree_sum(texts.mapInArrow(_counted, "k int, sums binary"), tasks)
    if counted is None:
        return None
    r = Retrieval(np.log((counted[-1] + 1) / (counted[:-1] + 0.5)), items)
    if not r.items:
        return None
    rng = np.random.Generator(np.random.PCG64(3))
    omega = rng.normal(0, 1, (len(r.vocabulary), min(RANK + OVERSAMPLE, len(r.vocabulary)))).astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((r, omega))

    def sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        own, w = shared.value
        square = len(w) <= SQUARE
        total, n = np.zeros((len(w), len(w) if square else w.shape[1]), np.float32), 0
        for b in batches(it):
            batch = raw(b.column(0))
            for a, z in chunks(batch):
                p = Passages(batch[a:z])
                if square:
                    own.squared(p, total)
                else:
                    own.gram(p, w, total)
                n += len(p.passage)
        if square:
            total = total @ w + total.T @ w
        yield _one(np.concatenate([total.ravel(), [n]]))

    sums = tree_sum(texts.mapInArrow(sketched, "k int, sums binary"), tasks)
    total = sums[:-1].reshape(omega.shape).astype(np.float32)
    # The benchmark's own passages weigh as much as the corpus together.
    r.gram(r.passages, omega, total, weight=max(1.0, float(sums[-1]) / max(1, len(r.passages.passage))))
    r.solve(total, omega)
    return r


def item_blocks(benchmark: DataFrame) -> list[DataFrame]:
    """The benchmark in blocks of items that fit a task; as a rule one."""
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // ITEM_BYTES)
    return [benchmark] if n <= 1 else [benchmark.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, common and answer of every leak."""
    return reduce(DataFrame.unionByName, [_leaks(docs, items) for items in item_blocks(benchmark)])


def _leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    schema = "doc_id long, item_id long, cosine double, common double, answer double"
    spark = docs.sparkSession
    r = retrieval(docs, benchmark)
    if r is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(r)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        own = shared.value
        for b in batches(it):
            ids, texts = b.column(0).to_pylist(), raw(b.column(1))
            rows = [(ids[a + t], *rest) for a, z in chunks(texts) for t, *rest in own.leaks(texts[a:z])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "cosine", "common", "answer"])

    found = docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, schema)
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("common").alias("common"), F.max("answer").alias("answer"))


def keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    for items in item_blocks(benchmark):
        docs = _keep(docs, items)
    return docs


def _keep(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    r = retrieval(docs, benchmark)
    if r is None:
        return docs
    shared, at = docs.sparkSession.sparkContext.broadcast(r), docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        forget()
        for b in batches(it):
            texts, clean = raw(b.column(at)), np.ones(b.num_rows, bool)
            for a, z in chunks(texts):
                clean[[a + t for t, *_ in shared.value.leaks(texts[a:z])]] = False
            yield b.filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)
