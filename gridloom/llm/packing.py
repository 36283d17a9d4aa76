"""Best-fit packing of tokenized documents into sequences of bounded length, by bulk-synchronous rounds.

Documents are tokenized whole, closed with an end token, and cut into pieces only where
they exceed the capacity. Pieces of one length are interchangeable, so the rounds work on
*runs*: (length, first rank, count) for pieces and (free room, first sequence, count) for
gaps. A round range-sorts the runs by size over the tasks; each task sweeps its range from
large to small, handing every run of pieces its successors among the gaps - the smallest
that hold it -, resolves who gets which by rank, puts the shrunken gaps back and sweeps
again until nothing in its range fits. Rounds repeat over ever fewer, wider ranges, so that
pieces meet gaps of any size; when one range holds all and nothing fits, sequences are
opened for what remains. The runs of a capacity number at most a few for each length,
whatever the number of documents; no task or driver ever holds the pieces.

Pieces get their rank from counts by (length, task), and find their run through blocks of
ranks, so a length that a third of all pieces share spreads over many tasks.

Defined results: null and empty texts are the end token alone; repeated documents are
packed once each; null ids are packed as they are; an empty table gives an empty table;
other columns are ignored; very long texts are tokenized whole and cut into pieces.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.llm.common import CACHES, batches, discard, materialize, small_batches

CAPACITY = 4096
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
#: Ranks in a block, the unit in which pieces look for their run.
RANKS = 1 << 16
#: Runs for which one task is enough.
RUNS_A_TASK = 20_000
#: Fixed value: how this tokenizer splits normalized text into words.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII.
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")
#: Texts with special tokens, or characters that not all agree are white space, are encoded whole.
WHOLE = ("<|", "\x1c", "\x1d", "\x1e", "\x1f", "\x85")


def _unsettled() -> re.Pattern:
    """Code points that Unicode 3.2 left unassigned: libraries whose tables differ in age may class these differently."""
    old = unicodedata.ucd_3_2_0
    open_ = [c for c in range(0x100, sys.maxunicode + 1) if old.category(chr(c)) == "Cn"]
    starts = [c for i, c in enumerate(open_) if i == 0 or open_[i - 1] != c - 1]
    ends = [c for i, c in enumerate(open_) if i + 1 == len(open_) or open_[i + 1] != c + 1]
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True)) + "]")


def _is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
        return True
    except UnicodeEncodeError:
        return False


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    This tokenizer encodes each word of its normalized text by itself, and a word's last token
    is marked, so each word is encoded once, many in one call, and remembered."""

    LIMIT = 1 << 19
    TOGETHER = 4000

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer = self.tokenizer.normalizer
        self.known: dict[str, bytes] = {}
        self.unsettled = _unsettled()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _words(self, text: str) -> list[str]:
        if text.isascii():
            return SPLIT_ASCII.findall(text.lower())
        # Latin-1 is composed already, and lowered letter by letter.
        return SPLIT.findall(text.lower() if _is_latin(text) else self.normalizer.normalize_str(text))

    def _learn(self, words: list[str]) -> None:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        last = np.flatnonzero(self.ends[ids]) + 1
        if len(last) == len(words) and last[-1] == len(ids):
            data, begin = ids.tobytes(), 0
            for w, end in zip(words, (4 * last).tolist(), strict=True):
                self.known[w] = data[begin:end]
                begin = end
        else:
            for w in words:
                self.known[w] = self._ids(w)

    def _whole(self, text: str | None) -> bool:
        return bool(text) and (any(c in text for c in WHOLE) or not _is_latin(text) and self.unsettled.search(text) is not None)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        whole = [self._whole(t) for t in texts]
        words = [[] if w or not t else self._words(t) for t, w in zip(texts, whole, strict=True)]
        if len(self.known) > self.LIMIT:
            self.known.clear()
        known = self.known
        new = [w for w in set().union(*words) if w not in known]
        for a in range(0, len(new), self.TOGETHER):
            self._learn(new[a : a + self.TOGETHER])
        return [self._ids(t) if w else b"".join(map(known.__getitem__, own)) for t, w, own in zip(texts, whole, words, strict=True)]


@lru_cache(2)
def encoder(name: str) -> Encoder:
    """name: a file of the installed public tokenizers, or a path."""
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Encoder(name)


CACHES["packing"] = encoder.cache_clear


def _pieces(capacity: int, end_id: int, tokenizer: str):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = encoder(tokenizer), np.zeros(capacity + 1, np.int64)
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()
        for b in batches(it):
            rows = []
            for doc_id, ids in zip(b.column(0).to_pylist(), own.encode_all(b.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    n = len(cut) // 4
                    rows.append((doc_id, k, at // 4, n, zlib.crc32(cut), part, int(seen[n])))
                    seen[n] += 1
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """Pieces of every document; `nth` counts those of one length within a task (`part`)."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_pieces(capacity, end_id, tokenizer), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def sweep(docs: list[tuple[int, int, int]], gaps: list[tuple[int, int, int]]) -> tuple[list, list, list[tuple[int, int, int, int, int, int]]]:
    """One sweep. docs: (length, first rank, n); gaps: (room, first sequence, n).

    Returns what is left of both, and placements (length, first rank, n, first sequence, pieces a sequence, room before)."""
    docs = sorted(docs, key=lambda r: (-r[0], r[1]))
    gaps = sorted(gaps, key=lambda r: (-r[0], r[1]))
    stack: list[tuple[int, int, int]] = []
    left, shrunk, placed, g = [], [], [], 0
    for length, rank, n in docs:
        while g < len(gaps) and gaps[g][0] >= length:
            stack.append(gaps[g])
            g += 1
        while n and stack:
            room, first, m = stack.pop()
            each = room // length
            full = min(m, n // each)
            if full:
                placed.append((length, rank, full * each, first, each, room))
                shrunk.append((room - each * length, first, full))
                rank, n, first, m = rank + full * each, n - full * each, first + full, m - full
            if n and m:  # fewer than a sequence would take
                placed.append((length, rank, n, first, n, room))
                shrunk.append((room - n * length, first, 1))
                n, first, m = 0, first + 1, m - 1
            if m:
                stack.append((room, first, m))
        if n:
            left.append((length, rank, n))
    return left, [r for r in shrunk + stack + gaps[g:] if r[0]], placed


def settle(docs: list, gaps: list) -> tuple[list, list, list]:
    """Sweeps until nothing fits."""
    placed: list = []
    while docs and gaps:
        docs, gaps, new = sweep(docs, gaps)
        if not new:
            break
        placed += new
    return docs, gaps, placed


_STATE = "kind int, size long, first long, n long, seq long, each long, room long"
_DOC, _GAP, _PLACED = 0, 1, 2


def _round(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's range of runs; what it can place becomes rows of kind _PLACED."""
    frames = list(it)
    if not frames:
        return
    rows = pd.concat(frames)
    of = lambda kind: list(rows.loc[rows.kind == kind, ["size", "first", "n"]].itertuples(index=False, name=None))
    docs, gaps, placed = settle(of(_DOC), of(_GAP))
    out = [(_DOC, *r, 0, 0, 0) for r in docs] + [(_GAP, *r, 0, 0, 0) for r in gaps] + [(_PLACED, *r) for r in placed]
    yield pd.DataFrame(out, columns=["kind", "size", "first", "n", "seq", "each", "room"])


def plan(runs: DataFrame, capacity: int, runs_a_task: int = RUNS_A_TASK) -> DataFrame:
    """Placements (size, first, n, seq, each, room) for runs of pieces (size, n)."""
    spark = runs.sparkSession
    state = materialize(runs.select(F.lit(_DOC).alias("kind"), F.col("size").cast("long").alias("size"), F.lit(0).cast("long").alias("first"), "n", *[F.lit(0).cast("long").alias(c) for c in ("seq", "each", "room")]))
    done, opened, tasks = [], 0, 0
    while True:
        rest = state.groupBy("kind").agg(F.count("size").alias("runs"), F.sum(F.col("size") * F.col("n")).alias("tokens")).collect()
        docs = next((r for r in rest if r.kind == _DOC), None)
        if docs is None:
            break
        active = state.where(F.col("kind") != _PLACED)
        if tasks <= 1:  # all of it met in one range, and nothing fits: open sequences
            more = -(-int(docs.tokens) // capacity)
            active = active.unionByName(spark.createDataFrame([(_GAP, capacity, opened, more, 0, 0, 0)], _STATE))
            opened += more
            tasks = 1 + sum(r.runs for r in rest if r.kind != _PLACED) // runs_a_task
        else:
            tasks //= 2
        ranged = active.repartitionByRange(tasks, "size", "first") if tasks > 1 else active.coalesce(1)
        new = materialize(ranged.mapInPandas(_round, _STATE))
        done.append(materialize(new.where(F.col("kind") == _PLACED)))
        discard(state)
        state = new
    if not done:
        return state
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.where(F.col("kind") == _PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER, runs_a_task: int = RUNS_A_TASK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset for every piece."""
    rows = materialize(pieces(docs, capacity, end_id, tokenizer))
    by_part = rows.groupBy("length", "part").agg(F.count("nth").alias("n"))
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    by_part = materialize(by_part.withColumn("before", F.coalesce(before, F.lit(0))))
    placed = plan(by_part.groupBy(F.col("length").alias("size")).agg(F.sum("n").alias("n")), capacity, runs_a_task)
    ranked = rows.join(by_part.select("length", "part", "before").hint("merge"), ["length", "part"]).withColumn("rank", F.col("before") + F.col("nth"))
    ranked = ranked.withColumn("block", F.floor(F.col("rank") / RANKS))
    last = F.floor((F.col("first") + F.col("n") - 1) / RANKS)
    runs = placed.select(F.col("size").alias("length"), "first", "n", "seq", "each", "room", F.explode(F.sequence(F.floor(F.col("first") / RANKS), last)).alias("block"))
    found = ranked.join(runs.hint("merge"), (ranked["length"] == runs["length"]) & (ranked["block"] == runs["block"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n"))).drop(runs["length"])
    nth = F.col("rank") - F.col("first")
    offset = F.lit(capacity) - F.col("room") + nth % F.col("each") * F.col("length")
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("seq") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
