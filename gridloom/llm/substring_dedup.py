"""Repeated passages: every 50-byte string that a document with a smaller id holds too is removed.

The corpus lies in segments of some 1 MB of whole texts. Each gets arrays of its suffixes, in the
order of 128-bit fingerprints of a fixed-length prefix: equal prefixes meet, which is all that
matching at a fixed length needs, and an entry stays small where the prefix itself would be 50
bytes for each byte of text. The index is a logarithmic family of such arrays for each range of
fingerprints. Entries arrive in batches of ascending ids; a batch is sorted, merge-scanned against
the levels in place and answered, then becomes a level itself, and levels of like size merge. So
every match is with a smaller id, n entries have O(log n) levels, each moves O(log n) times, and
a task holds one entry for each distinct string and the batch in hand, however many copies there
are. Three families narrow the work:

  chunks   suffixes at content-defined cuts, with a prefix up to 49 bytes past the next cut.
           A chunk that a smaller id has too covers all strings that start in it. Whoever
           has the first copy of a string has it in a chunk that is *not* covered, so covered
           chunks need no further indexing.
  anchors  of the strings not yet covered, the smallest fingerprint of a 24-byte prefix inside.
           A string that recurs has an anchor that recurs; strings of lone anchors are done.
           Here the holder of the first copy hears of the second when that arrives.
  strings  all remaining 50-byte suffixes, with the smallest id that holds each.

A segment sends one entry for a prefix, so a passage that a third of all documents share has at
most one entry a segment, and no list of its holders is ever made.

Defined results: null and empty texts have no bytes and lose none; documents with the same
id never remove each other's bytes; a null id counts as larger than any other (and as equal
to 2**63 - 1); very long texts are segments of their own; repeated rows are reported once each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import STEP, batches, discard, group_ranges, materialize, mix, powers, prefix_hashes, raw, shared_dir, small_batches, whole_groups

LENGTH = 50
ANCHOR = 24
#: Cuts fall at one in so many positions.
CUT = 64
SEGMENT_BYTES = 1 << 20
#: Text bytes for one range of fingerprints.
RANGE_BYTES = 8 << 20
LAST = np.iinfo(np.int64).max
#: Batches of ascending ids, and the fewest entries that are scanned together.
BATCHES = 256
BATCH_ENTRIES = 1 << 16


def ordered(keys: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order by (key, check), and which entries in that order are new."""
    order = np.argsort(keys, kind="stable")
    k, c = keys[order], check[order]
    if not len(k):
        return order, np.zeros(0, bool)
    same = k[1:] == k[:-1]
    if (same & (c[1:] != c[:-1])).any():  # keys of 64 bits collide: all 128 decide
        order = np.lexsort((check, keys))
        k, c = keys[order], check[order]
        same = k[1:] == k[:-1]
    return order, np.concatenate([[True], ~same | (c[1:] != c[:-1])])


def find(keys: np.ndarray, check: np.ndarray, in_keys: np.ndarray, in_check: np.ndarray, most: int) -> np.ndarray:
    """Place of each (key, check) in sorted arrays, -1 where it is absent. most: the most entries there with one key."""
    out = np.full(len(keys), -1)
    if len(in_keys) and len(keys):
        at = np.searchsorted(in_keys, keys)
        for k in range(most):
            here = np.minimum(at + k, len(in_keys) - 1)
            hit = (in_keys[here] == keys) & (in_check[here] == check)
            out[hit] = here[hit]
    return out


def _most(keys: np.ndarray) -> int:
    """The most entries with one key in a sorted array: 1 unless fingerprints collide."""
    if len(keys) < 2 or (keys[1:] != keys[:-1]).all():
        return 1
    return int(np.diff(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))).max())


class Family:
    """Sorted arrays (key, check, value, told) of distinct entries, whose sizes grow geometrically."""

    def __init__(self):
        self.levels: list[list] = []

    def add(self, *arrays: np.ndarray) -> None:
        """A batch, sorted, of entries that no level holds, as the newest level."""
        self.levels.append([*arrays, _most(arrays[0])])
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self._merge()

    def _merge(self) -> None:
        two = [np.concatenate(x) for x in list(zip(*self.levels[-2:], strict=True))[:-1]]
        order, _ = ordered(two[0], two[1])  # two sorted runs: a merge
        two = [x[order] for x in two]
        self.levels[-2:] = [[*two, _most(two[0])]]

    def scan(self, keys: np.ndarray, check: np.ndarray) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
        """For each level: it, which keys it holds, and where."""
        for level in self.levels:
            at = find(keys, check, level[0], level[1], level[4])
            hit = at >= 0
            yield level, hit, at[hit]

    def lowest(self, keys: np.ndarray, check: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Answers a batch: the smallest id known for each entry, its own included, with those of all batches before; then adds it."""
        order, new = ordered(keys, check)
        first = np.flatnonzero(new)
        k, c = keys[order][first], check[order][first]
        low = np.minimum.reduceat(ids[order], first) if len(first) else np.zeros(0, np.int64)
        absent = np.ones(len(k), bool)
        for level, hit, at in self.scan(k, c):
            low[hit] = np.minimum(low[hit], level[2][at])
            absent[hit] = False
        self.add(k[absent], c[absent], low[absent], np.zeros(int(absent.sum()), bool))
        out = np.empty(len(keys), np.int64)
        out[order] = low[np.cumsum(new) - 1]
        return out

    def recurring(self, keys: np.ndarray, segs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Answers a batch: which entries others have too; and (segment, key) of earlier entries of which that was not known."""
        check = np.zeros(len(keys), np.uint64)
        order, new = ordered(keys, check)
        first = np.flatnonzero(new)
        k, s = keys[order][first], segs[order][first]
        many = np.diff(np.concatenate([first, [len(keys)]])) > 1
        absent = np.ones(len(k), bool)
        told_s, told_k = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for level, hit, at in self.scan(k, check[: len(k)]):
            untold = at[~level[3][at]]
            told_s.append(level[2][untold])
            told_k.append(level[0][untold])
            level[3][untold] = True
            many[hit] = True
            absent[hit] = False
        self.add(k[absent], check[: int(absent.sum())], s[absent], many[absent])
        out = np.empty(len(keys), bool)
        out[order] = many[np.cumsum(new) - 1]
        return out, np.concatenate(told_s), np.concatenate(told_k)


class Segment:
    """Texts of one batch, by ascending id, with the hashes that all steps need."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: bytes):
        self.ids, self.sizes, self.data = ids, sizes, data
        self.buf = np.frombuffer(data, np.uint8)
        n = len(self.buf)
        self.begin = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.acc, self.inverse = prefix_hashes(self.buf), powers(n + 1)[1]
        self.acc2, self.inverse2 = prefix_hashes(self.buf, 1), powers(n + 1, 1)[1]
        self.doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        #: Whether a string of LENGTH bytes starts here.
        self.valid = np.arange(n) + LENGTH <= self.begin[1:][self.doc] if n else np.zeros(0, bool)

    def hashed(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of 128 bits, as key and check."""
        size = (end - start).astype(np.uint64)
        return mix((self.acc[end] - self.acc[start]) * self.inverse[start] + size * STEP[2]), mix((self.acc2[end] - self.acc2[start]) * self.inverse2[start] + size * STEP[3])

    def grams(self) -> np.ndarray:
        """Hash of the ANCHOR bytes at each position that has so many."""
        n = len(self.buf) - ANCHOR + 1
        return mix((self.acc[ANCHOR:] - self.acc[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)

    def chunks(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the string starts of each chunk."""
        if not self.valid.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        starts = np.flatnonzero(self.valid)
        cut = (grams[starts] & np.uint64(CUT - 1)) == 0
        cut |= starts == self.begin[self.doc[starts]]
        at = starts[cut]
        last = self.begin[1:][self.doc[at]] - LENGTH + 1
        following = np.concatenate([at[1:], [len(self.buf)]])
        return at, np.minimum(following, last)

    def anchors(self, grams: np.ndarray) -> np.ndarray:
        """The smallest gram hash inside the string at each position, by two running minima over blocks."""
        w = LENGTH - ANCHOR + 1
        n = len(grams)
        pad = -n % w
        x = np.concatenate([grams, np.full(pad, 2**64 - 1, np.uint64)]).reshape(-1, w)
        ahead = np.minimum.accumulate(x, axis=1).ravel()
        back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def first_of(keys: np.ndarray, check: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct entries in order, the first document of each (docs ascend), whether several have it, and each entry's place."""
    order, new = ordered(keys, check)
    k, c, d = keys[order], check[order], docs[order]
    first = np.flatnonzero(new)
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    last = np.concatenate([first[1:], [len(k)]]) - 1 if len(first) else first
    return k[first], c[first], d[first], d[first] != d[last], place


def lowered(keys: np.ndarray, check: np.ndarray, low: np.ndarray, reply: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """low, where the reply has a smaller id."""
    r, c, v = reply
    at = find(keys, check, r, c, _most(r))
    return np.where(at >= 0, np.minimum(low, v[at]), low) if len(r) else low


class Steps:
    """What a segment sends to each family, given the replies of those before."""

    def __init__(self, segment: Segment):
        self.s = segment
        self.grams = segment.grams()
        self.start, self.end = segment.chunks(self.grams)

    def chunks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = self.s
        k, c, doc, _, self.chunk_place = first_of(*s.hashed(self.start, self.end + LENGTH - 1), s.doc[self.start])
        self.chunk_sent = k, c, s.ids[doc]
        return self.chunk_sent

    def open_(self, reply) -> np.ndarray:
        """Marks the starts of strings that no covered chunk holds."""
        s = self.s
        self.chunks()
        covered = lowered(*self.chunk_sent, reply)[self.chunk_place] < s.ids[s.doc[self.start]]
        edge = np.zeros(len(s.buf) + 1, np.int32)
        np.add.at(edge, self.start[covered], 1)
        np.add.at(edge, self.end[covered], -1)
        self.covered = np.cumsum(edge[:-1]) > 0
        return s.valid & ~self.covered

    def anchors(self, reply) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchors of open strings, and which of them several documents here have."""
        s = self.s
        where = np.flatnonzero(self.open_(reply))
        a = s.anchors(self.grams)[where] if len(where) else np.zeros(0, np.uint64)
        self.where, self.anchor = where, a
        doc = s.doc[where]
        run = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]) if len(a) else np.zeros(0, bool)
        keys, _, _, many, _ = first_of(a[run], np.zeros(int(run.sum()), np.uint64), doc[run])
        return keys, many

    def strings(self, reply, shared) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct open strings whose anchor recurs, with their smallest id."""
        s = self.s
        keys, many = self.anchors(reply)
        recurring = np.union1d(keys[many], shared)
        if len(recurring) and len(self.anchor):
            at = np.minimum(np.searchsorted(recurring, self.anchor), len(recurring) - 1)
            self.at = self.where[recurring[at] == self.anchor]
        else:
            self.at = np.zeros(0, np.int64)
        k, c, doc, _, self.string_place = first_of(*s.hashed(self.at, self.at + LENGTH), s.doc[self.at])
        self.string_sent = k, c, s.ids[doc]
        return self.string_sent

    def removed(self, reply, shared, found) -> np.ndarray:
        """Marks the bytes to remove."""
        s = self.s
        self.strings(reply, shared)
        hit = lowered(*self.string_sent, found)[self.string_place] < s.ids[s.doc[self.at]] if len(self.at) else np.zeros(0, bool)
        starts = self.covered.copy()
        starts[self.at[hit]] = True
        edge = np.zeros(len(s.buf) + LENGTH, np.int32)
        edge[: len(s.buf)] += starts
        edge[LENGTH:] -= starts
        return np.cumsum(edge)[: len(s.buf)] > 0


def _segments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, n, held, size = TaskContext.get().partitionId(), 0, [], 0

    def made() -> pa.RecordBatch:
        held.sort(key=lambda r: LAST if r[0] is None else r[0])
        ids = np.array([LAST if r[0] is None else r[0] for r in held], np.int64)
        nulls = bytes(r[0] is None for r in held)
        sizes = np.array([len(r[1]) for r in held], np.int64)
        text = zstandard.ZstdCompressor(level=7).compress(b"".join(r[1] for r in held))
        return pa.RecordBatch.from_pydict({"seg": pa.array([part << 32 | n], pa.int64()), "n_bytes": pa.array([int(sizes.sum())], pa.int64()), "ids": pa.array([ids.tobytes()], pa.binary()), "nulls": pa.array([nulls], pa.binary()), "sizes": pa.array([sizes.tobytes()], pa.binary()), "data": pa.array([text], pa.binary())})

    for b in batches(it):
        for doc_id, text in zip(b.column(0).to_pylist(), raw(b.column(1)), strict=True):
            if held and size + len(text) > SEGMENT_BYTES:
                yield made()
                n, size = n + 1, 0
                held.clear()
            held.append((doc_id, text))
            size += len(text)
    if held:
        yield made()


def _steps(row: dict) -> Steps:
    return Steps(Segment(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64), zstandard.ZstdDecompressor().decompress(row["data"])))


def _pairs(reply: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A segment's replies, gathered from all ranges, in order."""
    keys, check, low = (np.concatenate([np.zeros(0, kind), *(np.frombuffer(x[name], kind) for x in reply or [])]) for name, kind in (("keys", np.uint64), ("check", np.uint64), ("low", np.int64)))
    if not len(check):  # anchors
        return np.sort(keys), keys[:0], low
    order, _ = ordered(keys, check)
    return keys[order], check[order], low[order]


def _send(seg: int, keys: np.ndarray, check: np.ndarray, low: np.ndarray, ranges: int, bounds: np.ndarray) -> pa.RecordBatch:
    """Entries by range of fingerprints and by batch of ids."""
    of = ((keys >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    batch = np.searchsorted(bounds, low, side="right") if len(low) else np.zeros(len(keys), np.int64)
    where = of * (len(bounds) + 1) + batch
    if len(where) and (where[1:] < where[:-1]).any():
        order = np.argsort(where, kind="stable")
        keys, check, low, of, batch, where = (x[order] if len(x) else x for x in (keys, check, low, of, batch, where))
    cut = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])) if len(of) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(keys)]]) if len(cut) else cut
    parts = [pa.array([x[a:b].tobytes() for a, b in zip(cut, ends, strict=True)], pa.binary()) for x in (keys, check, low)]
    return pa.RecordBatch.from_arrays([pa.array(of[cut].astype(np.int32)), pa.array(batch[cut].astype(np.int32)), pa.array(np.full(len(cut), seg, np.int64)), *parts], ["lo", "batch", "seg", "keys", "check", "low"])


_SENT = "lo int, batch int, seg long, keys binary, check binary, low binary"


def _asked(step: str, ranges: int, bounds: np.ndarray):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint64)
        for b in batches(it):
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                x = _steps(row)
                if step == "chunks":
                    out = x.chunks()
                elif step == "anchors":
                    out = x.anchors(_pairs(row["r1"]))[0], none, none.view(np.int64)
                else:
                    out = x.strings(_pairs(row["r1"]), _pairs(row["r2"])[0])
                made = _send(row["seg"], *out, ranges, bounds)
                del x, row, out  # before the next segment is unpacked
                yield made

    return run


def _flat(t: pa.Table, name: str, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(t.column(name).to_pylist()), kind)


def _replied(segs: np.ndarray, keys: np.ndarray, check: np.ndarray, low: np.ndarray) -> pa.RecordBatch:
    """Answers by segment."""
    order = np.argsort(segs, kind="stable")
    segs = segs[order]
    cut = np.flatnonzero(np.concatenate([[True], segs[1:] != segs[:-1]])) if len(segs) else np.zeros(0, np.int64)
    ends = np.concatenate([cut[1:], [len(segs)]]).tolist() if len(cut) else []
    parts = [pa.array([x[a:b].tobytes() for a, b in zip(cut.tolist(), ends, strict=True)], pa.binary()) for x in (y[order] if len(y) else y for y in (keys, check, low))]
    return pa.RecordBatch.from_arrays([pa.array(segs[cut]), *parts], ["seg", "keys", "check", "low"])


def _answered(counting: bool):
    """Answers to the entries of whole ranges, batch after batch: the smallest id where it is smaller, or (counting) that another segment has the key too."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, lo = Family(), None
        # Batches of ids may be scanned together but never in parts; entries that are only counted may come in any parts.
        for t in whole_groups(it, 1 if counting else 2, rows=BATCH_ENTRIES, size=BATCH_ENTRIES * 24):
            for a, b in group_ranges(t, 1):
                if t.column("lo")[a].as_py() != lo:
                    family, lo = Family(), t.column("lo")[a].as_py()
                part = t.slice(a, b - a)
                keys = _flat(part, "keys", np.uint64)
                segs = np.repeat(part.column("seg").to_numpy(), [len(x) // 8 for x in part.column("keys").to_pylist()])
                if counting:
                    none = np.zeros(0, np.uint64)
                    many, told, told_keys = family.recurring(keys, segs)
                    yield _replied(np.concatenate([segs[many], told]), np.concatenate([keys[many], told_keys]), none, none)
                else:
                    check, ids = _flat(part, "check", np.uint64), _flat(part, "low", np.int64)
                    low = family.lowest(keys, check, ids)
                    hit = low < ids
                    yield _replied(segs[hit], keys[hit], check[hit], low[hit])

    return run


def _replies(sent: DataFrame, counting: bool, name: str) -> DataFrame:
    """(seg, name): a segment's replies from all ranges."""
    order = ["lo", "batch", "seg"]
    rows = materialize(sent.repartition("lo").sortWithinPartitions(*order).mapInArrow(_answered(counting), "seg long, keys binary, check binary, low binary"))
    out = rows.groupBy("seg").agg(F.collect_list(F.struct("keys", "check", "low")).alias(name))
    out._gridloom_path = rows._gridloom_path
    return out


def _cleaned(with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it):
            for k in range(b.num_rows):
                row = b.slice(k, 1).to_pylist()[0]
                x = _steps(row)
                s = x.s
                gone = x.removed(_pairs(row["r1"]), _pairs(row["r2"])[0], _pairs(row["r3"]))
                begins = gone & ~np.concatenate([[False], gone[:-1]]) if len(gone) else gone
                begins[s.begin[:-1][s.sizes > 0]] = gone[s.begin[:-1][s.sizes > 0]]
                total = lambda m, s=s: np.diff(np.concatenate([[0], np.cumsum(m)])[s.begin]).astype(np.int64)
                left = s.buf[~gone].tobytes()
                cut = np.concatenate([[0], np.cumsum(s.sizes - total(gone))])
                kept = [left[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
                out = {
                    "doc_id": pa.array(s.ids, mask=np.frombuffer(row["nulls"], bool)), "n_bytes": pa.array(s.sizes), "n_removed": pa.array(total(gone)), "n_spans": pa.array(total(begins)),
                    "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in kept], pa.string()),
                }
                if with_text:
                    out["text"] = pa.array([t.decode("utf-8", "replace") for t in kept], pa.string())
                del x, s, row, gone, begins, left, total
                yield pa.RecordBatch.from_pydict(out)

    return run


def _bucketed(segments: DataFrame) -> tuple[DataFrame, str]:
    """The segments as a table bucketed by their number: the three joins with replies move replies only."""
    spark = segments.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"gridloom_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/t-{name}"
    segments.repartition(n, "seg").write.bucketBy(n, "seg").option("path", path).option("compression", "uncompressed").saveAsTable(name)
    out = spark.table(name)
    out._gridloom_path = path
    return out, name


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One row per document: bytes, bytes and runs removed, digest of the rest (and the rest as text)."""
    small_batches(docs.sparkSession)
    segments, name = _bucketed(docs.select("doc_id", "text").mapInArrow(_segments, "seg long, n_bytes long, ids binary, nulls binary, sizes binary, data binary"))
    total = segments.agg(F.sum("n_bytes")).first()[0] or 0
    ranges = max(1, -(-total // RANGE_BYTES))
    # Batches of ids: any bounds give the same results, so approximate quantiles do.
    bounds = np.unique(docs.select(F.percentile_approx("doc_id", [k / BATCHES for k in range(1, BATCHES)], 4 * BATCHES)).first()[0] or []).astype(np.int64)
    r1 = _replies(segments.mapInArrow(_asked("chunks", ranges, bounds), _SENT), False, "r1")
    one = segments.join(r1.hint("shuffle_hash"), "seg", "left")
    r2 = _replies(one.mapInArrow(_asked("anchors", ranges, bounds), _SENT), True, "r2")
    two = one.join(r2.hint("shuffle_hash"), "seg", "left")
    r3 = _replies(two.mapInArrow(_asked("strings", ranges, bounds), _SENT), False, "r3")
    out = materialize(two.join(r3.hint("shuffle_hash"), "seg", "left").mapInArrow(_cleaned(with_text), _OUT + (", text string" if with_text else "")))
    for t in (segments, r1, r2, r3):
        discard(t)
    docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return out
