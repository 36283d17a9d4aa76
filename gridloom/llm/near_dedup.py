"""Near-duplicate documents by b-bit MinHash.

1. Each text becomes its set of distinct five-word shingles (64-bit hashes). Texts with
   the same set form a class, told by a 128-bit digest of the sorted set; from here on only
   the class's representative (smallest doc_id) counts, so exact copies cost nothing.
2. K minima are cut to their low BITS bits and packed into bit planes; BANDS groups of ROWS
   full minima make band keys. Classes that share a band key are candidates; of buckets with
   the same members one is used.
3. Members of a bucket meet in blocks. Similarity is estimated from the packed signatures by
   bit counts, corrected for chance agreement of b bits; members with no partner that is
   estimated near fetch nothing. The others fetch their full sets, confirm their links on
   them inside the block and hand on only what joins components: a tree, never pairs.
4. First each class meets others in its FIRST fullest buckets, in one block of each, which
   joins most of a group of copies. Then every bucket that still holds more than one component
   is searched whole: its largest component against the others, and these among themselves.
A pair at exactly the threshold misses all bands with probability (1 - 0.75**4)**48 < 2e-8.

Defined results: null and empty texts, and texts of white space alone, have the empty set,
link with nothing and are their own component; fewer than five words are one shingle;
repeated ids share a component when their texts do; rows with null ids are left out of
links, have a null component_id and are kept; very long texts are hashed whole, in blocks
bounded by shingles; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import Words, batches, chunks, discard, forget, group_ranges, materialize, mix, raw, small_batches, whole_groups, windows

SHINGLE = 5
PERCENT = 75
ROWS = 4
BANDS = 48
#: Minima of a signature; the first ROWS * BANDS also make the band keys.
K = 256
BITS = 4
#: Pairs estimated below this are dropped; five standard errors under the threshold.
FLOOR = PERCENT / 100 - 5 * (0.75 * 0.25 / K) ** 0.5
#: Members of a block, and shingles in all of them, that one task holds at a time.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 22
#: Buckets in which a class meets others before components are first joined.
FIRST = 3

_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 2**32, K, np.uint32)
_ODD = _RNG.integers(0, 2**31, K, np.uint32) * np.uint32(2) + np.uint32(1)
_BAND = _RNG.integers(0, 2**63, BANDS, np.uint64)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    out = []
    for a, b in chunks(texts):
        words = Words(texts[a:b], lower=True)
        for i in range(b - a):
            own = words.hash[words.at[i] : words.at[i + 1]]
            if len(own) >= SHINGLE:
                out.append(np.unique(windows(own, SHINGLE)))
            elif len(own):
                whole = len(own)
                for h in own.tolist():
                    whole = (whole * 0x100000001B3 + h) & 0xFFFFFFFFFFFFFFFF
                out.append(mix(np.array([whole], np.uint64)))
            else:
                out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Packed low bits (n, BITS * K // 64 longs, plane by plane) and band keys (n, BANDS) of non-empty sets."""
    n = len(sets)
    minima = np.empty((K, n), np.uint32)
    sizes = [len(s) for s in sets]
    begin = 0
    while begin < n:  # chunks that stay in the cache
        end, size = begin, 0
        while end < n and (size == 0 or size + sizes[end] <= 1 << 16):
            size += sizes[end]
            end += 1
        flat = np.concatenate(sets[begin:end])
        low = (flat >> np.uint64(32)).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum(sizes[begin : end - 1])]).astype(np.int64)
        for k in range(K):
            x = (low ^ _XOR[k]) * _ODD[k]
            x ^= x >> np.uint32(15)
            minima[k, begin:end] = np.minimum.reduceat(x, starts)
        begin = end
    keys = np.zeros((BANDS, n), np.uint64)
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + minima[r : ROWS * BANDS : ROWS] + np.uint64(r + 1)) if r else mix(minima[r : ROWS * BANDS : ROWS].astype(np.uint64) + _BAND[:, None])
    planes = [np.packbits((minima >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=0, bitorder="little") for b in range(BITS)]
    packed = np.concatenate([np.ascontiguousarray(p.T).view("<i8") for p in planes], 1)
    return packed, np.ascontiguousarray(keys.T).view(np.int64)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))


def _sketch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches(it):
        sets = shingle_sets(raw(b.column(1)))
        full = [i for i, s in enumerate(sets) if len(s)]
        packed, keys = np.zeros((len(sets), BITS * K // 64), np.int64), np.zeros((len(sets), BANDS), np.int64)
        if full:
            packed[full], keys[full] = signatures([sets[i] for i in full])
        digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([p.tobytes() for p in packed], pa.binary()), _lists(keys)], ["doc_id", "n_shingles", "digest", "sig", "keys"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def _similar(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, the members that an estimate puts near a member of another component."""
    forget()
    for t in whole_groups(it, 3):
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint64).reshape(t.num_rows, BITS, K // 64)
        comp, side = (t.column(c).to_numpy() for c in ("component", "side"))
        near = np.zeros(t.num_rows, bool)
        for at, end in group_ranges(t, 3):
            left = np.flatnonzero(side[at:end] != 1) + at
            right = np.flatnonzero(side[at:end] != 0) + at
            for i in left.tolist():
                other = right[comp[right] != comp[i]]
                if side[i] == 2:
                    other = other[other > i]
                if len(other):
                    good = other[similarity(sig[i], sig[other]) >= FLOOR]
                    if len(good):
                        near[good] = True
                        near[i] = True
        yield from t.drop_columns(["sig"]).filter(pa.array(near)).to_batches()


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of packed signatures: lanes that agree, by bit counts, less the agreement of chance."""
    agree = K - np.bitwise_count(np.bitwise_or.reduce(a ^ b, axis=-2)).sum(-1, dtype=np.int64)
    return (agree / K - 2.0**-BITS) / (1 - 2.0**-BITS)


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block, what its full sets join: every group of ids with a link is emitted as a tree."""
    forget()
    for t in whole_groups(it, 3):
        a, b = [], []
        ids, comp, side = (t.column(c).to_numpy() for c in ("id", "component", "side"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        for at, end in group_ranges(t, 3):
            for group in _trees(ids[at:end], comp[at:end], side[at:end], sets[at:end]):
                # A heap's shape: no id has more than three neighbours, none is far from the smallest.
                a += group[1:]
                b += [group[(k - 1) // 2] for k in range(1, len(group))]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _trees(ids: np.ndarray, comp: np.ndarray, side: np.ndarray, sets: list[np.ndarray]) -> list[list[int]]:
    """Sorted ids, one of each component, of the groups of components that links of this block join."""
    _, root = np.unique(comp, return_inverse=True)
    flat, where = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets])
    start = np.concatenate([[0], np.cumsum(size)])
    own = root.copy()
    mark = np.zeros(len(flat), bool)
    right = np.flatnonzero(side != 0)
    for i in np.flatnonzero(side != 1).tolist():
        other = right[root[right] != root[i]]
        if side[i] == 2:
            other = other[other > i]
        if not len(other):
            continue
        mine = where[start[i] : start[i + 1]]
        mark[mine] = True
        for part in np.array_split(other, max(1, int(size[other].sum()) >> 22)):
            take = np.concatenate([where[start[j] : start[j + 1]] for j in part.tolist()])
            both = np.add.reduceat(mark[take].astype(np.int64), np.concatenate([[0], np.cumsum(size[part])[:-1]]))
            good = part[100 * both >= PERCENT * (size[part] + size[i] - both)]
            if len(good):
                root[np.isin(root, root[good])] = root[i]
        mark[mine] = False
    out = []
    one = {o: int(x) for o, x in zip(own.tolist(), ids.tolist(), strict=True)}
    members: dict[int, set[int]] = {}
    for o, r in zip(own.tolist(), root.tolist(), strict=True):
        members.setdefault(r, set()).add(o)
    for group in members.values():
        if len(group) > 1:
            out.append(sorted({one[o] for o in group}))
    return out


def _sets(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for b in batches(it):
        sets = [s.tobytes() for s in shingle_sets(raw(b.column(0)))]
        yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], ["digest", "set"])


def _search(split: DataFrame, signed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between components in the blocks of split (key, i, j, side, id, digest, component).

    Estimates tell which members have a partner in their block at all; only those fetch their full sets."""
    block = ["key", "i", "j"]
    fields = "key long, i int, j int, side int, id long, digest binary, component long"
    rows = split.select(*block, "side", "id", "digest", "component")
    signs = signed.select("id", "digest", "sig").hint("merge")
    near = materialize(rows.join(signs, ["id", "digest"]).select(*rows.columns, "sig").repartition(*block).sortWithinPartitions(*block).mapInArrow(_similar, fields))
    found = near.count()
    ids = near.select("id").distinct().hint("merge")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(ids, "id", "left_semi").select("text").distinct()
    sets = materialize(texts.mapInArrow(_sets, "digest binary, set binary").dropDuplicates(["digest"]).coalesce(_tasks(found, 2000)))
    full = near.join(sets.hint("merge"), "digest").select(*block, "side", "id", "component", "set")
    out = materialize(full.repartition(*block).sortWithinPartitions(*block).mapInArrow(_joined, "a long, b long").distinct().coalesce(_tasks(found, 50_000)))
    discard(near)
    discard(sets)
    return out


def _tasks(rows: int, each: int) -> int:
    """Tasks for tables whose size is known to be small: a few full files in place of many nearly empty ones."""
    return max(1, -(-rows // each))


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id in a link.

    Labels fall to the smallest of the neighbours', then to the label of that label, until none changes."""
    n = _tasks(2 * links.count(), 250_000)
    both = materialize(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(n))
    labels = materialize(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("id"), "label").coalesce(n))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("label"), F.col("label").alias("up"))
        new = materialize(step.join(up.hint("merge"), "label", "left").select("id", "old", F.least("label", F.coalesce("up", "label")).alias("label")).coalesce(n))
        changed = new.where("old <> label").limit(1).count()
        discard(labels)
        labels = new
        if not changed:
            discard(both)
            return new.select("id", F.col("label").alias("component"))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest of the set, packed signature and band keys of every document."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_sketch, "doc_id long, n_shingles long, digest binary, sig binary, keys array<long>")


def _blocks(n: Column, shingles: Column) -> Column:
    """Into how many blocks members go, so that none holds many members or very large sets."""
    return F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")


def _deal(blocks: Column, *salt: Column) -> Column:
    return F.pmod(F.xxhash64("id", "digest", *salt), blocks).cast("int")


def links(docs: DataFrame, sketched: DataFrame, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of ids that join the classes' components, and (id, component) of the joined ones.

    reps: (digest, id) per class of equal sets. An id with several texts has the links of each."""
    signed = sketched.select("digest", F.col("doc_id").alias("id"), "n_shingles", "sig", "keys").join(reps.hint("merge"), ["digest", "id"])
    n_docs = sketched.count()
    signed = materialize(signed.dropDuplicates(["digest", "id"]).coalesce(_tasks(n_docs, 10_000)))
    rows = signed.select("id", "digest", "n_shingles", F.posexplode("keys").alias("band", "key")).withColumn("key", F.xxhash64("band", "key"))
    # Buckets of the same members say the same: one of them is enough.
    who = F.xxhash64("id", "digest")
    buckets = rows.groupBy("key").agg(F.count("id").alias("n"), F.sum("n_shingles").alias("shingles"), F.bit_xor(who).alias("x"), F.sum(F.shiftrightunsigned(F.xxhash64(who), 24)).alias("y")).where("n > 1")
    buckets = buckets.groupBy("n", "x", "y").agg(F.min(F.struct("key", "shingles")).alias("m")).select("m.key", "n", "m.shingles")
    members = materialize(rows.select("key", "id", "digest", "n_shingles").join(buckets.hint("merge"), "key").coalesce(_tasks(n_docs, 10_000)))
    # First contract: each class meets others in its fullest buckets, in one block of each.
    full = members.groupBy("id", "digest").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "key", "shingles")), asc=False), 1, FIRST).alias("m"))
    first = full.select("id", "digest", F.col("id").alias("component"), F.explode("m").alias("m")).select("id", "digest", "component", "m.*")
    first = first.withColumn("i", _deal(_blocks(F.col("n"), F.col("shingles")), F.col("key"))).withColumns({"j": F.col("i"), "side": F.lit(2)})
    found = _search(first, signed, docs)
    joined = components(found)
    # Then all pairs of a bucket that lie in different components: the bucket's largest component against the
    # others, block by block, and the others among themselves.
    labelled = materialize(members.select("key", "id", "digest", "n_shingles").join(joined.hint("merge"), "id", "left").withColumn("component", F.coalesce("component", "id")).coalesce(_tasks(n_docs, 10_000)))
    parts = labelled.groupBy("key", "component").agg(F.count("id").alias("n"), F.sum("n_shingles").alias("shingles"))
    open_ = parts.groupBy("key").agg(F.max(F.struct("n", "component", "shingles")).alias("top"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("key").alias("parts")).where("parts > 1")
    open_ = open_.select("key", F.col("top.component").alias("largest"), _blocks(F.col("top.n"), F.col("top.shingles")).alias("bl"), _blocks(F.col("n") - F.col("top.n"), F.col("shingles") - F.col("top.shingles")).alias("bo"))
    split = labelled.join(open_.hint("merge"), "key").withColumn("top", F.col("component") == F.col("largest")).withColumn("own", _deal(F.when(F.col("top"), F.col("bl")).otherwise(F.col("bo"))))
    against = F.transform(F.sequence(F.lit(0), F.when(F.col("top"), F.col("bo")).otherwise(F.col("bl")) - 1), lambda o: F.struct(F.when(F.col("top"), o).otherwise(F.col("own")).alias("i"), (-1 - F.when(F.col("top"), F.col("own")).otherwise(o)).alias("j"), F.when(F.col("top"), 0).otherwise(1).alias("side")))
    among = F.transform(F.sequence(F.lit(0), F.col("bo") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.when(o == F.col("own"), 2).when(F.col("own") < o, 0).otherwise(1).alias("side")))
    meets = F.when(F.col("top"), against).otherwise(F.concat(against, among))
    split = split.select("key", "id", "digest", "component", F.explode(meets).alias("m")).select("key", "id", "digest", "component", "m.*")
    more = _search(split, signed, docs)
    if more.limit(1).count():
        found = found.unionByName(more)
        discard_later, joined = joined, components(found)
        discard(discard_later)
    for t in (signed, members, labelled):
        discard(t)
    return found, joined


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    sketched = materialize(sketch(docs))
    reps = sketched.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"))
    reps = materialize(reps.coalesce(_tasks(sketched.count(), 50_000)))
    _, joined = links(docs, sketched, reps)
    named = reps.join(joined.hint("merge"), "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    rows = sketched.select("doc_id", "n_shingles", "digest")
    out = rows.join(named.hint("merge"), "digest", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component. Rows with null ids stay.

    Of rows with one id that with the smallest text stays, of equal texts that with the smallest hash of the other columns."""
    ids = dedup(docs).where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    ids = materialize(ids.coalesce(_tasks(docs.count(), 50_000)))
    once = docs.join(ids.where("n = 1").hint("merge"), "doc_id", "left_semi")
    again = docs.join(ids.where("n > 1").hint("merge"), "doc_id", "left_semi")
    row = F.struct(*[F.col(c) for c in docs.columns])
    least = again.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*docs.columns))).alias("r")).select("r.*")
    return once.unionByName(least).unionByName(docs.where("doc_id is null"))
