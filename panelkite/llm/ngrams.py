"""N-gram Jaccard join by token-combination prefixes.

A document is its set of distinct word shingles (tokens).  Equal sets are one
class and are joined by grouping.  For classes, tokens are ordered rare ones
first.  A link needs all but a quarter of a set's tokens, so a prefix that
can't be lost with a quarter of the tokens holds a common part of every link:
a rare token counts one; frequent tokens are dealt into subclasses, where c of
them count c - 1, as they are indexed in pairs.  Prefixes are extended until
they count a quarter of the set and one more.  Which tokens are frequent is
estimated from all documents with a table of counters of a fixed size; the
estimate changes the work only, as every order of tokens gives all links.

How many subclasses there are depends on the set's size, by bands; a document
is indexed under each band in which a partner's size can lie.

Keys with the same members are one group.  Candidates are first a group's
members with the smallest one, its pivot (one row a member, however large the
group), verified and united.  Groups of rare tokens, which are bounded, whose
members are then still of several components give the pairs between components.
Members that share a pivot by frequent tokens are dealt into blocks, and pairs
of blocks are compared where components differ: by bitmaps first, then those
that may have a partner by their sets.  A set's bitmap bounds its overlaps from
above, and verification compares whole sets.

Tokens are 64-bit hashes of five words, classes 64-bit hashes of sets.  Null
and empty texts have no tokens and link with nothing; fewer than five words are
one token; empty tables give empty results; repeated rows are copies; a null id
is never a component's smallest unless it has no other; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkite.llm import _base, _text

WIDTH = 5
PERCENT = 75
SKETCH_BITS = 20
#: Upper ends of the bands of set sizes, and their numbers of subclasses (0: every token counts one).
BANDS = ((16, 0), (64, 4), (256, 16), (1 << 62, 128))
_CELLS = 1 << 14
#: Keys that a task gathers before it hands them on.
_HELD = 1 << 20
#: Bytes of a rare token's key beside its bucket.
_KEY_BYTES = 5
#: Members of a pivot that are compared with one another at once, and partners of a class that are verified in one lane.
BLOCK, LANE = 512, 512
#: Stands for a null id.
_NO_ID = -(1 << 63)


def _signature(tokens: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(tokens.tobytes()), np.uint64).view(np.int64))


def needed(n: int, percent: int = PERCENT) -> int:
    """Tokens that a set of n must share with any partner."""
    return -(-n * percent // 100)


def _band(n: int) -> int:
    return next(i for i, (top, _) in enumerate(BANDS) if n < top)


def keys_of(tokens: np.ndarray, load: np.ndarray, often: float, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """(rare, frequent): index keys of a sorted set; load is the estimated frequency of each token."""
    n = len(tokens)
    want = n - needed(n, percent) + 1
    frequent = load > often
    rare = tokens[~frequent][:want]
    if len(rare) >= want:
        return rare, tokens[:0]
    rest = tokens[frequent]
    rest = rest[np.lexsort((rest, np.log2(load[frequent]).astype(np.int64)))]
    out = []
    low, high = needed(n, percent), n * 100 // percent
    for band in range(_band(low), _band(high) + 1):
        groups = BANDS[band][1]
        if not groups:
            out.append(rest[: want - len(rare)])
            continue
        group = (rest % np.uint64(groups)).astype(np.int64)
        first = np.zeros(len(rest), bool)
        first[np.unique(group, return_index=True)[1]] = True
        weight = len(rare) + np.cumsum(~first)
        end = int(np.searchsorted(weight, want)) + 1
        part, group = rest[:end], group[:end]
        order = np.argsort(group, kind="stable")
        part, group = part[order], group[order]
        bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if e - s > 1:
                i, j = np.triu_indices(e - s, 1)
                one = np.sort(part[s:e])
                out.append(_text.mix64(one[i] * np.uint64(3) + one[j] + np.uint64(band)))
    return rare, (np.unique(np.concatenate(out)) if out else tokens[:0])


def _sets(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in _base.slices(batches):
        yield batch, list(_text.shingle_sets(batch.column(place).to_pylist(), WIDTH))


def classes(docs: DataFrame, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, np.ndarray]:
    """Stored rows (id, n, sig, bits), one for each document, and the sketch of token frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        seen: set[int] = set()
        names = ["id", "n", "sig", "bits", "block", "cells"]
        for batch, sets in _sets(batches, 1):
            sigs = [_signature(s) if len(s) else None for s in sets]
            new = [s for s, g in zip(sets, sigs, strict=True) if g is not None and g not in seen]
            seen.update(g for g in sigs if g is not None)
            if len(seen) > 1 << 18:
                seen.clear()
            if new:
                counts += np.bincount(np.concatenate(new) >> np.uint64(64 - SKETCH_BITS), minlength=len(counts))
            none = [None] * len(sets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(sigs, pa.int64()), pa.array([_bitmap(x) if len(x) else None for x in sets], pa.binary()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=names)
        for b in _base.as_blocks(counts, _CELLS):
            yield pa.RecordBatch.from_arrays([*[pa.array([None], pa.int64())] * 3, pa.array([None], pa.binary()), b.column(0), b.column(1)], names=names)

    rows = docs.select(F.col(key).cast("long"), text).mapInArrow(run, "id bigint, n bigint, sig bigint, bits binary, block int, cells binary")
    both = _base.stored(rows, "sets")
    sketch = _base.summed(both.where("block IS NOT NULL").select("block", "cells"), _CELLS, (1 << SKETCH_BITS) // _CELLS)
    return both.where("block IS NULL").select("id", "n", "sig", "bits"), sketch


def key_groups(docs: DataFrame, sketch: np.ndarray, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """Stored rows (key, more, sigs): for rare tokens each different set of classes that share a key, for frequent ones (more is null) each class of a key.

    Keys of rare tokens travel packed, thousands a row and 40 bits each beside
    their bucket; others that fall together with one only make candidates.
    Where they meet, keys of one class are left out, and those with the same
    classes are one group; it is bounded, as a token is rare by the sketch.
    Keys of frequent tokens go on as rows, dealt by class.
    """
    spark = docs.sparkSession
    mean = sketch.mean()
    often = float(mean + 8 * np.sqrt(mean) + 32)
    load = spark.sparkContext.broadcast(sketch.astype(np.int64))
    buckets = 2 * _base.partitions(spark)

    def packed(kind: int, keys: list[np.ndarray], sigs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        k, s = np.concatenate(keys), np.concatenate(sigs)
        to = ((s.view(np.uint64) if kind else k) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        k, s, to = k[order], s[order], to[order]
        if not kind:
            k = np.ascontiguousarray((k // np.uint64(buckets)).view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES])
        bounds = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1], [True])))
        cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
        columns = [[x[a:b].tobytes() for a, b in cut] for x in (k, s)]
        yield pa.RecordBatch.from_arrays([pa.array(to[bounds[:-1]].astype(np.int32)), pa.array([kind] * len(cut), pa.int32()), *[pa.array(c, pa.binary()) for c in columns]], names=["bucket", "kind", "k", "s"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load.value
        seen: set[int] = set()
        held: tuple[tuple[list, list], ...] = (([], []), ([], []))
        count = 0
        for _, sets in _sets(batches, 0):
            for tokens in sets:
                if not len(tokens) or (sig := _signature(tokens)) in seen:
                    continue
                seen.add(sig)
                for hold, keys in zip(held, keys_of(tokens, table[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], often, percent), strict=True):
                    if len(keys):
                        hold[0].append(keys)
                        hold[1].append(np.full(len(keys), sig, np.int64))
                        count += len(keys)
            if len(seen) > 1 << 18:
                seen.clear()
            if count > _HELD:
                for kind, hold in enumerate(held):
                    if hold[0]:
                        yield from packed(kind, *hold)
                        for part in hold:
                            part.clear()
                count = 0
        for kind, hold in enumerate(held):
            if hold[0]:
                yield from packed(kind, *hold)

    def out(key: np.ndarray, more: pa.Array, starts: np.ndarray, sigs: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), more, pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(sigs))], names=["key", "more", "sigs"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])
        for batch in batches:
            for i, (bucket, kind) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                raw, s = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8), np.frombuffer(batch.column(3)[i].as_buffer(), np.int64)
                if kind:
                    k = raw.view(np.uint64)
                    for at in range(0, len(k), 1 << 16):
                        part = slice(at, at + (1 << 16))
                        yield out(k[part].copy(), pa.nulls(len(k[part]), pa.int64()), np.arange(len(k[part]) + 1), s[part])
                else:
                    wide = np.zeros((len(s), 8), np.uint8)
                    wide[:, :_KEY_BYTES] = raw.reshape(-1, _KEY_BYTES)
                    held[0].append(wide.view(np.uint64)[:, 0] * np.uint64(buckets) + np.uint64(bucket))
                    held[1].append(s.copy())
        if not held[0]:
            return
        k, s = (np.concatenate(x) for x in held)
        order = np.lexsort((s, k))
        k, s = k[order], s[order]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])))
        k, s = k[new], s[new]
        same = np.concatenate(([False], k[1:] == k[:-1], [False]))
        many = same[:-1] | same[1:]
        k, s = k[many], s[many]
        if not len(k):
            return
        starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        ends = np.append(starts[1:], len(k))
        # 128 bits of the group's classes, which are in order.
        names = np.stack([np.add.reduceat(_text.mix64(s.view(np.uint64) ^ np.uint64(salt)), starts) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)], 1)
        _, first = np.unique(names, axis=0, return_index=True)
        for at in range(0, len(first), 1 << 14):
            own = first[at : at + (1 << 14)]
            sizes = ends[own] - starts[own]
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            place = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes) + np.repeat(starts[own], sizes)
            yield out(names[own, 0], pa.array(names[own, 1].view(np.int64)), bounds, s[place])

    sent = docs.select(text).mapInArrow(index, "bucket int, kind int, k binary, s binary")
    met = sent.repartition(_base.partitions(spark), "bucket").mapInArrow(meet, "key bigint, more bigint, sigs array<bigint>")
    return _base.stored(met, "keys")


def _bitmap(tokens: np.ndarray, wide: int = 1) -> bytes:
    """Parities of the tokens' numbers by cell."""
    bits = 64
    while bits < wide * len(tokens):
        bits *= 2
    out = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(out.astype(bool), bitorder="little").tobytes()


def _differ(a: bytes, b: bytes) -> int:
    """How many parities differ, the longer folded onto the shorter: no more than tokens differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    m = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(v.reshape(-1, m), axis=0) for v in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def _may(n: int, m: int, overlap: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def possible(pairs: DataFrame, groups: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the distinct pairs (a, b) of classes whose sizes and bitmaps allow a link; groups: (sig, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in (2, 3, 4, 5))
            keep = pa.array([_may(p, q, (p + q - _differ(s, t)) // 2, percent) for p, q, s, t in zip(n, m, x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = groups.select(F.col("sig").alias("a"), "n", F.col("bits").alias("x"))
    right = groups.select(F.col("sig").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
    fits = (F.col("n") * 100 >= F.col("m") * percent) & (F.col("m") * 100 >= F.col("n") * percent)
    both = pairs.join(left, "a").join(right, "b").where(fits).select("a", "b", "n", "m", "x", "y")
    return _base.stored(both.mapInArrow(run, "a bigint, b bigint"), "possible")


def _wanted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs (id, _text) whose id may be one of `ids`, by a bitmap of 16 bits an id, at most 8 MB; beyond, more rows come through."""
    spark = docs.sparkSession
    bits = max(16, min(26, (16 * ids.count()).bit_length()))
    cell = ids.select(F.shiftrightunsigned(F.xxhash64("id"), 64 - bits).alias("c"))
    words = cell.groupBy(F.shiftright("c", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(c & 63 AS INT))")).alias("b")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words["w"].to_numpy()] = words["b"].to_numpy()
    shared = spark.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").view(bool) if bits <= 20 else table)

    @F.pandas_udf("boolean")
    def may(c: pd.Series) -> pd.Series:
        at = c.to_numpy()
        if shared.value.dtype == bool:
            return pd.Series(shared.value[at])
        return pd.Series((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return docs.where(may(F.shiftrightunsigned(F.xxhash64("id"), 64 - bits)))


def class_sets(docs: DataFrame, asked: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(a, lane, sig, tokens): the set of each class in each of its places, from (id, want, part, at array of (a, lane)), id a document of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _base.slices(batches, 64):
            sets = list(_text.shingle_sets(batch.column(1).to_pylist(), WIDTH))
            for want, at, own in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), sets, strict=True):
                # An id that occurs in several rows brings texts of other classes along.
                if not len(own) or _signature(own) != want:
                    continue
                for i in range(0, len(at), 64):
                    part = at[i : i + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([p["a"] for p in part], pa.int64()), pa.array([p["lane"] for p in part], pa.int64()), pa.array([want] * len(part), pa.int64()), pa.array([own.tobytes()] * len(part), pa.binary())], names=["a", "lane", "sig", "tokens"])

    rows = _wanted(docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).alias("_text")), asked.select("id"))
    # Repeated rows go where the join has brought them together.
    rows = rows.join(asked, "id").withColumn("_same", F.xxhash64("_text")).dropDuplicates(["id", "want", "part", "_same"])
    return rows.select("want", "_text", "at").mapInArrow(run, "a bigint, lane bigint, sig bigint, tokens binary")


def verified(pairs: DataFrame, docs: DataFrame, groups: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Stored pairs (a, b) of classes that link, by their whole sets; groups: (sig, id).

    A pair is compared where its a is; an a with many partners is in several
    lanes, each with a bounded number of them.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, first = None, np.zeros(0, np.uint64)
        for batch in _base.slices(batches, 512):
            a, lane, sig, raw = (batch.column(c).to_pylist() for c in range(4))
            found = []
            for i in range(len(a)):
                tokens = np.frombuffer(raw[i], np.uint64)
                if sig[i] == a[i]:
                    here, first = (a[i], lane[i]), tokens
                elif here == (a[i], lane[i]) and _may(len(first), len(tokens), len(np.intersect1d(first, tokens, assume_unique=True)), percent):
                    found.append((a[i], sig[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    lanes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / LANE).alias("_c"))
    dealt = pairs.join(lanes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("_c")).alias("lane"))
    asked = dealt.select(F.col("b").alias("sig"), "a", "lane").unionByName(dealt.select(F.col("a").alias("sig"), "a", "lane").distinct())
    asked = asked.groupBy("sig", F.shiftright("lane", 10).alias("part")).agg(F.collect_list(F.struct("a", "lane")).alias("at"))
    asked = _base.stored(asked.join(groups.select("sig", "id"), "sig").select("id", F.col("sig").alias("want"), "part", "at"), "asked")
    rows = class_sets(docs, asked, text, key).repartition(_base.partitions(docs.sparkSession), "a", "lane")
    rows = rows.sortWithinPartitions("a", "lane", F.col("sig") != F.col("a"))
    links = _base.stored(rows.mapInArrow(compare, "a bigint, b bigint"), "links")
    _base.discard(asked)
    return links


def _folded(rows: list[bytes], words: int) -> np.ndarray:
    """Bitmaps as rows of so many 64-bit words, longer ones folded."""
    out = np.zeros((len(rows), words), np.uint64)
    for i, raw in enumerate(rows):
        out[i] = np.bitwise_xor.reduce(np.frombuffer(raw, np.uint64).reshape(-1, words), axis=0)
    return out


def block_links(members: DataFrame, whole: bool, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """Of a pivot's members (pivot, sig, root, n, bits): rows (a, b), b the classes that may link with one of another component, a their pivot.

    If whole, members have their tokens instead of bitmaps: rows (a, b) are then
    links that join components.  Two blocks of members are compared at a time.
    """
    spark = members.sparkSession
    sizes = members.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_many"), F.min("root").alias("_x"), F.max("root").alias("_y")).where("_x <> _y").select(F.col("pivot").alias("_p"), "_many")
    rows = members.join(sizes, F.col("pivot") == F.col("_p")).withColumn("_block", F.pmod(F.xxhash64("sig"), F.col("_many")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_many") - 1)))
    rows = rows.select("pivot", "sig", "root", *(["tokens"] if whole else ["n", "bits"]), "_block", F.least("_block", "_other").alias("_low"), F.greatest("_block", "_other").alias("_high"))

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[1].as_py(), key[2].as_py()
        own, sig, root = (np.array(table.column(c).to_pylist(), np.int64) for c in ("_block", "sig", "root"))
        if whole:
            sets = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
            n = np.array([len(t) for t in sets])
            bits = [_bitmap(t, 8) for t in sets]
        else:
            n, bits = np.array(table.column("n").to_pylist(), np.int64), table.column("bits").to_pylist()
        words = np.array([len(b) // 8 for b in bits])
        forest, links, live = _base.Forest(), [], np.zeros(len(n), bool)
        for wide in np.unique(words):
            left = np.flatnonzero((own == low) & (words == wide))
            for narrow in np.unique(words):
                right = np.flatnonzero((own == high) & (words == narrow))
                if not len(left) or not len(right) or max(wide, narrow) > 2 * min(wide, narrow):
                    continue
                m = int(min(wide, narrow))
                x, y = _folded([bits[i] for i in left], m), _folded([bits[i] for i in right], m)
                for i, row in zip(left.tolist(), x, strict=True):
                    fit = (root[right] != root[i]) & (100 * np.minimum(n[right], n[i]) >= percent * np.maximum(n[right], n[i]))
                    if low == high:
                        fit &= sig[right] > sig[i]
                    at = np.flatnonzero(fit)
                    if not len(at):
                        continue
                    shared = (n[right[at]] + n[i] - np.bitwise_count(y[at] ^ row).sum(axis=1).astype(np.int64)) // 2
                    may = 100 * shared >= percent * (n[right[at]] + n[i] - shared)
                    at, shared = at[may], shared[may]
                    if not whole:
                        live[right[at]] = True
                        live[i] |= bool(len(at))
                        continue
                    # The likeliest first, as one link makes others needless.
                    for j in right[at[np.argsort(shared / (n[right[at]] + n[i]), kind="stable")[::-1]]].tolist():
                        if forest.find(int(root[i])) == forest.find(int(root[j])):
                            continue
                        if _may(int(n[i]), int(n[j]), len(np.intersect1d(sets[i], sets[j], assume_unique=True)), percent):
                            forest.link(int(root[i]), int(root[j]))
                            links.append((int(sig[i]), int(sig[j])))
        if not whole:
            links = [(key[0].as_py(), x) for x in sig[live].tolist()]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    # Dealt out by all three: Spark would take the pivots' partitioning as good enough.
    dealt = rows.repartition(_base.partitions(spark), "pivot", "_low", "_high")
    return dealt.groupBy("pivot", "_low", "_high").applyInArrow(compare, "a bigint, b bigint")


def pairs_between(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Stored distinct pairs (a, b) of classes of one group g and two components, from (g, sig, root, n); groups are bounded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.zeros((0, 4), np.int64)

        def pairs(own: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.concatenate(([True], own[1:, 0] != own[:-1, 0])))
            # Each row with all behind it in its group, so many rows at once that the pairs stay few.
            behind = np.repeat(np.append(starts[1:], len(own)), np.diff(np.append(starts, len(own)))) - np.arange(len(own)) - 1
            cuts = np.searchsorted(np.cumsum(behind), np.arange(1 << 18, behind.sum() + (1 << 18), 1 << 18))
            for s, e in zip([0, *(cuts + 1).tolist()], [*(cuts + 1).tolist(), len(own)], strict=True):
                many = behind[s:e]
                i = np.repeat(np.arange(s, min(e, len(own))), many)
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
                n, m = own[i, 3], own[j, 3]
                apart = (own[i, 2] != own[j, 2]) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                a, b = own[i[apart], 1], own[j[apart], 1]
                two = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["a", "b"])

        for batch in _base.slices(batches, 8192):
            now = np.concatenate((tail, np.stack([batch.column(c).to_numpy() for c in range(4)], 1)))
            whole = int(np.flatnonzero(now[:, 0] != now[-1, 0])[-1]) + 1 if (now[:, 0] != now[-1, 0]).any() else 0
            tail = now[whole:]
            if whole:
                yield from pairs(now[:whole])
        if len(tail):
            yield from pairs(tail)

    dealt = rows.select("g", "sig", "root", "n").repartition(_base.partitions(rows.sparkSession), "g").sortWithinPartitions("g")
    return _base.stored(dealt.mapInArrow(run, "a bigint, b bigint").distinct(), "pairs")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """(key, n_shingles, component_id, class_id) for each row of docs."""
    rows, sketch = classes(docs, text, key)
    keys = key_groups(docs, sketch, text, percent)
    groups = rows.where("sig IS NOT NULL").groupBy("sig").agg(F.min(F.coalesce("id", F.lit(_NO_ID))).alias("id"), F.min("id").alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    groups = _base.stored(groups, "classes")

    def united(links: DataFrame) -> DataFrame:
        return _base.components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    def placed(rows: DataFrame, roots: DataFrame) -> DataFrame:
        return rows.join(roots.withColumnRenamed("node", "sig"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))

    # Every member with the smallest class of its group or key, the pivot: one row a member, however large the key.
    rare = keys.where("more IS NOT NULL").groupBy("key", "more").agg(F.first("sigs").alias("sigs"))
    rare = _base.stored(rare.select(F.monotonically_increasing_id().alias("g"), "sigs"), "groups")
    often = keys.where("more IS NULL").select("key", F.element_at("sigs", 1).alias("sig"))
    pivots = often.groupBy("key").agg(F.min("sig").alias("pivot"), F.max("sig").alias("_top")).where("pivot <> _top").select("key", "pivot")
    crowd = _base.stored(often.join(pivots, "key").select("pivot", "sig").distinct(), "crowd")
    _base.discard(keys)
    star = rare.select(F.element_at("sigs", 1).alias("a"), F.explode(F.slice("sigs", F.lit(2), F.size("sigs") - 1)).alias("b"))
    star = _base.stored(star.unionByName(crowd.where("pivot <> sig").select(F.col("pivot").alias("a"), F.col("sig").alias("b"))).distinct(), "star")
    may = possible(star, groups, percent)
    links = verified(may, docs, groups, percent, text, key)
    roots = united(links)

    # What is left: pairs between components, of a group, and of all members that frequent keys give a pivot.
    of_class = _base.stored(placed(groups.select("sig", "n", "id", "bits"), roots), "placed")
    apart = rare.select("g", F.explode("sigs").alias("sig")).join(of_class.select("sig", "root", "n"), "sig")
    crossed = pairs_between(apart, percent).join(star, ["a", "b"], "left_anti")
    links = links.unionByName(verified(possible(crossed, groups, percent), docs, groups, percent, text, key))
    live = block_links(crowd.join(of_class.select("sig", "root", "n", "bits"), "sig"), False, percent).distinct()
    live = _base.stored(live.withColumnsRenamed({"a": "pivot", "b": "want"}).join(of_class.select(F.col("sig").alias("want"), "id", F.col("root").alias("_root")), "want"), "live")
    asked = live.groupBy("want", "id", F.pmod(F.xxhash64("pivot"), F.lit(64)).alias("part")).agg(F.collect_list(F.struct(F.col("pivot").alias("a"), F.lit(0).cast("long").alias("lane"))).alias("at"))
    asked = _base.stored(asked, "asked")
    tokens = class_sets(docs, asked, text, key).select(F.col("a").alias("pivot"), "sig", "tokens")
    tokens = _base.stored(tokens.join(of_class.select("sig", "root"), "sig"), "class-sets")
    links = links.unionByName(_base.stored(block_links(tokens, True, percent), "links"))
    for done in (rare, crowd, star, tokens, live, of_class, asked):
        _base.discard(done)

    named = _base.stored(placed(groups.select("sig", "least"), united(links)), "named")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select(F.col("sig").alias("_sig"), "component_id")
    # A class may hold a third of all rows: joined by a shuffle whose large partitions Spark splits.
    out = rows.join(of_class, F.col("sig") == F.col("_sig"), "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.col("sig").alias("class_id"))


def op3_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(_base.table(spark, sf_dir, "documents")).drop("class_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [hash(array_to_string(w, ' '))]
    ELSE list_distinct([hash(array_to_string(w[i : i + 4], ' ')) FOR i IN range(1, len(w) - 3)]) END AS s FROM words),
tokens AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets),
common AS (SELECT t FROM tokens GROUP BY t HAVING count(*) > 1),
few AS (SELECT * FROM tokens JOIN common USING (t)),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM few a JOIN few b ON a.t = b.t AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM sets s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
