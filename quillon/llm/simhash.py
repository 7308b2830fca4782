"""SimHash near-duplicates by covering locality-sensitive hashing.

A covering family for radius ``r`` maps each of the 64 bit positions to a vector of ``r + 1``
bits; the mask of a non-zero vector ``v`` keeps the positions whose vector has an odd product
with ``v``. The positions in which two fingerprints differ, ``r`` at most, span no more than
``r`` dimensions, so some ``v`` is orthogonal to them all and its mask keeps none of them: the
pair has equal masked fingerprints in that one of the ``2^(r+1) - 1`` tables. Nothing within the
radius is missed, and every candidate is compared exactly.

Distinct fingerprints only enter the tables (copies share one). A bucket is compared in blocks
by one task and answers with a star for each of its linked groups, not with pairs. A bucket over
``MOST`` members is dealt again by a second family over the bits that its mask leaves free. What
shares a bucket then agrees in 36 bits at least; such a bucket is compared whole, each member with
those that nothing has reached yet, so a dense group costs little more than its size.

Defined results: null text is empty, texts without words have fingerprint zero and are linked like any
other; rows without ``doc_id`` are linked and never name a component (one of theirs alone has a null
one); repeated rows and ids are kept and share a component where their texts do; ties at half of the
shingles give 0; very long texts are read whole; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, cut, keyed, slices, text_or_empty, width
from quillon.llm.graph import components

#: Members of a bucket that one task compares before the bucket is dealt again.
MOST = 4096
#: Rows that are compared at once with all others of a bucket.
BLOCK = 64

_WEIGHT = np.uint64(1) << np.arange(64, dtype=np.uint64)


def masks(radius: int, seed: int = 11) -> list[int]:
    """The covering family for ``radius``: its masks, as unsigned 64-bit numbers."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    return [sum(1 << i for i in range(64) if (int(vectors[i]) & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of unsigned 64-bit hashes: a bit is 1 if set in over half of them."""
    n = len(hashes)
    if not n:
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_WEIGHT[ones * 2 > n].sum())


def word_shingles(text: str, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, repeats included. A-Z are lower-cased, words end
    at ASCII white space; fewer words than ``size`` make one shingle, none make none."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)], dtype="<u8")
    blanks = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    n = len(words) - size + 1
    starts = np.concatenate(([0], blanks + 1))[:n].tolist()
    ends = np.concatenate((blanks, [len(joined)]))[size - 1 :].tolist()
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends, strict=True)], dtype="<u8")


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long). Null text is empty; no word gives 0."""
    src = keyed(docs, key, text).select(F.col(key).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "t"):
            fp = np.array([majority(word_shingles(t, shingle, seed)) for t in b.column("t").to_pylist()], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return arrow_map(src, run, "doc_id long, fp long")


class _Sets:
    """Disjoint sets over positions of an array."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _stars(sets: _Sets, n: int, ids: np.ndarray) -> tuple[list[int], list[int]]:
    """Each set as a star around its least id: the centre many buckets agree on."""
    centre: dict[int, int] = {}
    roots = [sets.find(i) for i in range(n)]
    for i, r in enumerate(roots):
        centre[r] = min(centre.get(r, int(ids[i])), int(ids[i]))
    pairs = [(centre[r], int(ids[i])) for i, r in enumerate(roots) if centre[r] != ids[i]]
    return [a for a, _ in pairs], [b for _, b in pairs]


def _linked(fp: np.ndarray, radius: int) -> _Sets:
    """Links of one bucket's fingerprints: each is compared with all that nothing has reached yet."""
    sets = _Sets(len(fp))
    left = np.arange(len(fp))
    while len(left):
        root, front, left = int(left[0]), left[:1], left[1:]
        while len(front) and len(left):
            near = (np.bitwise_count(fp[front[:BLOCK], None] ^ fp[None, left]) <= radius).any(0)
            reached, left = left[near], left[~near]
            for i in reached.tolist():
                sets.up[i] = root
            front = np.concatenate((front[BLOCK:], reached))
    return sets


def _groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Batches sorted by their first column: (starts of the groups, columns), groups whole."""
    held: list[np.ndarray] | None = None
    for b in batches:
        new = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new, strict=True)]
        edge = np.flatnonzero(held[0][1:] != held[0][:-1])
        if len(edge):
            end = int(edge[-1]) + 1
            done, held = [x[:end] for x in held], [x[end:] for x in held]
            yield np.concatenate(([0], np.flatnonzero(done[0][1:] != done[0][:-1]) + 1, [end])), done
    if held is not None and len(held[0]):
        yield np.concatenate(([0], np.flatnonzero(held[0][1:] != held[0][:-1]) + 1, [len(held[0])])), held


def _bucket_links(dealt: DataFrame, radius: int, most: int | None) -> DataFrame:
    """``a, b`` of the stars of each bucket (``k, fp``); a bucket over ``most`` answers ``a = k``
    with null ``b``."""
    spark = dealt.sparkSession
    near = dealt.repartition(width(spark), "k").sortWithinPartitions("k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for at, (k, fp) in _groups(batches, ["k", "fp"]):
            size = np.diff(at)
            a: list[int] = []
            b: list[int | None] = []
            first = at[:-1][size == 2]
            u = fp.view(np.uint64)
            close = np.bitwise_count(u[first] ^ u[first + 1]) <= radius
            a += fp[first[close]].tolist()
            b += fp[first[close] + 1].tolist()
            for g in np.flatnonzero(size > 2):
                if most is not None and size[g] > most:
                    a.append(int(k[at[g]]))
                    b.append(None)
                    continue
                own = slice(int(at[g]), int(at[g + 1]))
                x, y = _stars(_linked(u[own], radius), int(size[g]), fp[own])
                a += x
                b += y
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return arrow_map(near, run, "a long, b long")


def _table(t: int, mask: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(mask))), *more)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Edges ``a, b`` between distinct fingerprints (``fp``) that connect exactly those groups
    that links of ``radius`` or fewer bits connect."""
    family = masks(radius)
    dealt = distinct.select("fp", F.explode(F.array(*[_table(t, m) for t, m in enumerate(family)])).alias("k"))
    first = cut(_bucket_links(dealt, radius, MOST), "links")
    out = first.filter("b is not null")
    large = first.filter("b is null").select(F.col("a").alias("k")).distinct()
    if not large.isEmpty():
        again = masks(radius, seed=12)
        tables = F.array(*[F.struct(_table(t, m).alias("k"), F.array(*[_table(1000 + t, m | n, F.lit(i)) for i, n in enumerate(again)]).alias("sub")) for t, m in enumerate(family)])
        wide = distinct.select("fp", F.explode(tables).alias("s")).select("fp", "s.k", "s.sub")
        second = wide.join(large, "k", "left_semi").select("fp", F.explode("sub").alias("k"))
        out = out.unionByName(cut(_bucket_links(second, radius, None), "links"))
    return out


def near_groups(marks: DataFrame, radius: int = 4) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``marks`` (``doc_id, fp``)."""
    held = cut(marks, "marks")
    own = cut(held.groupBy("fp").agg(F.min("doc_id").alias("low")), "own")
    roots = components(links(own.select("fp"), radius))
    linked = own.join(roots.withColumnRenamed("v", "fp"), "fp")
    lows = cut(linked.groupBy("root").agg(F.min("low").alias("all")), "lows")
    labels = linked.select("fp", "root").join(lows, "root").select("fp", "all")
    every = cut(own.join(cut(labels, "labels"), "fp", "left").select("fp", F.coalesce("all", "low").alias("component_id")), "every")
    return held.join(every, "fp").select("doc_id", "fp", "component_id")


def as_hex(fp: str | Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
