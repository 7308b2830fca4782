"""Best-fit packing of token pieces into sequences of a fixed length.

The number of sequences is the optimum of a configuration linear program: a configuration is a
multiset of lengths that fits a sequence, and each length must be covered as often as it
occurs. Only the length histogram (``capacity`` counts at most, whatever the input) reaches the
driver. There, multiplicative weights set a price on each length: an unbounded-knapsack dynamic
program over the capacity prices configurations, and a length whose configurations leave room
free (they are worth less than the best one: its price is too low) has its price multiplied up. The prices,
divided by the best configuration's, are a dual solution, whose value is a lower bound that comes
with the result. The fractional solution is rounded: whole numbers of uses first, then the largest
fractions up while their pieces last, and what is left is solved again until little changes. The
few pieces left after that fill free places, best fit first. Documents then take their
places by rank within their length: a rank is found in parallel from salted buckets.

Defined results: null text is empty; every document has its end id, so none is without a
piece; equal rows are packed as often as they occur, null keys too; ties between pieces of one length
go by key; a very long text is cut into pieces of ``capacity``; an empty table gives no rows; other
columns of the documents are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, cut, keyed, slices, text_or_empty, width
from quillon.llm.encoder import encoder

#: Rounds that only learn prices, rounds that count, knapsacks in a round, and how fast a price
#: grows with the room its length wastes.
WARM_UP, ROUNDS, SOLVED, ETA = 2, 4, 32, 2.0
#: Room that a rounded configuration may waste: where one leaves over half of the pieces, the next holds.
SPARE = (0, 1, 4, 32, 256)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids``: each document's ids and end id, cut only if longer
    than ``capacity``. ``ids`` is little-endian unsigned 32-bit."""
    src = keyed(docs, key, text).select(F.col(key).alias("doc_id"), text_or_empty(text).alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        end = np.array([end_id], dtype="<u4")
        for b in slices(batches, "t", 1 << 20):  # encoding holds some 30 times a slice's memory
            row, piece, start, length, ids = [], [], [], [], []
            flat, begin = e.encode(b.column("t"))
            for i in range(b.num_rows):
                all_ids = np.concatenate((flat[begin[i] : begin[i + 1]].astype("<u4"), end))
                for p, at in enumerate(range(0, len(all_ids), capacity)):
                    part = all_ids[at : at + capacity]
                    row.append(i), piece.append(p), start.append(at), length.append(len(part)), ids.append(part.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"],
            )

    return arrow_map(src, run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def _fill(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value for each capacity and the length put in last (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        worth = price[1 : c + 1] + best[c - 1 :: -1][:c]
        k = int(worth.argmax())
        if worth[k] > best[c - 1]:
            best[c], last[c] = worth[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, last


def _taken(last: np.ndarray, room: int) -> list[int]:
    out = []
    while room > 0:
        if last[room]:
            out.append(int(last[room]))
            room -= out[-1]
        else:
            room -= 1
    return out


def configurations(histogram: np.ndarray, capacity: int, eta: float = ETA) -> tuple[dict[tuple[int, ...], float], float]:
    """A fractional solution of the configuration program, how often to use each configuration, and
    a lower bound of the number of sequences.

    Prices begin as the lengths. A round covers each length by the round's share of its demand:
    the longest that is short anchors a configuration, the rest of which is the knapsack optimum
    under the prices of the lengths that are still short (solved anew ``SOLVED`` times a round at
    most; between, covered ones are left out and the longest that fit take their room). It is
    used until a length in it is covered. Then the price of a length is multiplied up by the
    room that its configurations left free, so that it is placed earlier. The first rounds only learn.
    """
    lengths = np.flatnonzero(histogram)
    demand = histogram.astype(float)
    price = np.where(demand > 0, np.arange(capacity + 1.0), 0.0)
    used: dict[tuple[int, ...], float] = defaultdict(float)
    covered = np.zeros(capacity + 1)
    step, bound = -(-len(lengths) // SOLVED), 0.0
    for t in range(1 - WARM_UP, ROUNDS + 1):
        if t <= 1:
            covered[:] = 0
        target = max(t, 1) / ROUNDS * demand
        bound = max(bound, float(demand @ price) / _fill(price, capacity)[0][capacity])  # a dual solution's value
        before, waste = covered.copy(), np.zeros(capacity + 1)
        stale, since, last = True, step, None
        short = [int(x) for x in lengths if covered[x] < target[x] - 1e-9]  # ascending
        while short:
            if stale and since >= step:
                _, last = _fill(np.where(covered < target - 1e-9, price, 0), capacity)
                stale, since = False, 0
            since += 1
            config = [short[-1]]
            room = capacity - short[-1]
            for x in _taken(last, room):
                if covered[x] < target[x] - 1e-9:
                    config.append(x)
                    room -= x
            while (i := bisect_right(short, room)) > 0:  # where prices are stale, the longest that fits
                config.append(short[i - 1])
                room -= short[i - 1]
            need = Counter(config)
            times = min((target[x] - covered[x]) / k for x, k in need.items())
            if t >= 1:
                used[tuple(sorted(config, reverse=True))] += times
            for x, k in need.items():
                covered[x] += times * k
                waste[x] += times * k * room
                if covered[x] >= target[x] - 1e-9:
                    short.remove(x)
                    stale = True
        lost = waste[lengths] / np.maximum((covered - before)[lengths], 1e-9) / capacity
        price[lengths] *= np.exp(eta * (lost - lost.mean()))
    return used, bound


def best_fit(histogram: np.ndarray, capacity: int, begun: dict[tuple[int, ...], int] | None = None) -> dict[tuple[int, ...], int]:
    """Best-fit decreasing on counts: sequences of equal content are one group. ``begun`` are
    sequences to fill up first."""
    groups: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by room left
    for content, k in (begun or {}).items():
        groups[capacity - sum(content)][content] = k
    for length in np.flatnonzero(histogram)[::-1]:
        length, n = int(length), int(histogram[length])
        while n:
            room = min((r for r in groups if r >= length), default=0)
            if room:
                content, k = groups[room].popitem()
                if not groups[room]:
                    del groups[room]
                take = min(n, k)
                if k > take:
                    groups[room][content] = k - take
                new, left = (*content, length), room - length
            elif n >= (most := capacity // length):
                take, new, left = n // most, (length,) * most, capacity - most * length
            else:
                take, new, left = 1, (length,) * n, capacity - n * length
            groups[left][new] = groups[left].get(new, 0) + take
            n -= take * (len(new) if not room else 1)
    out: dict[tuple[int, ...], int] = defaultdict(int)
    for same in groups.values():
        for content, k in same.items():
            out[content] += k
    return out


def plan(histogram: np.ndarray, capacity: int) -> tuple[dict[tuple[int, ...], int], int]:
    """Whole numbers of configurations that place exactly the pieces of the histogram, and the least
    number of sequences that any packing of them needs by the first program's bound."""
    left = histogram.astype(np.int64).copy()
    full = int(left[capacity])
    left[capacity] = 0
    begun: dict[tuple[int, ...], int] = defaultdict(int)
    least = 0.0
    spare = list(SPARE)
    while (before := int(left.sum())) and spare:
        used, bound = configurations(left, capacity)
        least = least or bound
        tight = [(c, x) for c, x in used.items() if capacity - sum(c) <= spare[0]]
        whole = sorted(((c, int(x)) for c, x in tight), key=lambda c: (-c[1], c[0]))
        parts = sorted(((c, math.ceil(x - int(x))) for c, x in tight), key=lambda c: (int(used[c[0]]) - used[c[0]], c[0]))
        for config, times in [*whole, *parts]:
            need = Counter(config)
            n = min(times, *[int(left[length]) // k for length, k in need.items()])
            if n > 0:
                begun[config] += n
                for length, k in need.items():
                    left[length] -= n * k
        if int(left.sum()) > before / 2:
            spare.pop(0)
    out = best_fit(left, capacity, begun)
    if full:
        out[(capacity,)] = full
    return out, full + math.ceil(least - 1e-6)


def _runs(configs: dict[tuple[int, ...], int]) -> dict[str, np.ndarray]:
    """For each length the runs of ranks that one configuration takes, in order."""
    rows, taken, first = [], defaultdict(int), 0
    for config, n in sorted(configs.items()):
        offset = 0
        for length, k in sorted(Counter(config).items(), reverse=True):
            rows.append((length, taken[length], first, k, offset))
            taken[length] += n * k
            offset += length * k
        first += n
    a = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (a[:, 0] << 44) + a[:, 1], "rank": a[:, 1], "first": a[:, 2], "each": a[:, 3], "offset": a[:, 4]}


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (``doc_id, piece, start, length`` and more).

    ``items`` is written to the shared folder first, as it is read twice. Ranks come from
    ``width`` salted buckets of each length: a length that a third of all pieces share is
    ranked by as many tasks as any other rows.
    """
    spark = items.sparkSession
    held = cut(items, "pieces")
    n = max(64, width(spark))
    salted = held.withColumn("__q_b", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(n)).cast("int"))
    counts = salted.groupBy("length", "__q_b").agg(F.count(F.lit(1)).alias("__q_n"))
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # capacity rows at most
        histogram[r["length"]] = r["n"]
    runs = spark.sparkContext.broadcast(_runs(plan(histogram, capacity)[0]))  # bounded by rounds x capacity configurations
    before = Window.partitionBy("length").orderBy("__q_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "__q_b", F.coalesce(F.sum("__q_n").over(before), F.lit(0)).alias("__q_base"))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in held.columns]
    local = F.row_number().over(Window.partitionBy("length", "__q_b").orderBy(*order))
    ranked = salted.withColumn("__q_i", local).join(bases, ["length", "__q_b"]).withColumn("__q_rank", F.col("__q_base") + F.col("__q_i") - 1)
    ranked = ranked.select(*held.columns, "__q_rank")
    names = held.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = runs.value
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("__q_rank").to_numpy(zero_copy_only=False)
            i = np.searchsorted(r["key"], (length << 44) + rank, side="right") - 1
            at = rank - r["rank"][i]
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(r["first"][i] + at // r["each"][i]), pa.array(r["offset"][i] + at % r["each"][i] * length)], [*names, "sequence_id", "offset"])

    return arrow_map(ranked, place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces that kept ``ids``: ``sequence_id, ids``.
    At most ``capacity`` ids meet in a group."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
