"""Benchmark decontamination by latent semantic retrieval.

1. Documents become sequences of numbers of the benchmark's words (0: any other word), kept in
   the shared folder; every later pass reads those instead of the texts.
2. Overlapping windows of ``WINDOW`` words are the passages. Their document frequencies give the
   TF-IDF weights, over all passages: every term weighs, also one that a hot group of copies repeats.
3. A randomised SVD of the TF-IDF matrix in one distributed pass: each task sums ``A'(A W)`` over
   its passages for a random ``W``, the sums are added by row, and the driver finishes a Nystroem
   decomposition to the ``RANK`` leading directions of the corpus. Texts without topics lose just the rare words
   that tell passages apart in those, so the benchmark's passages add what they have beyond them.
4. Each passage is folded into the latent space and its cosine there with every benchmark passage
   taken, in blocks. Its length is that of what the space holds of it: words that no passage of the
   benchmark goes with do not hide one (plain TF-IDF cosines, see README, need a threshold that
   lets eight times as many candidates through). Pairs of at least ``COSINE`` are candidates.
5. A candidate counts if the longest common subsequence of words covers ``STRONG`` of the
   benchmark passage, or ``WEAK`` of it and half of its answer (the end of the item).

The benchmark is held on the driver; its latent spaces are made for parts of at most
``PART_PASSAGES`` passages, of which ``PARTS`` are sent to the tasks and looked for in one pass, so
what a task holds is bounded however large the benchmark is. Defined results: null or empty texts match
nothing; items without words are ignored; an item of several passages is found by any of them, by the
one covered best; ties go to the greater cosine; equal and repeated rows get equal answers, null ids too; very long
texts are searched whole; an empty corpus or benchmark gives no matches; in :func:`clean` other columns
pass through, but none may begin with ``__q_``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import PRIVATE, arrow_map, cut, forget, keyed, slices

WINDOW, STRIDE = 32, 16
#: Leading directions of the corpus, random ones more to find them with, passages of a part, words of a passage, parts of a pass.
RANK, MORE, PART_PASSAGES, LONGEST, PARTS = 24, 24, 400, 40, 8
COSINE, STRONG, WEAK = 0.65, 0.8, 0.6

_PUNCTUATION = r"[^\pL\pN]+"


def words(text: str) -> list[str]:
    """Lower-case words without marks; what is only marks is no word."""
    return [w for w in (re.sub(r"[^\w]+|_", "", x.lower()) for x in text.split()) if w]


def word_ids(texts: pa.Array, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all words, where each text's begin and the last's end)."""
    plain = pc.replace_substring_regex(texts, r"[\t\n\r\f\v]", " ")
    lists = pc.split_pattern(plain, " ")
    coded = lists.flatten().dictionary_encode()
    bare = pc.replace_substring_regex(pc.utf8_lower(coded.dictionary), _PUNCTUATION, "")
    table = np.array([vocabulary.get(w, 0) if w else -1 for w in bare.to_pylist()], dtype=np.int32)
    code = table[coded.indices.to_numpy(zero_copy_only=False)]
    real = code >= 0
    at = np.concatenate(([0], np.cumsum(real)))
    return code[real].astype(_kind(vocabulary)), at[lists.offsets.to_numpy() - lists.offsets[0].as_py()]


def _kind(vocabulary: dict[str, int]) -> str:
    return "<u2" if len(vocabulary) < 1 << 16 else "<u4"


@dataclass
class Part:
    """A part of the benchmark: passages in the part's own word numbers, and its latent space."""

    items: list[int]  # item of each passage
    passages: list[list[int]]
    own: np.ndarray  # the part's number of each word of the benchmark, 0 for others
    weights: np.ndarray | None = None  # by the part's numbers
    table: np.ndarray | None = None  # what a word adds to each latent coordinate
    latent: np.ndarray | None = None  # the passages' unit vectors
    masks: list[dict[int, int]] | None = None


def parts(benchmark: DataFrame, key: str = "item_id", text: str = "text") -> tuple[dict[str, int], list[Part]]:
    """The benchmark's words and its passages of ``LONGEST`` words at most."""
    vocabulary: dict[str, int] = {}
    passages: list[tuple[int, list[int]]] = []
    for r in keyed(benchmark, key, text).filter(F.col(text).isNotNull()).orderBy(key).toLocalIterator():
        w = words(r[text])
        while w:
            piece, w = (w, []) if len(w) <= LONGEST else (w[:WINDOW], w[WINDOW:])
            passages.append((r[key], [vocabulary.setdefault(x, len(vocabulary) + 1) for x in piece]))
    out = []
    for some in batched(passages, PART_PASSAGES):
        used = np.unique(np.concatenate([np.array(p) for _, p in some]))
        own = np.zeros(len(vocabulary) + 1, dtype=np.int32)
        own[used] = np.arange(1, len(used) + 1)
        out.append(Part([k for k, _ in some], [own[p].tolist() for _, p in some], own))
    return vocabulary, out


def coded(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """``docs`` with ``__q_codes``: every ``text`` as word numbers."""
    names, kind = docs.columns, _kind(vocabulary)
    if clash := [c for c in names if c.startswith(PRIVATE)]:
        raise ValueError(f"columns may not begin with {PRIVATE}: {', '.join(clash)}")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the benchmark

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids, at = word_ids(b.column("text").fill_null(""), sent.value)
            codes = pa.array([ids[at[i] : at[i + 1]].astype(kind).tobytes() for i in range(b.num_rows)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], codes], [*names, "__q_codes"])

    return arrow_map(docs, run, T.StructType([*docs.schema.fields, T.StructField("__q_codes", T.BinaryType())]))


def _strides(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(strides of ``STRIDE`` word numbers, padded with 0; the first of each text and the end)."""
    n = [max(1, -(-len(r) // STRIDE)) for r in codes]
    flat = np.zeros(sum(n) * STRIDE, dtype=np.int32)
    first = np.concatenate(([0], np.cumsum(n)))
    for r, at in zip(codes, first[:-1] * STRIDE, strict=True):
        flat[at : at + len(r)] = r
    return flat.reshape(-1, STRIDE), first


def _windows(first: np.ndarray) -> np.ndarray:
    """Strides that begin a window (with the next one of the same text, if there is one)."""
    last = np.zeros(first[-1], dtype=bool)
    last[first[1:] - 1] = True
    lone = np.diff(first) == 1
    keep = ~last
    keep[first[:-1][lone]] = True
    return np.flatnonzero(keep)


def _pairs(strides: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows as (starts, word numbers), the lone ones padded."""
    starts = _windows(first)
    inner = np.ones(len(strides), dtype=bool)
    inner[first[1:] - 1] = False
    follow = np.where(inner[starts][:, None], strides[np.minimum(starts + 1, len(strides) - 1)], 0)
    return starts, np.concatenate((strides[starts], follow), 1)


def _batches(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for b in slices(batches, "__q_codes", 1 << 20):
        yield b, *_strides([np.frombuffer(c, dtype=kind) for c in b.column("__q_codes").to_pylist()])


def weigh(codes: DataFrame, n: int, kind: str) -> np.ndarray:
    """Inverse document frequencies of word numbers below ``n`` over all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, dtype=np.int64)
        for _, strides, first in _batches(batches, kind):
            starts, w = _pairs(strides, first)
            w = np.sort(w, 1)
            new = np.ones(w.shape, dtype=bool)
            new[:, 1:] = w[:, 1:] != w[:, :-1]
            total += np.bincount(w[new & (w > 0)], minlength=n)
            total[0] += len(starts)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["w", "n"])

    df = np.zeros(n)
    for r in arrow_map(codes.select("__q_codes"), run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect():  # the vocabulary at most
        df[r["w"]] = r["n"]
    weights = (np.log((1 + df[0]) / (1 + np.minimum(df, df[0]))) + 1e-3).astype(np.float32)
    weights[0] = 0
    return weights


def _sums(strides: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The table's rows summed over each stride's words (row 0, of other words, is zero)."""
    out = np.zeros((len(strides), table.shape[1]), dtype=np.float32)
    for words_ in strides.T:
        out += table.take(words_, 0)
    return out


def directions(codes: DataFrame, weights: np.ndarray, kind: str, seed: int = 9) -> np.ndarray:
    """The corpus's ``RANK`` leading directions, a column each, by word numbers."""
    m, size = len(weights), RANK + MORE
    omega = np.random.default_rng(seed).standard_normal((m, size)).astype(np.float32) * (weights > 0)[:, None]
    sent = codes.sparkSession.sparkContext.broadcast((omega * weights[:, None], weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, weights = sent.value
        total = np.zeros(table.shape, dtype=np.float32)
        for _, strides, _ in _batches(batches, kind):
            for at in range(0, len(strides), 2048):
                own = strides[at : at + 2048]
                s = _sums(own, table)
                row, col = np.nonzero(own)
                word = own[row, col]
                order = np.argsort(word, kind="stable")
                begin = np.flatnonzero(np.concatenate(([True], np.diff(word[order]) != 0))) if len(word) else []
                if len(begin):
                    total[word[order][begin]] += np.add.reduceat(s.take(row[order], 0), begin, axis=0)
        total *= weights[:, None]
        used = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array([total[i].tobytes() for i in used], pa.binary())], ["t", "y"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[int, np.ndarray] = {}
        for b in batches:
            for t, y in zip(b.column("t").to_pylist(), b.column("y").to_pylist(), strict=True):
                v = np.frombuffer(y, dtype=np.float32).astype(np.float64)
                by[t] = by[t] + v if t in by else v
        yield pa.RecordBatch.from_arrays([pa.array(list(by), pa.int64()), pa.array([v.tobytes() for v in by.values()], pa.binary())], ["t", "y"])

    y = np.zeros((m, size))
    for r in arrow_map(arrow_map(codes.select("__q_codes"), run, "t long, y binary").repartition("t"), add, "t long, y binary").collect():  # a row for each term
        y[r["t"]] = np.frombuffer(r["y"])
    core = omega.astype(np.float64).T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = np.flatnonzero(values > 1e-10 * max(values[-1], 1e-30))[-RANK:]
    return y @ (vectors[:, keep] / np.sqrt(values[keep]))


def fold(part: Part, weights: np.ndarray, leading: np.ndarray) -> None:
    """The part's latent space: the leading directions as its words see them, then what its passages
    have beyond them."""
    used = np.flatnonzero(part.own)
    part.weights = np.concatenate(([0], weights[used])).astype(np.float32)
    items = np.zeros((len(part.passages), len(part.weights)))
    for i, p in enumerate(part.passages):
        np.add.at(items[i], p, part.weights[p])
    items /= np.maximum(np.linalg.norm(items, axis=1, keepdims=True), 1e-9)
    seen = np.concatenate((np.zeros((1, leading.shape[1])), leading[used]))

    def independent(x: np.ndarray) -> np.ndarray:
        u, values, _ = np.linalg.svd(x, full_matrices=False)
        return u[:, values > 1e-6 * max(values.max(initial=0.0), 1e-30)]

    space = independent(seen)
    beyond = items.T - space @ (space.T @ items.T)
    space = np.concatenate((space, independent(beyond)), 1)
    part.latent = (items @ space).astype(np.float32)
    part.table = np.ascontiguousarray(part.weights[:, None] * space, dtype=np.float32)  # by rows: else each take of :func:`_sums` copies it whole
    part.masks = []
    for p in part.passages:
        mask: dict[int, int] = {}
        for i, w in enumerate(p):
            mask[w] = mask.get(w, 0) | 1 << i
        part.masks.append(mask)


def common_length(sequence: list[int], mask: dict[int, int], n: int) -> int:
    """Length of the longest common subsequence with a passage of ``n`` words, by bit rows."""
    full = (1 << n) - 1
    v = full
    for w in sequence:
        if m := mask.get(w):
            u = v & m
            v = (v + u) | (v - u)
    return n - (v & full).bit_count()


def _answer(n: int) -> int:
    """Words of a passage of ``n`` that are its answer: the last fifth, three at least."""
    return min(n, max(3, -(-n // 5)))


def matches(strides: np.ndarray, first: np.ndarray, part: Part) -> list[tuple[int, int, float, float, int]]:
    """(text, passage, share covered, cosine, first word of the region) of what counts."""
    strides = part.own.take(strides)
    starts = _windows(first)
    inner = np.ones(len(strides), dtype=bool)
    inner[first[1:] - 1] = False
    best: dict[tuple[int, int], tuple[float, float, int]] = {}
    owner = np.searchsorted(first, starts, side="right") - 1
    for at in range(0, len(starts), 2048):
        own = starts[at : at + 2048]
        lo, hi = int(own[0]), min(int(own[-1]) + 2, len(strides))
        s = _sums(strides[lo:hi], part.table)
        follow, last = np.minimum(own + 1, len(strides) - 1), inner[own]
        z = s[own - lo]
        z[last] += s[follow[last] - lo]
        sims = z @ part.latent.T
        sims /= np.sqrt(np.maximum((z * z).sum(1), 1e-9))[:, None]
        for i, p in zip(*np.nonzero(sims >= COSINE), strict=True):
            k = at + int(i)
            text, mask, n = int(owner[k]), part.masks[p], len(part.passages[p])
            near = -(-n // STRIDE) - 1
            begin, end = max(first[text], starts[k] - near), min(first[text + 1], starts[k] + 2 + near)
            region = strides[begin:end].ravel()
            region = region[region > 0].tolist()
            share = common_length(region, mask, n) / n
            if share < WEAK:
                continue
            if share < STRONG:
                a = _answer(n)
                tail = {w: m >> (n - a) for w, m in mask.items() if m >> (n - a)}
                if common_length(region, tail, a) < a / 2:
                    continue
            if share > best.get((text, int(p)), (0,))[0]:
                best[text, int(p)] = (share, float(sims[i, p]), int((begin - first[text]) * STRIDE))
    return [(t, p, *v) for (t, p), v in sorted(best.items())]


def fit(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, str, Iterator[list[Part]]]:
    """The documents with their codes, the codes' type, and the parts of each pass over them."""
    vocabulary, every = parts(benchmark)
    kind = _kind(vocabulary)
    codes = cut(coded(docs, vocabulary), "codes")

    def passes() -> Iterator[list[Part]]:
        if every:
            weights = weigh(codes, len(vocabulary) + 1, kind)
            leading = directions(codes, weights, kind)
        for some in batched(every, PARTS):
            for part in some:
                fold(part, weights, leading)
            yield list(some)

    return codes, kind, passes()


FOUND = "item_id long, covered double, cosine double, at_word long"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, covered, cosine, at_word`` of every document that holds an item: its
    best covered passage, its cosine, and the word where the region around it begins."""
    spark = docs.sparkSession
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FOUND}"
    codes, kind, passes = fit(keyed(docs, "doc_id", "text").filter("text is not null"), benchmark)
    out = spark.createDataFrame([], schema)
    for some in passes:
        sent = spark.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b, strides, first in _batches(batches, kind):
                by: dict[tuple[int, int], tuple] = {}
                for part in sent.value:
                    for t, p, *rest in matches(strides, first, part):
                        k = (t, part.items[p])
                        by[k] = max(by.get(k, (0.0,)), tuple(rest))
                if by:
                    rows = pa.array([t for t, _ in by], pa.int64())
                    covered, cosine, at = zip(*by.values(), strict=True)
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").take(rows), pa.array([i for _, i in by], pa.int64()), pa.array(covered, pa.float64()), pa.array(cosine, pa.float64()), pa.array(at, pa.int64())], ["doc_id", "item_id", "covered", "cosine", "at_word"])

        out = out.unionByName(cut(arrow_map(codes.select("doc_id", "__q_codes"), run, schema), "found"))
    forget(codes)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns: texts are matched where
    they are, so nothing is shuffled or joined."""
    codes, kind, passes = fit(docs, benchmark)
    out = codes
    for some in passes:
        sent = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for b, strides, first in _batches(batches, kind):
                bad = {t for part in sent.value for t, *_ in matches(strides, first, part)}
                yield b.filter(pa.array([i not in bad for i in range(b.num_rows)], pa.bool_()))

        out = arrow_map(out, run, codes.schema)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
