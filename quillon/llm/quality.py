"""Quality classifier: similarity-weighted votes of labelled neighbours in a latent space.

Terms are of two kinds, each hashed and counted over the whole text: byte trigrams, and pairs of
successive words by their shapes (which classes of characters a word runs through, and whether it
is the word before it again). A bounded sample of labelled documents
(``per_label`` of each label, a documented parameter) gives the inverse document frequencies, a
randomised SVD of its TF-IDF matrix gives the latent space, and the sample's latent vectors with
their labels are broadcast: a few megabytes fixed by the parameters, not by the input. Every
document is folded into the space and compared exactly, in blocks, with all of them; the
nearest ``k`` vote with their similarities. Where one label was sampled more thinly than the
other, its votes count for the rows they stand for.

Defined results: null or empty text has no similarity to anything and scores the labelled rows'
mean; without labelled rows every score is 0.5; several labels of one document count as the least, of
labelled rows that share an id the least text is learnt from; ties between neighbours go by their order;
equal texts score alike; very long texts are counted whole; other columns pass through, but none may
begin with ``__q_``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import PRIVATE, arrow_map, keyed, slices, text_or_empty
from quillon.llm.langid import bounded_sample

TERMS, SHAPES, RANK, NEIGHBOURS, SHARPNESS = 4096, 1024, 64, 25, 6.0
#: Weight of the trigrams' share of a vector against that of the shapes.
TRIGRAMS = 0.5
#: Runs of characters that make a word's shape, and the mark of a word that repeats the one before.
RUNS, REPEATED = 4, np.uint32(0x5BD1E995)
#: Classes of bytes: 0 white space, 1 letters (and all beyond ASCII), 2 digits, each other one by itself.
_CLASS = np.arange(256, dtype=np.uint32) + 3
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_CLASS[48:58] = 2
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_PLACES = np.random.default_rng(7).integers(0, 1 << 63, 64, dtype=np.uint64)


def trigram_counts(texts: list[str]) -> np.ndarray:
    """Hashed byte-trigram counts, a row for each text."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    size = np.array([len(r) for r in raw])
    b = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros((len(texts), TERMS), dtype=np.int64)
    h = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64), size)
    inside = owner[:-2] == owner[2:]
    return np.bincount(owner[:-2][inside] * TERMS + h[inside], minlength=len(texts) * TERMS).reshape(-1, TERMS)


def shape_counts(texts: list[str]) -> np.ndarray:
    """Hashed counts of pairs of successive words' shapes, a row for each text."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    begin = np.concatenate(([1], np.cumsum([len(r) + 1 for r in raw]) + 1))[:-1]
    data = np.frombuffer(b" " + b" ".join(raw) + b" ", dtype=np.uint8)
    kind = _CLASS[data]
    black = kind != 0
    first = np.flatnonzero(black[1:] & ~black[:-1]) + 1
    if len(first) < 2:
        return np.zeros((len(texts), SHAPES), dtype=np.int64)
    length = np.flatnonzero(black[:-1] & ~black[1:]) + 1 - first
    # which words are the same: a sum over their bytes and places
    at = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(at, length)
    word = np.add.reduceat((data[black].astype(np.uint64) + np.uint64(1)) * _PLACES[place & 63], at)
    runs = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    runs = runs[black[runs]]
    run = np.searchsorted(runs, first)
    count = np.diff(np.append(run, len(runs)))
    shape = np.zeros(len(first), dtype=np.uint32)
    for i in range(RUNS):
        more = count > i
        shape[more] = shape[more] * np.uint32(31) + kind[runs[run[more] + i]]
    owner = np.searchsorted(begin, first, side="right") - 1
    inside = owner[1:] == owner[:-1]
    shape[1:][inside & (word[1:] == word[:-1]) & (length[1:] == length[:-1])] ^= REPEATED
    pair = ((shape[:-1] * np.uint32(31) + shape[1:]) * np.uint32(2654435761))[inside] >> np.uint32(22)
    return np.bincount(owner[1:][inside] * SHAPES + pair, minlength=len(texts) * SHAPES).reshape(-1, SHAPES)


def term_counts(texts: list[str]) -> np.ndarray:
    return np.concatenate((trigram_counts(texts), shape_counts(texts)), 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """TF-IDF rows of unit length, each kind of terms with its weight."""
    x = np.log1p(counts, dtype=np.float32) * idf
    return _unit(np.concatenate((TRIGRAMS * _unit(x[:, :TERMS]), _unit(x[:, TERMS:])), 1))


@dataclass
class Neighbours:
    idf: np.ndarray
    basis: np.ndarray  # (TERMS + SHAPES, RANK)
    vectors: np.ndarray  # (labelled, RANK), of unit length
    labels: np.ndarray
    votes: np.ndarray  # rows each labelled document stands for
    mean: float

    def score(self, texts: list[str]) -> np.ndarray:
        z = _unit(weighted(term_counts(texts), self.idf) @ self.basis)
        sims = z @ self.vectors.T
        k = min(NEIGHBOURS, sims.shape[1])
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
        w = np.maximum(np.take_along_axis(sims, top, 1), 0).astype(np.float64) ** SHARPNESS * self.votes[top]
        total = w.sum(1)
        return np.where(total > 1e-12, (w * self.labels[top]).sum(1) / np.maximum(total, 1e-12), self.mean)


def _basis(x: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Right singular vectors by randomised SVD with two power iterations."""
    rng = np.random.default_rng(seed)
    q = x @ rng.standard_normal((x.shape[1], rank + 8), dtype=np.float32)
    for _ in range(2):
        q, _ = np.linalg.qr(q)
        q, _ = np.linalg.qr(x.T @ q)
        q = x @ q
    q, _ = np.linalg.qr(q)
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_label: int = 2048) -> Neighbours | None:
    """Fit on the rows of ``labels`` (``doc_id, quality``) with a text in ``docs``."""
    marked = keyed(labels, "doc_id", "quality").filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = bounded_sample(marked, "quality", ["doc_id"], per_label).collect()  # about 2 x per_label rows
    if not some:
        return None
    chosen = docs.sparkSession.createDataFrame(some, marked.schema)
    src = keyed(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")
    src = src.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most_bytes=1 << 20):
            texts = b.column("text").to_pylist()
            packed = [zlib.compress(np.minimum(term_counts([t])[0], 65535).astype("<u2").tobytes(), 1) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("quality"), pa.array(packed, pa.binary())], ["k", "quality", "x"])

    got = sorted(arrow_map(src, count, "k string, quality int, x binary").collect())
    if not got:
        return None
    counts = lambda rows: np.stack([np.frombuffer(zlib.decompress(r["x"]), dtype="<u2") for r in rows])
    y = np.array([r["quality"] for r in got], dtype=np.float64)
    parts = range(0, len(got), 256)  # so many at a time: the driver holds the sample's weights once
    idf = (np.log((1 + len(got)) / (1 + sum((counts(got[i : i + 256]) > 0).sum(0) for i in parts))) + 1).astype(np.float32)
    x = np.empty((len(got), TERMS + SHAPES), dtype=np.float32)
    for i in parts:
        x[i : i + 256] = weighted(counts(got[i : i + 256]), idf)
    total = sum(sizes.values())
    basis = _basis(x, min(RANK, len(got)))
    model = Neighbours(idf, basis, _unit(x @ basis), y, np.ones(len(y)), sizes.get(1, 0) / total)
    for label in (0, 1):
        own = y == label
        model.votes[own] = sizes.get(label, 0) / max(1, own.sum())
    return model


def score(docs: DataFrame, model: Neighbours | None) -> DataFrame:
    """``doc_id, score`` for every row of ``docs`` (``doc_id, text``), and its other columns."""
    names = docs.columns
    if clash := [c for c in names if c.startswith(PRIVATE)]:
        raise ValueError(f"columns may not begin with {PRIVATE}: {', '.join(clash)}")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for part in slices(batches, most_bytes=1 << 20):
            for at in range(0, part.num_rows, 256):
                b = part.slice(at, 256)
                texts = [t or "" for t in b.column("text").to_pylist()]
                p = m.score(texts) if m else np.full(len(texts), 0.5)
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(p)], [*names, "__q_score"])

    return arrow_map(docs, run, f"{fields}, __q_score double")


def accept(docs: DataFrame, model: Neighbours | None, least: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with the columns of ``docs``."""
    return score(docs, model).filter(F.col("__q_score") >= least).drop("__q_score")
