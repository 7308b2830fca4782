"""Language identification with a byte convolutional network.

The network reads fixed-length windows of bytes: filters of widths 2, 3 and 4 over one-hot
bytes, rectified, max-pooled over the window, then a softmax layer. It is trained in numpy on the
driver from a bounded sample of labelled documents (``per_language`` each, a documented
parameter) and applied to every window of every text; a text's class scores are the mean of its
windows', weighted by their bytes. A filter over one-hot bytes is a table of 256 rows, so the
convolution is a sum of look-ups, and those of neighbouring bytes share one 65,536-row table.

Defined results: null text, or text without a letter, is ``und`` with score 0; without any
labelled row everything is ``und``; equal texts get equal predictions, ties go to the first language
in order; rows that repeat a text under one id are learnt from once; null ids are predicted like
others; very long texts are read whole, window by window; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, keyed, slices

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 8
#: Training takes this many steps at least, however few windows there are.
STEPS = 300


def windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, bytes in each, number of the text each is of); A-Z are lower-cased."""
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    n = [max(1, -(-len(r) // WINDOW)) for r in raw]
    flat = np.frombuffer(b"".join(r.ljust(k * WINDOW, b"\0") for r, k in zip(raw, n, strict=True)), dtype=np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), n)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    size = np.minimum(WINDOW, np.repeat([len(r) for r in raw], n) - WINDOW * (np.arange(len(owner)) - first[owner]))
    return flat, np.maximum(size, 0), owner


@dataclass
class ByteCnn:
    classes: list[str]
    tables: dict[int, np.ndarray]  # width -> (width, 256, FILTERS)
    bias: np.ndarray  # (len(WIDTHS), FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, classes)
    out_bias: np.ndarray
    _pairs: dict = field(default_factory=dict, repr=False)

    @classmethod
    def new(cls, classes: list[str], seed: int = 5) -> ByteCnn:
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
        return cls(classes, {w: draw(w, 256, FILTERS, scale=0.3) for w in WIDTHS}, np.zeros((len(WIDTHS), FILTERS), np.float32), draw(len(WIDTHS) * FILTERS, len(classes), scale=0.2), np.zeros(len(classes), np.float32))

    def _conv(self, codes: np.ndarray, win: np.ndarray, w: int) -> np.ndarray:
        """Outputs of the filters of width ``w``: (windows, places, FILTERS)."""
        t = self.tables[w]
        if w not in self._pairs:
            pair = lambda j: (t[j][:, None] + t[j + 1][None]).reshape(1 << 16, FILTERS)
            self._pairs[w] = (pair(0), pair(2) if w == 4 else None)
        a, b = self._pairs[w]
        if w == 2:
            return a.take(codes, 0)
        got = a.take(codes[:, : WINDOW - w + 1], 0)
        got += t[2].take(win[:, 2:], 0) if w == 3 else b.take(codes[:, 2:], 0)
        return got

    def pooled(self, win: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        codes = (win[:, :-1].astype(np.int32) << 8) | win[:, 1:]
        outs, at = [], []
        for i, w in enumerate(WIDTHS):
            c = self._conv(codes, win, w)
            if places:
                at.append(c.argmax(1))
            outs.append(np.maximum(c.max(1) + self.bias[i], 0))
        return np.concatenate(outs, 1), at

    def logits(self, win: np.ndarray, block: int = 256) -> np.ndarray:
        return np.concatenate([self.pooled(win[i : i + block])[0] @ self.out + self.out_bias for i in range(0, len(win), block)])

    def fit(self, win: np.ndarray, y: np.ndarray, epochs: int = 5, batch: int = 128, rate: float = 0.01, seed: int = 6) -> None:
        """Adam on the cross entropy. Only a filter's best place in a window has a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.tables.values(), self.bias, self.out, self.out_bias]
        m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        step = 0
        share = len(y) / (len(self.classes) * np.maximum(np.bincount(y, minlength=len(self.classes)), 1))
        for _ in range(max(epochs, -(-STEPS // max(1, len(y) // batch)))):
            for idx in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
                self._pairs.clear()
                w, t = win[idx], y[idx]
                h, at = self.pooled(w, places=True)
                z = h @ self.out + self.out_bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(t)), t] -= 1
                p *= share[t][:, None] / len(t)
                gh = (p @ self.out.T) * (h > 0)
                grads = []
                for i, k in enumerate(WIDTHS):
                    g, part = np.zeros_like(self.tables[k]), gh[:, i * FILTERS : (i + 1) * FILTERS]
                    for j in range(k):
                        byte = np.take_along_axis(w, at[i] + j, 1)
                        np.add.at(g[j], (byte, np.broadcast_to(np.arange(FILTERS), byte.shape)), part)
                    grads.append(g)
                grads += [gh.sum(0).reshape(len(WIDTHS), FILTERS), h.T @ p, p.sum(0)]
                step += 1
                for q, g, a, b in zip(params, grads, m1, m2, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.001 * (g * g - b)
                    q -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self._pairs.clear()

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        win, size, owner = windows(texts)
        weight = np.maximum(size, 1).astype(np.float64)
        z = np.zeros((len(texts), len(self.classes)))
        np.add.at(z, owner, self.logits(win) * weight[:, None])
        z /= np.bincount(owner, weight, len(texts))[:, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = p.argmax(1)
        return [self.classes[i] for i in best], p[np.arange(len(texts)), best]


def bounded_sample(rows: DataFrame, label: str, keys: list[str], most: int) -> DataFrame:
    """About ``most`` rows of each label at most, no two with the same ``keys``: every row of a rare
    label, an even share of a common one, drawn by the keys' hash. Shares come to the driver (a
    number for each label; labels are few) and go into the filter, so only drawn rows are shuffled."""
    names = [F.col(c).cast("string") for c in keys]
    counts = rows.groupBy(label).agg(F.approx_count_distinct(F.xxhash64(*names), 0.02).alias("n")).collect()
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label) == F.lit(r[label]), F.lit(most / max(r["n"], most))).otherwise(share)
    draw = F.pmod(F.xxhash64(*names, F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < share).dropDuplicates([label, *keys])


def train(labelled: DataFrame, per_language: int = 600, per_text: int = 8) -> ByteCnn | None:
    """Fit on ``doc_id, text, lang`` rows: about ``per_language`` texts of each language, and of
    each up to ``per_text`` windows spread evenly over it."""
    rows = bounded_sample(keyed(labelled, "doc_id", "text", "lang").filter("text is not null and lang is not null"), "lang", ["doc_id", "text"], per_language)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            lang, out, ids = b.column("lang").to_pylist(), [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                win, size, _ = windows([t])
                full = np.flatnonzero(size >= min(64, size[0]))
                for k in np.unique(full[np.linspace(0, len(full) - 1, min(per_text, len(full))).astype(int)]):
                    out.append((lang[i], win[k].tobytes()))
                    ids.append(i)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(ids, pa.int64())).cast(pa.string()), pa.array([x for x, _ in out], pa.string()), pa.array([x for _, x in out], pa.binary())], ["k", "lang", "win"])

    got = sorted(arrow_map(rows.select("doc_id", "text", "lang"), take, "k string, lang string, win binary").collect())
    if not got:
        return None
    classes = sorted({r["lang"] for r in got})
    net = ByteCnn.new(classes)
    if len(classes) > 1:
        at = {c: i for i, c in enumerate(classes)}
        net.fit(np.stack([np.frombuffer(r["win"], dtype=np.uint8) for r in got]), np.array([at[r["lang"]] for r in got]))
    return net


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def identify(docs: DataFrame, net: ByteCnn | None) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs`` (``doc_id, text``)."""
    src = keyed(docs, "doc_id", "text")
    kind = src.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(net)  # a few hundred kB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in slices(batches, most_bytes=2 << 20):
            texts = b.column("text").to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            real = [i for i, t in enumerate(texts) if model and has_letter(t)]
            if real:
                got, p = model.predict([texts[i] for i in real])
                score[real] = p
                for i, x in zip(real, got, strict=True):
                    lang[i] = x
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return arrow_map(src, run, f"doc_id {kind}, lang_pred string, score double")


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null keys give null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


__all__ = ["ByteCnn", "bounded_sample", "fold", "has_letter", "identify", "train", "windows"]
