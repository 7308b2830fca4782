"""Token-id output: independent zstandard frames, a trailing seek table, per-frame checksums.

A dataset is a folder of shards; the shards' key ranges do not overlap and follow one another.
A shard is a valid zstandard stream (``zstd -d`` yields its ids, little-endian unsigned 16- or
32-bit) laid out as the public *seekable format*:

* one frame for each document, in ascending ``doc_id`` order (an empty one holds no bytes);
* a skippable frame (magic 0x184D2A50): id width (1 byte), then the documents' ids (int64) and
  null flags, compressed;
* the seek table in a skippable frame (magic 0x184D2A5E): for each frame its compressed size,
  decompressed size and the low 32 bits of the XXH64 of its decompressed bytes, then the
  number of frames, a descriptor (checksums present) and the magic 0x8F92EAB1.

A reader finds a document's place from the two trailing frames alone and decompresses that
frame only. ``manifest`` beside the shards (Parquet) has each shard's name, key range and totals.

Defined results: null text is empty; null ``doc_id`` sorts first; rows of equal ``doc_id`` keep
the order of their texts' hash; an empty table gives a dataset without shards.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, keyed, slices, text_or_empty, width
from quillon.llm.encoder import encoder

#: Fixed values of the zstandard seekable format.
INDEX_MAGIC, TABLE_MAGIC, SEEK_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80

_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("sum", "<u4")])
_MANIFEST = "shard int, name string, n_docs long, n_tokens long, low long, high long"


def _fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith(("file:", "/")) else (fs.LocalFileSystem(), path)


def write_shard(path: str, docs: Iterator[tuple[int | None, np.ndarray]], level: int = 1) -> tuple[int, int, int | None, int | None]:
    """Write documents (already in order) and return documents, tokens, first and last key."""
    store, at = _fs(path)
    pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
    entries, keys, n, wide = [], [], 0, 4
    with store.open_output_stream(at, compression=None) as out:
        for key, ids in docs:
            wide = ids.dtype.itemsize
            raw = ids.tobytes()
            frame = pack.compress(raw)
            out.write(frame)
            entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            keys.append(key)
            n += len(ids)
        ids64 = np.array([k or 0 for k in keys], dtype="<i8").tobytes() + bytes(k is None for k in keys)
        index = bytes([wide]) + pack.compress(ids64)
        out.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(entries, dtype=_ENTRY).tobytes() + struct.pack("<IBI", len(entries), CHECKSUMS, SEEK_MAGIC)
        out.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)
    return len(keys), n, keys[0] if keys else None, keys[-1] if keys else None


class ShardReader:
    """Random access to one shard: reads its two trailing frames, then only the frames asked for."""

    def __init__(self, path: str):
        store, at = _fs(path)
        self.file = store.open_input_file(at)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self._at(end - 9, 9))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"no seek table at the end of {path}")
        begin = end - 9 - n * _ENTRY.itemsize
        self.table = np.frombuffer(self._at(begin, n * _ENTRY.itemsize), dtype=_ENTRY)
        self.places = np.concatenate(([0], np.cumsum(self.table["packed"], dtype=np.int64)))
        first = int(self.places[-1])
        magic, size = struct.unpack("<II", self._at(first, 8))
        if magic != INDEX_MAGIC or first + 8 + size != begin - 8:
            raise ValueError(f"no document index in {path}")
        index = self._at(first + 8, size)
        self.dtype = np.dtype(f"<u{index[0]}")
        raw = zstandard.ZstdDecompressor().decompress(index[1:]) if n else b""
        self.keys, self.null = np.frombuffer(raw[: 8 * n], dtype="<i8"), np.frombuffer(raw[8 * n :], dtype=bool)
        self.unpack = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        return self.file.read_at(size, offset)

    def lengths(self) -> np.ndarray:
        return self.table["size"].astype(np.int64) // self.dtype.itemsize

    def frame(self, i: int, packed: bytes | None = None) -> np.ndarray:
        """The ids of the i-th document; raises if its checksum does not hold."""
        e = self.table[i]
        raw = self.unpack.decompress(packed if packed is not None else self._at(int(self.places[i]), int(e["packed"]))) if e["size"] else b""
        if len(raw) != e["size"] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != e["sum"]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, dtype=self.dtype)

    def all(self, block: int = 8 << 20) -> Iterator[tuple[int, np.ndarray]]:
        """(place, ids) of every document, reading the file in blocks."""
        n, i = len(self.table), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.places, self.places[i] + block)) - 1)
            j = min(j, n)
            data = self._at(int(self.places[i]), int(self.places[j] - self.places[i]))
            for k in range(i, j):
                at = int(self.places[k] - self.places[i])
                yield k, self.frame(k, data[at : at + int(self.table["packed"][k])])
            i = j


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, key: str = "doc_id", text: str = "text", level: int = 1) -> DataFrame:
    """Tokenise ``docs`` and write them under ``path`` (any store pyarrow reaches) in key order.

    One range shuffle of the texts on the key; each task writes a shard of its own under a
    name no other attempt has, and the manifest names those of the tasks that ended, so a
    lost executor leaves at most an unused file. Returns the manifest (a row for each shard).
    """
    spark = docs.sparkSession
    src = keyed(docs, key, text).select(F.col(key).cast("long").alias("k"), text_or_empty(text).alias("t"))
    dealt = src.repartitionByRange(width(spark), "k").sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([] if end_id is None else [end_id], dtype=e.dtype)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.zst"

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for b in slices(batches, "t", 8 << 20):
                ids, at = e.encode(b.column("t"))
                for i, k in enumerate(b.column("k").to_pylist()):
                    yield k, np.concatenate((ids[at[i] : at[i + 1]], end))

        it = rows()
        if (head := next(it, None)) is None:
            return
        n, tokens, low, high = write_shard(f"{path}/{name}", (x for part in ([head], it) for x in part), level)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n_docs": [n], "n_tokens": [tokens], "low": pa.array([low], pa.int64()), "high": pa.array([high], pa.int64())})

    store, at = _fs(path)
    store.create_dir(at, recursive=True)
    # a row for each task, so its size is that of the shuffle's width
    manifest = sorted(arrow_map(dealt, write, _MANIFEST).collect())
    out = spark.createDataFrame(manifest, _MANIFEST).coalesce(1)
    out.write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")


def read_tokens(spark: SparkSession, path: str, keys: list[int] | None = None) -> DataFrame:
    """Read a dataset back: ``doc_id, start, n_tokens, ids`` (``ids`` little-endian unsigned
    32-bit; ``start`` counts the ids of all documents before). With ``keys`` only the shards
    that can hold them are opened and only their frames decompressed."""
    shards = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest").orderBy("shard").collect()
    base, rows = 0, []
    wanted = None if keys is None else np.unique(np.array(keys, dtype=np.int64))
    for s in shards:
        if wanted is None or s.low is None or (s.high is not None and ((wanted >= s.low) & (wanted <= s.high)).any()):
            rows.append((s.name, base))
        base += s.n_tokens
    todo = spark.createDataFrame(rows, "name string, base long").repartition(max(1, len(rows)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, at in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                r = ShardReader(f"{path}/{name}")
                n = r.lengths()
                start = at + np.concatenate(([0], np.cumsum(n)))
                each = r.all() if wanted is None else ((int(i), r.frame(int(i))) for i in np.flatnonzero(np.isin(r.keys, wanted) & ~r.null))
                rows: list[tuple] = []
                held = 0
                for i, ids in each:
                    rows.append((None if r.null[i] else int(r.keys[i]), int(start[i]), int(n[i]), ids.astype("<u4").tobytes()))
                    held += 4 * len(ids)
                    if held > 4 << 20:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return arrow_map(todo, read, "doc_id long, start long, n_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    k, s, n, i = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(i, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """Digest columns of what :func:`read_tokens` gives."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


__all__ = ["ShardReader", "read_tokens", "token_digests", "write_shard", "write_tokens"]
