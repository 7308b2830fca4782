"""WARC records, and resolving *not modified* revisits to the responses they repeat.

:func:`read_warc` streams records out of WARC files (plain or a gzip member a record).
:func:`resolve_revisits` is an as-of join: a revisit takes the latest earlier full response of
its canonical URL. One URL may hold a third of all records, so records are split by time blocks
(quantiles of the time) as well as by URL: the latest response within the block comes from a
window, the one before the block from a summary of one row a block and URL. If the validators
of the two agree, the revisit gets the response's headers, updated by those that a 304 may carry.

Defined results: a revisit without URL, time or earlier response is ``missing``; several
responses at one time count by the greatest ``record_id``; a response at the revisit's own time
is not earlier; equal records each get an answer; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import arrow_map, keyed, width

#: Header fields that a 304 answer may carry (RFC 9110, 15.4.5).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
RECORD = "record_id string, url string, ts long, kind string, status int, headers map<string,string>, digest string, body binary"


# ---- reading and writing files


def warc_record(kind: str, url: str, date: str, record_id: str, headers: dict[str, str], body: bytes = b"", status: str = "200 OK", digest: str | None = None) -> bytes:
    """One WARC/1.1 record with an HTTP answer as its block."""
    http = f"HTTP/1.1 {status}\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + "\r\n"
    block = http.encode() + body
    named = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, "WARC-Target-URI": url, "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    if digest:
        named["WARC-Payload-Digest"] = digest
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named.items()) + "\r\n").encode() + block + b"\r\n\r\n"


def _plain(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """The file's bytes, gzip members unpacked one after another."""
    first = stream.read(block)
    packed = first[:2] == b"\x1f\x8b"
    data, inflate = first, zlib.decompressobj(31)
    while data:
        if not packed:
            yield data
            data = stream.read(block)
            continue
        yield inflate.decompress(data)
        if inflate.eof:
            data, inflate = inflate.unused_data, zlib.decompressobj(31)
            data = data or stream.read(block)
        else:
            data = stream.read(block)


def _fields(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8", "replace").split("\r\n")
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return first, out


def records(chunks: Iterator[bytes]) -> Iterator[dict]:
    """Records of a WARC stream; only one is held at a time."""
    held = b""

    def need(n: int) -> bool:
        nonlocal held
        more = []
        size = len(held)
        while size < n:
            part = next(chunks, None)
            if part is None:
                held += b"".join(more)
                return False
            more.append(part)
            size += len(part)
        held += b"".join(more)
        return True

    while True:
        held = held.lstrip(b"\r\n")
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not need(len(held) + 1):
                return
            held = held.lstrip(b"\r\n")
        _, head = _fields(held[:end])
        size = int(head.get("content-length", 0))
        need(end + 4 + size)
        block, held = held[end + 4 : end + 4 + size], held[end + 4 + size :]
        if head.get("warc-type") in ("response", "revisit"):
            top, _, body = block.partition(b"\r\n\r\n")
            status, headers = _fields(top)
            code = status.split(" ")[1:2]
            yield {"record_id": head.get("warc-record-id", "").strip("<>"), "url": head.get("warc-target-uri"), "ts": head.get("warc-date"), "kind": head["warc-type"], "status": int(code[0]) if code and code[0].isdigit() else None, "headers": headers, "digest": head.get("warc-payload-digest"), "body": body}


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Response and revisit records of WARC files; ``ts`` is in microseconds of UTC."""
    todo = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime

        kind = pa.schema([("record_id", pa.string()), ("url", pa.string()), ("ts", pa.int64()), ("kind", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("digest", pa.string()), ("body", pa.binary())])
        for b in batches:
            for p in b.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(p) if "://" in p or p.startswith(("file:", "/")) else (fs.LocalFileSystem(), p)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as f:
                    for r in records(_plain(f)):
                        when = r["ts"] and datetime.fromisoformat(r["ts"].replace("Z", "+00:00"))
                        r["ts"] = when and round(when.timestamp() * 1_000_000)
                        r["headers"] = list(r["headers"].items())
                        rows.append(r)
                        size += len(r["body"])
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return arrow_map(todo, run, RECORD)


# ---- resolving


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.``, default port, fragment, tracking parameters (``utm_*``, ``ref``) and the
    last slash go; the host is lower-cased and parameters are sorted."""
    bare = F.regexp_replace(F.regexp_replace(url, r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(bare, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(bare, r"\?(.*)$", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def _value(entries: Column, name: str) -> Column:
    found = F.filter(entries, lambda e: e["key"] == name)
    return F.when(F.size(found) > 0, found[0]["value"])


def _weak(etag: Column) -> Column:
    return F.regexp_replace(etag, "^W/", "")


def _time_blocks(rows: DataFrame) -> list[int]:
    n = min(256, max(64, width(rows.sparkSession)))
    cuts = rows.agg(F.percentile_approx("ts", [i / n for i in range(1, n)], 10_000).alias("c")).first()["c"]
    return sorted(set(cuts or []))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """A row for each revisit of ``record_id, url, ts, kind, headers, digest`` rows:
    ``record_id, canonical_url, ts, resolved_id, resolved_ts, outcome, headers`` with ``outcome``
    ``resolved``, ``mismatch`` (a validator differs), ``unverified`` (none in common) or
    ``missing``; ``headers`` (entries in order of name) are merged if resolved, else its own."""
    rows = keyed(captures, "record_id", "url", "ts", "kind", "headers", "digest")
    entries = F.array_sort(F.transform(F.map_entries(F.coalesce("headers", F.expr("cast(map() as map<string,string>)"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
    rows = rows.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long").alias("ts"), (F.col("kind") == "response").alias("__q_full"), entries.alias("headers"), "digest")
    placed = rows.filter("canonical_url is not null and ts is not null and __q_full is not null")
    cuts = _time_blocks(placed)
    block = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("ts"))) if cuts else F.lit(0)
    stored = F.when(F.col("__q_full"), F.struct("ts", "record_id", "headers", "digest"))
    events = placed.select("*", block.alias("__q_block"), stored.alias("__q_own"))
    earlier = Window.partitionBy("canonical_url", "__q_block").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    within = events.select("*", F.max("__q_own").over(earlier).alias("__q_in")).filter("not __q_full")
    last = events.filter("__q_full").groupBy("canonical_url", "__q_block").agg(F.max("__q_own").alias("__q_last"))
    marks = last.select("canonical_url", "__q_block", "__q_last").unionByName(events.filter("not __q_full").select("canonical_url", "__q_block").distinct().select("*", F.lit(None).cast(last.schema["__q_last"].dataType).alias("__q_last")))
    marks = marks.groupBy("canonical_url", "__q_block").agg(F.max("__q_last").alias("__q_last"))
    blocks_before = Window.partitionBy("canonical_url").orderBy("__q_block").rowsBetween(Window.unboundedPreceding, -1)
    before = marks.select("canonical_url", "__q_block", F.max("__q_last").over(blocks_before).alias("__q_before"))
    found = within.join(before, ["canonical_url", "__q_block"], "left").withColumn("__q_hit", F.coalesce("__q_in", "__q_before"))
    none = rows.filter("(canonical_url is null or ts is null) and not coalesce(__q_full, true)").select("*", F.lit(None).cast(last.schema["__q_last"].dataType).alias("__q_hit"))
    kept = ["record_id", "canonical_url", "ts", "headers", "digest", "__q_hit"]
    out = found.select(*kept).unionByName(none.select(*kept))
    h = F.col("__q_hit")
    own, its = F.col("headers"), h["headers"]
    agree = F.coalesce(
        _weak(_value(own, "etag")) == _weak(_value(its, "etag")),
        _value(own, "last-modified") == _value(its, "last-modified"),
        F.col("digest") == h["digest"],
    )
    outcome = F.when(h.isNull(), "missing").when(agree, "resolved").when(~agree, "mismatch").otherwise("unverified")
    allowed = F.array(*map(F.lit, PERMITTED))
    news = F.filter(own, lambda e: F.array_contains(allowed, e["key"]))
    olds = F.filter(its, lambda e: ~F.array_contains(F.transform(news, lambda n: n["key"]), e["key"]))
    merged = F.when(F.col("outcome") == "resolved", F.array_sort(F.concat(olds, news))).otherwise(own)
    return out.withColumn("outcome", outcome).select("record_id", "canonical_url", "ts", h["record_id"].alias("resolved_id"), h["ts"].alias("resolved_ts"), "outcome", merged.alias("headers"))


def header_text(entries: str | Column) -> Column:
    """``name: value`` lines of header entries."""
    return F.array_join(F.transform(F.col(entries) if isinstance(entries, str) else entries, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


__all__ = ["PERMITTED", "canonical_url", "header_text", "read_warc", "records", "resolve_revisits", "warc_record"]
