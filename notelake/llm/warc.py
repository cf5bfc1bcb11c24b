"""WARC archives of pages, and a two-level capture index over them.

Archives are ``.warc.gz`` files with one gzip member a record, so that any
record can be read by a range.  The index has the captures in order of their
reversed-host URL keys, in compressed blocks of some lines; a sparse directory
has one row a block: its first and last key and where it lies.  A lookup
searches the directory by bisection for each key, reads only the blocks that may
hold it, by range and each once, and the records by range.  A directory too
large for one task is itself cut at fence keys, which are searched first.

Tasks write through ``pyarrow.fs``, to the shared folder; each attempt has file
names of its own and only what a finished task reports is ever read.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import materialize

#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 100
#: Lines of an index block.
BLOCK_LINES = 1000
#: Bytes of an archive that a task reads at once.
READ_BYTES = 8 << 20
#: Blocks of a directory that a lookup may broadcast; of a larger one, about so many fence keys.
BROADCAST_BLOCKS = 50_000
#: Digests of payloads that are stored once which a scan of the pages may be given whole; more are joined by shuffle.
BROADCAST_DIGESTS = 500_000
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "key string, page_id long, file string, offset long, length long"
_DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.FileSystem.from_uri(f"file://{uri}") if uri.startswith("/") else fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1)))


def url_key(url: Column) -> Column:
    """Host labels reversed, then the path: ``http://a.example.com/x`` -> ``com,example,a)/x``; a null url has the key ``)``."""
    authority = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, authority, ""), "#.*$", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(path == "", "/").otherwise(path)), F.lit(")"))


def with_revisits(pages: DataFrame) -> DataFrame:
    """``(page_id, url, html, size, digest, refers_to)``: which rows repeat an earlier page's payload.

    Of equal payloads of at least REVISIT_BYTES the smallest page_id is kept
    whole, the others refer to it.  A null html is empty.  A row without a
    page_id is always kept whole; so are rows that repeat the smallest id.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumns({"size": F.octet_length("html").cast("long"), "digest": F.sha2("html", 256)})
    first = p.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    first = materialize(first.where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"))
    # Where few payloads repeat, pages needn't be shuffled.
    p = p.join(F.broadcast(first) if first.count() <= BROADCAST_DIGESTS else first, p.digest == first.d, "left")
    refers = F.when(F.col("page_id") != F.col("first"), F.col("first"))
    return p.select("page_id", "url", F.when(refers.isNull(), F.col("html")).alias("html"), "size", "digest", refers.alias("refers_to"))


def _record(page_id, url, html, size, digest, refers_to, date: str) -> bytes:
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in url or "\n" in url else "WARC-Target-URI: " + url)
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"Payload-Length: {size}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = _HTTP + (html or b"")
    return "\r\n".join([*head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of one record; the payload of a response is hashed anew."""
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = data[end + 4 : end + 4 + int(head["Content-Length"])]
    payload = body[body.index(b"\r\n\r\n") + 4 :]
    kind = head["WARC-Type"]
    whole = kind == "response"
    page = head.get("Page-Id")
    return {
        "page_id": page and int(page), "url": head.get("WARC-Target-URI"), "record_type": kind,
        "payload_bytes": len(payload) if whole else int(head["Payload-Length"]),
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else head["WARC-Payload-Digest"].removeprefix("sha256:"),
        "refers_to": None if whole else int(head["WARC-Refers-To"].strip("<>").rpartition(":")[2]),
        "payload": payload if whole else None,
    }


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each row of ``pages(page_id, url, html)``; returns the captures: key, page_id, file, offset, length.

    Columns beside these three are left out; no rows, no archives.
    """
    rows = with_revisits(pages).withColumn("key", url_key(F.col("url")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name = None, 0, f"{folder}/{uuid.uuid4().hex}.warc.gz"
        for b in batches:
            made: list[tuple] = []
            for r in b.to_pylist():
                if out is None:
                    store, path = _open(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)
                key = r.pop("key")
                data = _gzip(_record(**r, date=date))
                out.write(data)
                made.append((key, r["page_id"], name, at, len(data)))
                at += len(data)
            if made:
                yield _batch(made, [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(each, _INDEX))


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def write_index(captures: DataFrame, folder: str, lines: int = BLOCK_LINES) -> DataFrame:
    """Sort the captures by key into blocks of ``lines`` lines; returns the sparse directory."""
    kinds, names = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()], ["first_key", "last_key", "file", "offset", "length", "lines"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, name, held = None, 0, f"{folder}/{uuid.uuid4().hex}.cdxj.gz", []

        def block() -> pa.RecordBatch:
            nonlocal out, at
            if out is None:
                store, path = _open(name)
                store.create_dir(path.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(path, compression=None)
            data = _gzip("".join(json.dumps([r[c] for c in ("key", "page_id", "file", "offset", "length")]) + "\n" for r in held).encode())
            out.write(data)
            row = (held[0]["key"], held[-1]["key"], name, at, len(data), len(held))
            at += len(data)
            held.clear()
            return _batch([row], kinds, names)

        for b in batches:
            for r in b.to_pylist():
                held.append(r)
                if len(held) == lines:
                    yield block()
        if held:
            yield block()
        if out is not None:
            out.close()

    dealt = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    return materialize(dealt.mapInArrow(each, _DIRECTORY))


_CAPTURE_KINDS, _CAPTURE_NAMES = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()], ["key", "page_id", "file", "offset", "length"]


def _read_block(file: str, offset: int, length: int) -> list[list]:
    """The lines of one index block, read by its range."""
    store, path = _open(file)
    with store.open_input_file(path) as f:
        data = f.read_at(length, offset)
    return [json.loads(line) for line in zlib.decompress(data, 31).decode().splitlines()]


def captures_of(directory: DataFrame) -> DataFrame:
    """All captures, from the blocks that the directory names."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                yield _batch([tuple(x) for x in _read_block(r["file"], r["offset"], r["length"])], _CAPTURE_KINDS, _CAPTURE_NAMES)

    return directory.mapInArrow(each, _INDEX)


_BLOCK = ["first_key", "last_key", "file", "offset", "length"]


def _holding(keys: list[str], blocks: list[dict]) -> list[tuple]:
    """(key, file, offset, length) of the blocks that may hold each key, by bisection in ``blocks`` in order of their keys."""
    firsts, lasts = [r["first_key"] for r in blocks], [r["last_key"] for r in blocks]
    return [(k, r["file"], r["offset"], r["length"]) for k in keys for r in blocks[bisect_left(lasts, k) : bisect_right(firsts, k)]]


def blocks_of(directory: DataFrame, keys: DataFrame) -> DataFrame:
    """``(k, file, offset, length)``: the blocks that may hold each of the distinct ``keys(k)``, by bisection.

    A directory of up to BROADCAST_BLOCKS blocks (their number is checked) goes
    to every task.  A larger one is cut at fence keys, of which there are about
    as many: keys and blocks are dealt to the stretch between two fences, and
    each stretch is searched by a task.  Blocks of one key only, which a hot key
    may have any number of, are met by equality, so that no stretch has them.
    """
    spark, kinds = directory.sparkSession, [pa.string(), pa.string(), pa.int64(), pa.int64()]
    names, schema = ["k", "file", "offset", "length"], "k string, file string, offset long, length long"
    n = directory.count()
    if n <= BROADCAST_BLOCKS:
        blocks = sorted((r.asDict() for r in directory.select(*_BLOCK).collect()), key=lambda r: (r["first_key"], r["last_key"]))
        sent = spark.sparkContext.broadcast(blocks)

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if rows := _holding(b.column(0).to_pylist(), sent.value):
                    yield _batch(rows, kinds, names)

        return keys.mapInArrow(each, schema)
    uniform = directory.where("first_key = last_key")
    equal = keys.join(uniform, keys.k == uniform.first_key).select(*names)
    mixed = directory.where("first_key <> last_key").select(*_BLOCK)
    drawn = mixed.where(F.pmod(F.xxhash64("file", "offset"), F.lit(-(-n // BROADCAST_BLOCKS))) == 0)
    fences = sorted({r["first_key"] for r in drawn.select("first_key").distinct().collect()})
    sent = spark.sparkContext.broadcast(fences)

    @F.pandas_udf("array<int>")
    def stretches(first: pd.Series, last: pd.Series) -> pd.Series:
        own = sent.value
        return pd.Series([list(range(bisect_right(own, a), bisect_right(own, z) + 1)) for a, z in zip(first, last, strict=True)])

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = sorted(right.select(_BLOCK).to_pylist(), key=lambda r: (r["first_key"], r["last_key"]))
        rows = _holding(left.column("k").to_pylist(), blocks)
        return pa.Table.from_batches([_batch(rows, kinds, names)]) if rows else pa.table({c: pa.array([], t) for c, t in zip(names, kinds, strict=True)})

    dealt = keys.select("k", F.explode(stretches("k", "k")).alias("stretch"))
    laid = mixed.select(*_BLOCK, F.explode(stretches("first_key", "last_key")).alias("stretch"))
    return equal.union(dealt.groupBy("stretch").cogroup(laid.groupBy("stretch")).applyInArrow(search, schema))


def lookup(directory: DataFrame, urls: DataFrame) -> DataFrame:
    """Captures of the keys of ``urls(url)``: bisection in the directory, then range reads of the blocks that may hold them.

    Keys are distinct, so a capture comes once however often its url is asked
    for; a null url asks for the captures without one.  What is asked of a block
    comes to one task, which reads it once; a key's blocks go to different tasks.
    """
    keys = urls.select(url_key(F.col("url")).alias("k")).distinct()
    asked = blocks_of(directory, keys).repartition("file", "offset").sortWithinPartitions("file", "offset")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lines = None, {}
        for b in batches:
            rows: list[tuple] = []
            for k, *block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if block != held:
                    held, lines = block, {}
                    for line in _read_block(*block):
                        lines.setdefault(line[0], []).append(tuple(line))
                rows += lines.get(k, ())
            if rows:
                yield _batch(rows, _CAPTURE_KINDS, _CAPTURE_NAMES)

    return asked.mapInArrow(each, _INDEX)


def read_records(captures: DataFrame, payloads: bool = True) -> DataFrame:
    """The records at ``captures(file, offset, length)``; neighbours in an archive are read together."""
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def read(run: list[tuple[str, int, int]]) -> pa.RecordBatch:
        file, first, _ = run[0]
        store, path = _open(file)
        with store.open_input_file(path) as f:
            data = f.read_at(run[-1][1] + run[-1][2] - first, first)
        rows = [parse_record(zlib.decompress(data[o - first : o - first + n], 31)) for _, o, n in run]
        return _batch([tuple(r[c] if payloads or c != "payload" else None for c in names) for r in rows], kinds, names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: list[tuple[str, int, int]] = []
        for b in batches:
            for at in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if run and (at[0] != run[0][0] or at[1] > run[-1][1] + run[-1][2] + 4096 or at[1] + at[2] - run[0][1] > READ_BYTES):
                    yield read(run)
                    run = []
                run.append(at)
        if run:
            yield read(run)

    at = captures.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / (64 << 20))).sortWithinPartitions("file", "offset")
    return at.mapInArrow(each, _RECORD)
