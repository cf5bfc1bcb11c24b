import gzip
import hashlib

from conftest import DATA

from notelake.llm import warc

SCHEMA = "page_id long, url string, html string"


def build(spark, df, folder, lines=warc.BLOCK_LINES):
    folder = f"file://{folder}"
    return warc.write_index(warc.write_archives(df, folder), folder, lines)


def test_archives_are_read_back(spark, tmp_path):
    df = spark.read.parquet(f"{DATA}/pages.parquet")
    directory = build(spark, df, tmp_path, 7)
    pages = {r.page_id: r for r in df.collect()}
    got = warc.read_records(warc.captures_of(directory)).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        html = (pages[r.page_id].html or "").encode()
        assert r.url == pages[r.page_id].url and r.payload_bytes == len(html) and r.payload_digest == hashlib.sha256(html).hexdigest()
        assert r.record_type == "revisit" or bytes(r.payload) == html
    files = list(tmp_path.glob("*.warc.gz"))
    text = b"".join(gzip.open(f).read() for f in files)
    assert text.count(b"WARC/1.1\r\n") >= len(pages)


def test_index_is_sorted_and_searched(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://{'abc'[i % 3]}.example.com/p{i % 40}", f"page {i}") for i in range(300)], SCHEMA)
    directory = build(spark, df, tmp_path, 10)
    blocks = sorted(directory.collect(), key=lambda r: (r.first_key, r.last_key))
    assert sum(r.lines for r in blocks) == 300 and all(a.last_key <= b.first_key for a, b in zip(blocks, blocks[1:], strict=False))
    asked = spark.createDataFrame([("http://b.example.com/p1",), ("http://none.example.com/",)], "url string")
    want = {i for i in range(300) if i % 3 == 1 and i % 40 == 1}
    assert {r.page_id for r in warc.lookup(directory, asked).collect()} == want
    limit, warc.BROADCAST_BLOCKS = warc.BROADCAST_BLOCKS, 1
    try:
        assert {r.page_id for r in warc.lookup(directory, asked).collect()} == want
    finally:
        warc.BROADCAST_BLOCKS = limit
    assert {bytes(r.payload).decode() for r in warc.read_records(warc.lookup(directory, asked)).collect()} == {f"page {i}" for i in want}


def test_keys(spark):
    urls = ["http://A.Example.com:80/x?y#z", "https://user@h.org", "mailto:x", "", None, "http://a.b/c"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(warc.url_key(df.url)).collect()] == ["com,example,a)/x?y", "org,h)/", ")mailto:x", ")/", ")", "b,a)/c"]


def test_edge_cases(spark, tmp_path):
    same = "é" * 60
    rows = [(5, "http://a/1", same), (3, "http://a/2", same), (None, None, same), (3, "http://a/2", same), (7, "http://a/\r\nx: y", "short"), (8, None, "short"), (9, "http://a/3", None), (10, "http://a/4", "z" * 300_000), (11, "u", "\r\n\r\n" * 30)]
    df = spark.createDataFrame([(*r, "d") for r in rows], SCHEMA + ", digest string")
    got = warc.read_records(warc.captures_of(build(spark, df, tmp_path))).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in got) == sorted(
        (str(p), "revisit" if p == 5 else "response", 3 if p == 5 else None, len((h or "").encode())) for p, _, h in rows
    )
    empty = build(spark, df.limit(0), tmp_path / "e")
    assert empty.count() == 0 and warc.read_records(warc.captures_of(empty)).count() == 0 and warc.lookup(empty, df.select("url")).count() == 0


def test_lookup_finds_every_record(spark, tmp_path, monkeypatch):
    """A url with a third of the pages, keys that straddle blocks, urls asked for twice or in vain, the null url; both forms of the search."""
    rows = [(i, "http://hot.example.com/" if i % 3 == 0 else f"http://{'abcdefg'[i % 7]}.example.com/p{i % 90}" if i % 50 else None, f"page {i}") for i in range(900)]
    directory = build(spark, spark.createDataFrame(rows, SCHEMA), tmp_path, 10)
    asked = spark.createDataFrame([(u,) for u in {r[1] for r in rows}] * 2 + [("http://zzz/",), ("http://a.example.com/p",)], "url string")
    read: list[int] = []
    for limit in (warc.BROADCAST_BLOCKS, 5):
        monkeypatch.setattr(warc, "BROADCAST_BLOCKS", limit)
        found = warc.lookup(directory, asked)
        assert sorted(r.page_id for r in found.collect()) == list(range(900))
        read.append(warc.blocks_of(directory, asked.limit(0).select(warc.url_key(asked.url).alias("k"))).count())
        one = warc.blocks_of(directory, spark.createDataFrame([("com,example,b)/p1",)], "k string"))
        assert 1 <= one.count() <= 3  # and not all ninety
    assert read == [0, 0]
    assert warc.lookup(directory, asked.limit(0)).count() == 0


def test_query_searches_the_directory(spark, monkeypatch):
    """The query's records are those that the search finds: it gives nothing where the search does."""
    from notelake.llm import queries

    def none(directory):
        raise AssertionError("the whole index is read")

    monkeypatch.setattr(warc, "captures_of", none)
    assert queries.op2_warc_capture_index(spark, DATA).count() == spark.read.parquet(f"{DATA}/pages.parquet").count()
    blocks_of = warc.blocks_of
    monkeypatch.setattr(warc, "blocks_of", lambda directory, keys: blocks_of(directory, keys).limit(0))
    assert queries.op2_warc_capture_index(spark, DATA).count() == 0
