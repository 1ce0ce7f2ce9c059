import base64
import gzip
import hashlib

from common_llm import SF

from chorus.llm import warc
from chorus.session import scratch_path


def brute(rows):
    last = {}
    for i, _, h in rows:
        k = h or ""
        last[k] = i if k not in last else max((x for x in (last[k], i) if x is not None), default=None)
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        top = last[h or ""]
        out.append((i, len(raw), digest, "response" if i == top else "revisit", None if i == top else top, True))
    return sorted(out, key=str)


def run(spark, pages):
    return sorted((tuple(r) for r in warc.archive_round_trip(spark, pages).collect()), key=str)


def test_round_trip(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert run(spark, pages) == brute([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


def test_edges(spark):
    same = "http://hot.example.com/x"
    rows = [(1, None, None), (2, "", ""), (3, same, "a\r\n\r\nWARC/1.1\r\n"), (4, same, "ü" * 100000), (5, "http://[bad", "x"),
            (6, same, "ü" * 100000), (None, same, "n"), (None, "not a url \n", None), (7, "http://u:p@Ä.de:8080/ä b?q=1#f", "x"), (7, same, "y")]
    rows += [(100 + i, same, f"body {i % 7}") for i in range(2500)]
    docs = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "page_id long, url string, html string, key string, offset int, file int")
    assert run(spark, docs) == brute(rows)
    assert run(spark, spark.createDataFrame([], "page_id long, url string, html string")) == []


def test_index_finds_exactly_the_captures(spark):
    rows = [(i, f"http://h{i % 40}.example.net/p/{i % 300}", f"<p>{i}</p>") for i in range(6000)]
    root = scratch_path(spark, "warc-test")
    captures = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"{root}/a")
    files = warc.build_index(captures, f"{root}/i")
    asked = ["http://h1.example.net/p/1", "http://h39.example.net/p/39", "http://none.example.net/", "http://h0.example.net/p/0"]
    keys = spark.createDataFrame([(warc.url_key(u),) for u in asked], "key string")
    got = sorted(r["page_id"] for r in warc.lookup(keys, f"{root}/i", files).collect())
    assert got == [i for i, u, _ in rows if u in asked]


def test_archives_are_plain_warc(spark):
    root = scratch_path(spark, "warc-test")
    caps = warc.write_archives(spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string"), root).collect()
    fs, base = warc.filesystem(root)
    raw = gzip.decompress(fs.open_input_stream(f"{base}/{caps[0]['file']}", compression=None).read())
    assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"<p>x</p>\r\n\r\n")


def test_keys():
    assert warc.url_key("http://www.Example.com:80/a b?q") == "com,example,www)/a%20b?q"
    assert warc.url_key("https://example.com:8443") == "com,example:8443)/"
    assert warc.url_key(None) == "-)"


def test_hosts_with_white_space(spark):
    urls = ["http://exa mple.com/x", "http://exa mple.com/x", "http:// lead.com", "http://a.b c:81/?q r", "http:// x　.de/", "http:// /", "http://exa%20mple.com/x"]
    rows = [(i, u, f"body {i}") for i, u in enumerate(urls)]
    assert not any(c.isspace() for u in urls for c in warc.url_key(u))
    assert run(spark, spark.createDataFrame(rows, "page_id long, url string, html string")) == brute(rows)
