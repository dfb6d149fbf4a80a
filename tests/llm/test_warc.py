import base64
import hashlib
import random

from pyspark.sql import functions as F

from skirmish.llm import common, warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a/b?x=1#f") == "com,example,www)/a/b?x=1"
    assert warc.url_key("https://example.org:8443") == "org,example:8443)/"
    assert warc.url_key("") == ")/" and " " not in warc.url_key("http://a b/c d")


def test_loser_tree_is_a_sort():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 8, 13):
        runs = [sorted(str(rng.randrange(50)) for _ in range(rng.randrange(0, 20))) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_round_trip():
    raw = warc.record(5, "http://x/\r\ny", "2020-01-01T00:00:00Z", b"\r\n\r\nbody", warc.digest(b"\r\n\r\nbody"), None) + warc.record(6, "http://x/", "2020-01-01T00:00:01Z", b"p", warc.digest(b"p"), 5)
    (a, n, f, body), (b, m, g, none) = warc.records(raw)
    assert (a, b, body, none) == (0, n, b"\r\n\r\nbody", b"") and n + m == len(raw) and g["WARC-Refers-To"] == "<urn:page:5>"


def test_captures(spark):
    rows = [(i, f"http://h{i % 3}.example.com/{i % 7}", f"page {i % 11}") for i in range(200)] + [(900, None, None), (901, "http://z/", ""), (None, "http://n/", "only here"), (902, "not a url [", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit("clash")).withColumn("line", F.lit(1))
    got = warc.captures(pages, ranges=4).collect()
    assert len(got) == len(rows)
    keep = {}
    for i, _, h in rows:
        keep[h or ""] = max(keep.get(h or "", -1), -1 if i is None else i)
    by = {r.page_id: r for r in got}
    for i, _, h in rows:
        r = by[i]
        assert (r.payload_bytes, r.payload_digest) == (len((h or "").encode()), digest(h))
        if i is not None:
            assert (r.record_type, r.refers_to) == (("response", None) if keep[h or ""] == i else ("revisit", keep[h or ""]))
    order = sorted(got, key=lambda r: (r.range, r.place))
    assert [(r.url_key, r.captured) for r in order] == sorted((r.url_key, r.captured) for r in got)
    assert warc.captures(pages.limit(0)).count() == 0
