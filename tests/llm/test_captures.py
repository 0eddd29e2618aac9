from hashlib import sha256

import pytest

from caseweave.llm import captures
from caseweave.llm.common import table
from caseweave.session import materialise, scratch_path

PAGES = "page_id long, url string, html string, key string, file string, offset long"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "k", "f", 1) for r in rows], PAGES)


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        one = first.get(html or "")
        again = len(body) >= 100 and one is not None and one != i
        out.append((i, len(body), sha256(body).hexdigest(), "revisit" if again else "response", one if again else None))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://www.example.com/a?b=c", "x" * 100), (2, "https://www.example.com:8443/a", "x" * 100), (3, None, "x" * 99), (4, "", "x" * 99), (5, "not a url", None), (6, "http://é.example/ü", ""),
    (7, "http://h.example/\r\nX: y", "é" * 60), (8, "http://h.example/", "é" * 60), (8, "http://h.example/", "é" * 60), (None, "http://h.example/", "é" * 60), (None, None, "y" * 200),
    (11, "http://[bad", "\r\n\r\nWARC/1.1\r\n" * 20), (12, "http://h.example/", "z" * 3_000_000), (13, "http://h.example/", "z" * 3_000_000),
]


def test_pages_come_back_as_they_were(spark):
    got = captures.archived(pages(spark, ROWS).repartition(3))
    assert sorted(map(tuple, got.collect()), key=repr) == expected(ROWS)
    assert captures.archived(pages(spark, [])).count() == 0


def test_real_pages(spark):
    given = table(spark, "/root/testdata/sf0.001", "pages")
    rows = [tuple(r) for r in given.select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, captures.archived(given).collect()), key=repr) == expected(rows)


@pytest.mark.parametrize("block_rows,part_rows", [(3, 25), (1000, 40)])
def test_lookup_over_many_blocks_and_a_common_key(spark, block_rows, part_rows):
    rows = [(i % 60, "http://hot.example/" if i % 2 else f"http://h{i % 7}.example/{i % 60}", f"page {i}") for i in range(120)]
    folder = scratch_path(spark, "test")
    held = materialise(captures.write_archives(pages(spark, rows).repartition(4), folder), "captures")
    directory = materialise(captures.write_index(held, folder, block_rows, part_rows), "directory")
    asked = spark.createDataFrame([(captures.url_key(u), i) for i, u, _ in rows[::3]] + [("com,nowhere)/", 1), ("", None)], "key string, page_id long").distinct()
    got = sorted(map(tuple, captures.lookup(asked, directory, folder).collect()), key=repr)
    names = {(r["key"], r["page_id"]) for r in asked.collect()}
    want = sorted(((r["page_id"], r["file"], r["offset"], r["length"]) for r in held.collect() if (r["key"], r["page_id"]) in names), key=repr)
    assert got == want and len(got) >= 40


def test_url_keys():
    assert captures.url_key("http://www.Example.com:80/x?y#z") == "com,example,www)/x?y"
    assert captures.url_key("https://example.com:8443") == "com,example:8443)/"
    assert captures.url_key(None) == captures.url_key("") == ""


def test_record_round_trip():
    body = "é\r\n\r\n".encode() * 30
    digest = sha256(body).hexdigest()
    assert captures.parsed(captures.record(7, "http://a/ b", body, digest, None)) == (7, len(body), digest, "response", None)
    assert captures.parsed(captures.record(8, None, body, digest, 7)) == (8, len(body), digest, "revisit", 7)
