import base64
import gzip
import hashlib
from collections import defaultdict

import pytest

from passageway.llm import warc
from passageway.functions.bounds import scratch_path


def expected(rows, least):
    groups = defaultdict(list)
    for page, _, html in rows:
        groups[html or ""].append(page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        largest = max((k for k in groups[html or ""] if k is not None), default=None)
        revisit = len(raw) >= least and largest is not None and page != largest
        out.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", largest if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [0, 10])
def test_round_trip(spark, least):
    rows = [(i, f"http://h/{i}", f"<p>{i % 4} ä\r\n\r\nWARC/1.1\r\nContent-Length: 9\r\n\r\n</p>") for i in range(12)]
    rows += [(20, None, None), (21, "http://h/\r\nX: y", ""), (22, "", "tiny"), (23, "", "tiny"), (None, "u", "tiny"), (None, "u", "alone"), (24, "u", "x" * 3_000_000), (25, "u", "x" * 3_000_000), (25, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS key", "2 AS payload", "3 AS record_type")
    got = warc.archive_pages(pages, scratch_path(spark, "archives"), least=least).collect()
    page = lambda x: None if x in (None, "<urn:record>") else int(x[len("<urn:record:") : -1])
    assert sorted(((page(r["record_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], page(r["refers_to"])) for r in got), key=repr) == expected(rows, least)
    texts = {page(r["record_id"]): r["payload"] for r in got if r["record_type"] == "response"}
    assert bytes(texts[11]).decode() == rows[11][2]
    assert {r["uri"] for r in got if page(r["record_id"]) == 21} == {"http://h/ X: y"}


def test_empty_and_damaged(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert warc.archive_pages(empty, scratch_path(spark, "archives")).count() == 0
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(b"WARC/1.1\r\nContent-Length: 99\r\n\r\nno end"))
    with pytest.raises(Exception):
        warc.read_archives(spark, str(tmp_path)).count()
