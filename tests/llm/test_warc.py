import random

import pytest
from pyspark.sql import functions as F

import lithos.llm.warc as W

SCHEMA = "archive long, offset long, digest string"


def by_comparison(left, right):
    a, b = {}, {}
    for side, rows in ((a, left), (b, right)):
        for arc, off, d in rows:
            side.setdefault((arc or 0, off or 0), []).append(d)
    return {k: "missing" if k not in b else "extra" if k not in a else "changed" for k in {*a, *b} if sorted(a.get(k, [])) != sorted(b.get(k, []))}


@pytest.mark.parametrize("seed", [1, 2])
def test_audit_against_comparison(spark, seed):
    r = random.Random(seed)
    left = [(a, r.randrange(10**7) * 8, f"d{r.random()}") for a in range(40) for _ in range(5)] + [(None, None, "n"), (3, 8, "twice"), (3, 8, "twice")]
    right = [(a, o, d if r.random() > 0.05 else "bad") for a, o, d in left if r.random() > 0.03] + [(50, 5, "new")]
    found = W.merkle_audit(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert {(x.archive, x.offset): x.status for x in found.collect()} == by_comparison(left, right)


def test_same_and_empty(spark):
    rows = spark.createDataFrame([(0, 0, "a"), (0, 9, None)], SCHEMA)
    assert W.merkle_audit(rows, rows).collect() == [] and W.merkle_audit(rows.limit(0), rows.limit(0)).collect() == []
    assert {x.status for x in W.merkle_audit(rows, rows.limit(0)).collect()} == {"missing"}


def test_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é\r\n\r\nx</p>"), (2, "http://b/", ""), (3, None, None)], "page_id long, url string, html string")
    records = pages.select(W.record(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    W.write_warc(records, str(tmp_path / "w"))
    back = {x.record_id: (x.url, x.length, x.content) for x in W.read_warc(spark, str(tmp_path / "w")).collect()}
    assert back == {"<urn:page:1>": ("http://a/", 14, "<p>é\r\n\r\nx</p>"), "<urn:page:2>": ("http://b/", 0, ""), "<urn:page:3>": (None, 0, "")}


def test_nulls_and_repeats_in_pages(spark):
    pages = spark.createDataFrame([(7, "u", "<p>a"), (7, "u", "<p>a"), (None, None, None), (13, "u", "x"), (5, "u", "<p>")], "page_id long, url string, html string")
    assert {x.status for x in W.audit_pages(pages).collect()} == {"changed", "missing"}


def test_records_within_records(spark, tmp_path):
    inner = "a page about\r\n\r\nWARC/1.0\r\nWARC-Type: resource\r\n\r\nrest"
    for name, text in (("ends", "x\r\n\r\n"), ("holds", inner)):
        records = spark.createDataFrame([("u", 1, text), ("u", 2, "y")], "url string, page_id long, html string").coalesce(1)
        W.write_warc(records.select(W.record(F.col("url"), F.col("page_id"), F.col("html")).alias("record")), str(tmp_path / name))
    assert {x.content for x in W.read_warc(spark, str(tmp_path / "ends")).collect()} == {"x\r\n\r\n", "y"}
    with pytest.raises(Exception, match="Content-Length"):
        W.read_warc(spark, str(tmp_path / "holds")).collect()
