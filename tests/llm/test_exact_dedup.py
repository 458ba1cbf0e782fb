import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithos.llm.exact_dedup import chunks, exact_dedup

SCHEMA = "doc_id long, text string"


def by_brute_force(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = [(1, "a. b"), (2, "a. b"), (3, "a.  b"), (4, None), (5, ""), (6, "x" * 10_000), (7, "x" * 10_000), (8, "x" * 9_999 + "y"), (9, "A. b"), (None, "a. b"), (None, "é"), (2, "a. b")]


def test_against_brute_force(spark):
    found = exact_dedup(spark.createDataFrame(ROWS, SCHEMA))
    assert sorted(map(tuple, found.collect()), key=repr) == by_brute_force(ROWS)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 2, "b", True)], SCHEMA + ", recipe long, chunks string, kept boolean".replace(", recipe long, chunks string", ", recipe int, chunks string"))
    assert exact_dedup(df).first().kept and exact_dedup(df.limit(0)).collect() == []


@pytest.mark.parametrize("bits", [1, 3])
def test_contents_that_share_a_hash(spark, bits):
    """With hashes of a few bits nearly all contents share one, inside a text, too; the result is the same."""
    parts = [f"Part {i} " + "z" * 300 + "." for i in range(7)]
    long = [(100 + i, "".join(parts[(i * k) % 7] for k in range(6))) for i in range(12)]
    rows = [*ROWS, *((20 + i, f"text number {i % 30}.") for i in range(40)), *long, (200, long[3][1])]
    found = exact_dedup(spark.createDataFrame(rows, SCHEMA), bits=bits)
    assert sorted(map(tuple, found.collect()), key=repr) == by_brute_force(rows)


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="ab.\n é", max_size=3000))
def test_chunks_join_to_the_text(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t")).alias("c")).first()
    assert "".join(row.c) == text


def test_no_python_in_the_plan(spark):
    plan = exact_dedup(spark.createDataFrame(ROWS, SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
