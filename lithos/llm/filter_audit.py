"""Filter interaction audit: what each filter of a chain removes in every order that the filters can be applied in.

Texts are scanned in the buffers that Arrow hands over: a table gives every byte its classes, prefix sums of the classes
count words, capitals, symbols and code points between any two places, and a prefix sum of weighted bytes gives every word
a hash. A document's words are sorted by (hash, length), neighbours of one hash are held against each other byte by byte,
and the distinct ones are counted. What a document fails is a mask of bits, one a filter. Documents that only copy another
one are found by a digest of the whole text. Masks are counted by part, and every order's figures are sums of these counts.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import Scratch, by_batches, for_python, held, quoted
from lithos.llm.scanning import Scanner, buffers

FILTERS = "ABCDE"
#: Fewest words; least share of distinct words and largest share of capitals, of a hundred. Symbols are those of the scanner.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")


def text_counts(docs: DataFrame, text_col: str = "text", keep_text: bool = True, out: tuple = COUNTS) -> DataFrame:
    """`docs` with the columns `out` (long): words, distinct words, A-Z characters, symbols and code points of the whole text.

    Words are runs of anything but ASCII white space, case counts; a null text counts as empty, an empty one has zeros.
    Columns of these names are replaced, all others kept, whatever their names. Rows may repeat; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    for_python(spark)
    carried = [c for c in docs.columns if c not in out and (keep_text or c != text_col)]

    def run(texts):
        found = held("scanner", Scanner).counts(*buffers(texts)) if len(texts) else np.zeros((0, len(out)), np.int64)
        return [pa.array(found[:, k]) for k in range(len(out))]

    fields = [T.StructField(c, T.LongType()) for c in out]
    return by_batches(docs, carried, [F.coalesce(F.col(quoted(text_col)), F.lit(""))], fields, run)


def orders(letters: str = FILTERS) -> list[dict]:
    """filter_order, step, the bit of the step's filter and the mask of the filters before it, of every order."""
    bit = {x: 1 << k for k, x in enumerate(letters)}
    return [
        {"filter_order": "".join(p), "step": k + 1, "own": bit[x], "before": sum(bit[y] for y in p[:k])}
        for p in permutations(letters) for k, x in enumerate(p)
    ]


def interactions(masks: DataFrame, letters: str = FILTERS) -> DataFrame:
    """From counts (part, mask, n, good, toxic) of the documents that fail exactly the filters of `mask`: for every part,
    order and step the contract's figures. A part has 2 ** len(letters) masks at most, which are one row here."""
    n, size = len(letters), 1 << len(letters)
    totals = masks.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))
    held = totals.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("n", "good", "toxic")))).alias("by"))
    at = lambda field: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.coalesce(F.try_element_at("by", m)[field], F.lit(0).cast("long")))
    rows = held.select("part", *(at(c).alias(c) for c in ("n", "good", "toxic")))
    table = F.from_json(F.lit(json.dumps(orders(letters))), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = rows.withColumn("o", F.explode(table)).select("part", "n", "good", "toxic", "o.*")

    def total(of: str, which) -> F.Column:
        """The sum of the counts of the masks for which which(mask) holds."""
        kept = F.transform(of, lambda x, m: F.when(which(m), x).otherwise(F.lit(0).cast("long")))
        return F.aggregate(kept, F.lit(0).cast("long"), lambda a, x: a + x)

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    alive = lambda m: m.bitwiseAND(before) == 0
    # a mask is removed by its filter in those orders where that comes before all others that it fails: n! / (number of bits)
    share = F.transform("n", lambda x, m: F.when(fails(m), x * (F.lit(factorial(n)) / F.greatest(F.bit_count(m), F.lit(1))).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", "filter_order", "step", total("n", lambda m: m.bitwiseAND(before.bitwiseOR(own)) == 0).alias("kept"),
        total("n", lambda m: fails(m) & alive(m)).alias("removed"), total("n", lambda m: fails(m) & ~alive(m)).alias("redundant"),
        total("n", lambda m: m == own).alias("unique_fails"), total("good", lambda m: fails(m) & alive(m)).alias("good_lost"),
        total("toxic", lambda m: fails(m) & alive(m)).alias("toxic_lost"), F.aggregate(share, F.lit(0).cast("long"), lambda a, x: a + x).alias("shapley"),
    )


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `part`, `digest` and the counts of each row of `docs`, with `mask`: bits of A to D that its text fails."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col("source"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    counted = text_counts(rows, keep_text=False)
    fails = (
        F.col("n_words") < LEAST_WORDS, 100 * F.col("n_distinct") < LEAST_DISTINCT * F.col("n_words"),
        100 * F.col("n_capitals") > MOST_CAPITALS * F.col("n_chars"), F.col("n_symbols") > 0,
    )
    mask = sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(fails)), F.lit(0))
    return counted.withColumn("mask", mask.cast("int"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley of every source of
    `docs` (doc_id, text, source), order and step. `labels` (doc_id, quality, toxic) says which documents are good and toxic.

    A null text counts as empty: it fails A only, and E if a smaller id is empty too. A null source and an empty one are the
    part ''. E asks for a smaller id with an identical text, in any part: a row without an id never fails it, nor is it
    anybody's original; rows that repeat an id and a text count one by one and decide alike. A label counts if any row of its
    id says 1. An empty table has no parts and gives an empty result. Further columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    scanned = scratch.save(failures(docs).select("doc_id", "part", "digest", "mask"))
    # repeated rows are one row from here on; the label's join is by id, and what it needs is written first
    units = scratch.save(scanned.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n")))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    told = units.where("doc_id IS NOT NULL").join(scratch.save(marks), "doc_id", "left").select("doc_id", "part", "digest", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    told = told.unionByName(units.where("doc_id IS NULL").select("*", F.lit(0).alias("good"), F.lit(0).alias("toxic")))
    # one row for each text, part and label: its rows, and the least id with the rows that have it
    named = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))
    kinds = scratch.save(told.groupBy("digest", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("nameless"), F.min(named).alias("least")))
    firsts = scratch.save(kinds.groupBy("digest").agg(F.min("least.doc_id").alias("original"), F.count(F.lit(1)).alias("kinds")))
    both = kinds.join(firsts, "digest")
    original = F.col("nameless") + F.when(F.col("least.doc_id") == F.col("original"), F.col("least.n")).otherwise(0)
    copy = 1 << FILTERS.index("E")
    split = F.array(F.struct(F.col("mask").alias("mask"), original.alias("n")), F.struct(F.col("mask").bitwiseOR(F.lit(copy)).alias("mask"), (F.col("n") - original).alias("n")))
    rows = both.select("part", "good", "toxic", F.explode(split).alias("x")).where("x.n > 0").select("part", F.col("x.mask").alias("mask"), F.col("x.n").alias("n"), (F.col("x.n") * F.col("good")).alias("good"), (F.col("x.n") * F.col("toxic")).alias("toxic"))
    return interactions(rows)
