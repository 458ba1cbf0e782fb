"""The corpus pipeline: stages over `documents`, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from lithos.llm.bpe import bpe_encode
from lithos.llm.common import Scratch, documents, free_names, word_count
from lithos.llm.exact_dedup import exact_dedup
from lithos.llm.language_id import UNDETERMINED, identify, language_samples, lettered
from lithos.llm.mixing import mix
from lithos.llm.near_dedup import near_dedup
from lithos.llm.queries import WORD_BPE

#: No SQL says what the language, mixing and encoding stages do; tests hold them against brute force.
ORACLE_SQL = None


def numbered(spark, docs):
    """`docs` written with a number of its own for each row, because ids may repeat or be null, and that column's name."""
    (row,) = free_names(docs, "row")
    # whole texts, written once and read twice: a slower codec takes a third less of the disk
    return Scratch(spark, "rows").save(docs.withColumn(row, F.monotonically_increasing_id()), "zstd"), row


def one_a_group(rows, row, groups, best):
    """The rows that come first by best(number) of each group (doc_id, group), without their numbers; doc_id is the number."""
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").alias("id")).join(groups.withColumnRenamed("doc_id", "row"), "row")
    kept = ids.groupBy("group").agg(best.alias("best")).select(F.col("best.row").alias(row))
    return rows.join(kept, row, "left_semi").drop(row)


def keep_language(spark, docs, sf_dir):
    """Documents whose language can be told stay: those with letters. Labels are read to learn from only; where there are
    none to learn from, documents with letters stay all the same. No documents give none."""
    samples = language_samples(docs)
    if not samples:
        return docs.where(lettered(F.col("text")))
    pred, score = free_names(docs, "lang_pred", "score")
    told = identify(docs, samples, pred_col=pred, score_col=score)
    return told.where(F.col(pred) != UNDETERMINED).drop(pred, score)


def drop_copies(spark, docs, sf_dir):
    """Of identical texts one row with the largest id stays. No documents give none."""
    rows, row = numbered(spark, docs)
    groups = exact_dedup(rows, row).select("doc_id", F.col("keep_id").alias("group"))
    return one_a_group(rows, row, groups, F.max(F.struct("id", "row")))


def drop_near_copies(spark, docs, sf_dir):
    """Of linked documents (shingles of five words, similarity of 0.8 or more) one row with the smallest id stays; null ids
    come last. No documents give none."""
    rows, row = numbered(spark, docs)
    groups = near_dedup(rows, row).select("doc_id", F.col("component_id").alias("group"))
    return one_a_group(rows, row, groups, F.min(F.struct(F.col("id").isNull(), "id", "row")))


def mix_sources(spark, docs, sf_dir):
    """Documents of the mix, as often as it takes them: each at most twice. A document that it doesn't take goes. Rows with
    the same id, size and source are taken alike, so these are what a row is joined to its decision by. No documents give
    none."""
    ident, size, origin, times, words, copy = free_names(docs, "id", "size", "origin", "times", "words", "copy")
    taken = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(1).cast("int")
    keys = F.col("doc_id").alias(ident), F.col("size").alias(size), F.get("pattern", F.lit(0)).alias(origin)
    facts = mix(docs).groupBy(*keys).agg(F.first(taken).alias(times)).where(F.col(times) > 0)
    rows = docs.withColumn(words, word_count(F.col("text")))
    same = rows["doc_id"].eqNullSafe(facts[ident]) & (rows[words] == facts[size]) & rows["source"].eqNullSafe(facts[origin])
    repeated = rows.join(facts, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.drop(ident, size, origin, times, words, copy)


def encode(spark, docs, sf_dir):
    """Ids of every document's whole text, with the text's columns dropped but for its id, language and source. The copies that
    the mix makes of a document stand side by side, and equal texts of a batch are encoded once. No documents give
    none."""
    return bpe_encode(docs, public_tokenizers.path(WORD_BPE), keep_text=False).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES: list = [
    ("language_id", keep_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mix_to_weights", mix_sources),
    ("bpe_encode", encode),
]


def run(spark, sf_dir):
    """All stages in turn over the documents of `sf_dir`."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir))
    return docs
