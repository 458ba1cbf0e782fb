"""Exact deduplication by content-defined chunk recipes.

Each text is cut into chunks whose ends depend on the characters around them only. Chunks are deduplicated to verified
identifiers: the content of every chunk moves once, to the group of equal chunks, and contents that share a hash are told
apart by their number among these. A text is then its recipe, the ordered list of the identifiers of its chunks, and texts
are compared by recipe, about a hundredth of their length; long texts are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithos.llm.common import Scratch

#: A chunk ends at the first sentence or line end after 256 characters; at 4096 where there is none.
CHUNK = r"(?s).{255,4095}?[\n.!?]|.{1,4096}"
#: Bits of a chunk's hash, and its seed.
BITS, SEED = 64, 11


def chunks(text: Column, pattern: str = CHUNK) -> Column:
    """The content-defined chunks of a text, in order; their concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def hashed(chunk: Column, bits: int, seed: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), chunk), 64 - bits)


def shared_hashes(cut: DataFrame, bits: int, seed: int, scratch: Scratch) -> DataFrame:
    """hash, chunk, nth of the contents that share their hash with another one: their number among these, from 1. Partial
    aggregation drops repeats before the contents move; hardly any hash is shared (of 2.4e11 contents, about 1,600)."""
    pieces = cut.select(F.explode("chunks").alias("chunk"))
    contents = pieces.groupBy(hashed(F.col("chunk"), bits, seed).alias("hash"), "chunk").agg(F.count(F.lit(1)).alias("n"))
    shared = scratch.save(contents.groupBy("hash").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("hash"))
    if shared.isEmpty():
        return shared
    of = contents.join(shared, "hash", "left_semi").select("hash", "chunk")
    return scratch.save(of.withColumn("nth", F.row_number().over(Window.partitionBy("hash").orderBy("chunk"))))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, seed: int = SEED) -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty, and empty texts are equal to each other. Of equal texts
    the largest id stays (keep_id). Null ids lose to any other id; in a group with null ids only, keep_id is null and
    its rows are kept. Rows that repeat an id and text count one by one in group_size and share the decision. An empty
    table gives an empty result. Other columns of `docs` are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # cutting twice costs less than to write the chunks of all texts
    cut = texts.select("doc_id", F.sha2("text", 256).alias("text_sha256"), chunks(F.col("text")).alias("chunks"))
    hashes = F.transform("chunks", lambda c: hashed(c, bits, seed)).alias("hashes")
    shared = shared_hashes(cut, bits, seed, scratch)
    if shared.isEmpty():
        recipes = scratch.save(cut.select("doc_id", "text_sha256", hashes.alias("recipe")))
    else:
        rows = scratch.save(cut.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text_sha256", "chunks", hashes))
        places = rows.select("row", F.posexplode(F.arrays_zip("hashes", "chunks")).alias("place", "x")).select("row", "place", F.col("x.hashes").alias("hash"), F.col("x.chunks").alias("chunk"))
        told = places.join(shared, ["hash", "chunk"]).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "nth"))).alias("told"))
        recipe = F.struct("hashes", F.coalesce("told", F.array().cast("array<struct<place:int,nth:int>>")).alias("told"))
        recipes = scratch.save(rows.join(told, "row", "left").select("doc_id", "text_sha256", recipe.alias("recipe")))
    # written, so that the join reads plain tables and Spark can split the rows of a hot recipe
    groups = scratch.save(recipes.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return recipes.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
