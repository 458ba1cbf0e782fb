"""WARC records and their fixity by Merkle trees, with DataFrame functions only.

Each record of an archive is hashed; records within a range of offsets are hashed into a node, ordered ranges into nodes
of wider ranges, archives into nodes of ranges of archives, up to one root. Two replicas with the same root are the same.
Otherwise the audit goes down from the roots and reads, level by level, only the children of nodes that differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithos.llm.common import Scratch

DATE = "2024-01-01T00:00:00Z"
#: Bytes of the narrowest offset range (as a power of two), and ranges (as a power of two) that a wider node holds.
RANGE_BITS, FAN_BITS = 18, 4
END = "\r\n\r\n"


def record(url: Column, name: Column, content: Column, date: str = DATE) -> Column:
    """A WARC/1.0 resource record without its closing two line ends; nulls count as empty."""
    url, name, content = (F.coalesce(x.cast("string"), F.lit("")) for x in (url, name, content))
    head = ["WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: ", url, "\r\nWARC-Date: ", date, "\r\nWARC-Record-ID: <urn:page:", name, ">\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.octet_length(content).cast("string"), "\r\n\r\n"]
    return F.concat(*(F.lit(x) if isinstance(x, str) else x for x in head), content)


def write_warc(records: DataFrame, path: str, record_col: str = "record", compression: str = "gzip") -> None:
    """Write records as WARC files, one a partition. Text of any length; what is no text is not written by this."""
    records.select(F.col(record_col).alias("value")).write.option("lineSep", END).option("compression", compression).text(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """type, url, date, record_id, length, content of each record of WARC files. Files are split at records. Raises where a
    content hasn't the bytes of its Content-Length, as that of a record that holds the text that begins another one."""
    raw = spark.read.option("lineSep", f"{END}WARC/1.0\r\n").text(path)
    whole = F.regexp_replace("value", r"\AWARC/1\.0\r\n", "")
    at = F.instr("whole", END)
    cut = raw.select(whole.alias("whole")).where(F.regexp_replace("whole", r"\r\n", "") != "")
    cut = cut.select(F.when(at > 0, F.expr("substring(whole, 1, instr(whole, '\r\n\r\n') - 1)")).otherwise(F.col("whole")).alias("head"), F.when(at > 0, F.expr("substring(whole, instr(whole, '\r\n\r\n') + 4)")).otherwise(F.lit("")).alias("content"))
    field = lambda name: F.nullif(F.regexp_extract("head", rf"(?i)(?:^|\r\n){name}:[ \t]*([^\r\n]*)", 1), F.lit(""))
    length, content = field("Content-Length").cast("long"), F.col("content")
    # a file's last record has its closing line ends still
    closed = content.endswith(END) & (length.isNull() | (F.octet_length(content) == length + len(END)))
    content = F.when(closed, F.expr("substring(content, 1, length(content) - 4)")).otherwise(content)
    whole = F.when(length.isNull() | (F.octet_length(content) == length), content).otherwise(F.raise_error(F.concat(F.lit("content of another length than its Content-Length: "), F.col("head"))))
    return cut.select(field("WARC-Type").alias("type"), field("WARC-Target-URI").alias("url"), field("WARC-Date").alias("date"), field("WARC-Record-ID").alias("record_id"), length.alias("length"), whole.alias("content"))


def layout(records: DataFrame, archive_col: str = "archive", name_col: str = "name") -> DataFrame:
    """`records` with the column offset: where each record (length bytes) begins in its archive, ordered by name, then digest.
    An archive is one task's work, so it must be of bounded size; contents needn't be among the columns."""
    before = Window.partitionBy(archive_col).orderBy(name_col, "digest").rowsBetween(Window.unboundedPreceding, -1)
    return records.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def digest_of(child: Column, text) -> Column:
    """SHA-256 of the texts of a node's children, in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(child)), text), "|"), 256)


def steps_up(most_archive: int, most_offset: int, range_bits: int, fan_bits: int) -> list[tuple[str, int]]:
    """What each level's keys are shifted by for the level above: offsets until an archive is one node, then archives."""
    out, left = [("slot", range_bits)], most_offset >> range_bits
    while left:
        out, left = [*out, ("slot", fan_bits)], left >> fan_bits
    while most_archive:
        out, most_archive = [*out, ("archive", fan_bits)], most_archive >> fan_bits
    return out


def merkle_tree(records: DataFrame, scratch: Scratch, steps: list[tuple[str, int]]) -> list[DataFrame]:
    """Levels of a replica's tree, leaves first: archive, slot, digest and the key of the node above (up_archive, up_slot).
    A leaf holds the records of one offset, with their numbers; a node has few children, because records have a least
    length and nodes hold a fixed number of ranges."""
    counted = records.groupBy("archive", "offset", "digest").agg(F.count(F.lit(1)).alias("n"))
    nodes = counted.groupBy("archive", F.col("offset").alias("slot")).agg(digest_of(F.struct("digest", "n"), lambda x: F.concat_ws(":", x["digest"], x["n"])).alias("digest"))
    out = []
    for kind, bits in [*steps, ("slot", 0)]:
        above = ("archive", F.shiftright("slot", bits)) if kind == "slot" else (F.shiftright("archive", bits), F.lit(0).cast("long"))
        out.append(scratch.save(nodes.select("archive", "slot", "digest", *(F.lit(None).cast("long").alias(n) if not bits else (F.col(x) if isinstance(x, str) else x).alias(n) for x, n in zip(above, ("up_archive", "up_slot"))))))
        child = F.struct("archive", "slot", "digest")
        nodes = out[-1].groupBy(F.col("up_archive").alias("a"), F.col("up_slot").alias("s")).agg(digest_of(child, lambda x: F.concat_ws(":", x["archive"], x["slot"], x["digest"])).alias("digest"))
        nodes = nodes.select(F.col("a").alias("archive"), F.col("s").alias("slot"), "digest")
    return out


def merkle_audit(left: DataFrame, right: DataFrame, range_bits: int = RANGE_BITS, fan_bits: int = FAN_BITS) -> DataFrame:
    """archive, offset, left_digest, right_digest, status of each place where two replicas (archive, offset, digest) differ;
    status is changed, missing (in the right one) or extra.

    Archives and offsets are integers from 0; a null one counts as 0, a null digest as that of an empty record. Records of
    one place are compared together, as often as they repeat; the digest of a place is over its records' digests and
    numbers. Two empty replicas are the same. Other columns are not read.
    """
    scratch = Scratch(left.sparkSession, "merkle")
    cols = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in ("archive", "offset")]
    sides = [scratch.save(x.select(*cols, F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("digest"))) for x in (left, right)]
    most = sides[0].union(sides[1]).agg(F.max("archive").alias("a"), F.max("offset").alias("o")).first()
    steps = steps_up(most.a or 0, most.o or 0, range_bits, fan_bits)
    trees = [merkle_tree(x, scratch, steps) for x in sides]
    place, frontier = ["archive", "slot"], None
    for levels in zip(*(reversed(t) for t in trees)):
        here = []
        for level, name in zip(levels, ("left_digest", "right_digest")):
            if frontier is not None:
                parent = frontier.select(F.col("archive").alias("up_archive"), F.col("slot").alias("up_slot"))
                level = level.join(parent, ["up_archive", "up_slot"], "left_semi")
            here.append(level.select(*place, F.col("digest").alias(name)))
        differ = here[0].join(here[1], place, "full").where(~F.col("left_digest").eqNullSafe(F.col("right_digest")))
        frontier = scratch.save(differ)
    status = F.when(F.col("right_digest").isNull(), "missing").when(F.col("left_digest").isNull(), "extra").otherwise("changed")
    return frontier.select("archive", F.col("slot").alias("offset"), "left_digest", "right_digest", status.alias("status"))


def page_records(pages: DataFrame, html: Column, per_archive: int = 1000) -> DataFrame:
    """page_id, archive, digest, length of the WARC record of each page; `per_archive` ids share an archive."""
    rec = record(F.col("url"), F.col("page_id"), html)
    rows = pages.select("page_id", F.coalesce(F.floor(F.col("page_id") / per_archive), F.lit(0)).alias("archive"), rec.alias("record"))
    return rows.select("page_id", "archive", F.sha2("record", 256).alias("digest"), (F.octet_length("record") + len(END)).cast("long").alias("length"))


def audit_pages(pages: DataFrame) -> DataFrame:
    """Audit of the pages' archives against a replica with planted faults, because the table holds one replica only: of ids
    that leave 7 by 50 the paragraphs' tags are changed, and those that leave 13 are lost. Offsets are the first replica's."""
    placed = Scratch(pages.sparkSession, "warc").save(layout(page_records(pages, F.col("html")), name_col="page_id"))
    faulty = F.when(F.col("page_id") % 50 == 7, F.replace("html", F.lit("<p>"), F.lit("<P>"))).otherwise(F.col("html"))
    damaged = page_records(pages.where(F.coalesce(F.col("page_id") % 50, F.lit(0)) != 13), faulty)
    places = placed.groupBy("page_id", "archive").agg(F.min("offset").alias("offset"))
    replica = damaged.join(places, damaged["page_id"].eqNullSafe(places["page_id"]) & (damaged["archive"] == places["archive"])).select(damaged["archive"], "offset", "digest")
    return merkle_audit(placed, replica)
