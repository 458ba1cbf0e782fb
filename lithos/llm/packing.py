"""Packing token sequences by first-fit decreasing over a tournament tree of bin capacities.

Documents are encoded and closed by an end id. What fills whole sequences of a document is cut off and is never moved; of
each document a tail shorter than a sequence is left. Tails are dealt at random into groups of bounded size, and every group
is packed on its own: longest tails first, each into the first bin that has room. The bins' capacities are the leaves of a
tournament tree whose inner nodes hold the larger of two, so that the first bin with room is found by one walk from the root.
Bins that keep too much room are then filled with what is cut from the emptiest ones, and what is left of a group at the
end is cut into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.bpe import encoded, read_spec
from lithos.llm.common import Scratch, free_names

#: Tokens of a sequence, the id that ends a document, tails of a group on average, and the room that a bin may keep.
LENGTH, END, GROUP, ROOM = 2048, 1, 2048, 8
SEED = 12


class Bins:
    """Bins in order of their opening, as leaves of a tournament tree of what room they have."""

    def __init__(self, most: int, capacity: int):
        self.leaves = 1 << max(0, most - 1).bit_length()
        self.tree = [capacity] * (2 * self.leaves)
        self.opened = 0

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with room for `size`, and what room it had."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.tree[at] < size:
                at += 1
        bin_, room = at - self.leaves, self.tree[at]
        self.opened = max(self.opened, bin_ + 1)
        self.tree[at] = room - size
        while at > 1:
            at //= 2
            larger = max(self.tree[2 * at], self.tree[2 * at + 1])
            if self.tree[at] == larger:
                break
            self.tree[at] = larger
        return bin_, room


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """The items of each bin. Items of one size keep their order."""
    bins, out = Bins(len(sizes), capacity), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        b, _ = bins.put(sizes[i])
        if b == len(out):
            out.append([])
        out[b].append(i)
    return out


def packed(sizes: list[int], capacity: int = LENGTH, room: int = ROOM) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length): every token of every item in one piece. All sequences but those of a power
    of two keep `room` at most."""
    bins = [[(i, 0, sizes[i]) for i in items] for items in first_fit_decreasing(sizes, capacity)]
    full, open_ = [], []
    for b in bins:
        (full if capacity - sum(n for _, _, n in b) <= room else open_).append(b)
    # the emptiest bins are cut up to fill the others, the fullest first
    open_.sort(key=lambda b: -sum(n for _, _, n in b))
    loose: list[tuple[int, int, int]] = []
    while open_:
        b = open_.pop(0)
        left = capacity - sum(n for _, _, n in b)
        while left > room and (loose or open_):
            if not loose:
                loose = open_.pop()
            i, start, n = loose.pop()
            take = min(n, left)
            b.append((i, start, take))
            left -= take
            if take < n:
                loose.append((i, start + take, n - take))
        if left <= room:
            full.append(b)
        else:
            loose = b
            break
    total = sum(n for _, _, n in loose)
    while total:
        power = 1 << (total.bit_length() - 1)
        total -= power
        b = []
        while power:
            i, start, n = loose.pop(0)
            take = min(n, power)
            b.append((i, start, take))
            power -= take
            if take < n:
                loose.insert(0, (i, start + take, n - take))
        full.append(b)
    return full


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def id_type(path: str, end: int) -> str:
    """The smaller type that holds every id of a tokenizer file."""
    kinds = json.loads(read_spec(path))
    return "<u2" if max([end, *kinds["model"]["vocab"].values(), *(x["id"] for x in kinds["added_tokens"])]) < 1 << 16 else "<u4"


def cut(docs: DataFrame, path: str, id_col: str, text_col: str, length: int, end: int, kind: str) -> DataFrame:
    """id, n (tokens with the end's), crcs (of the whole sequences that a document fills) and its tail's ids, as bytes, which
    move as one value and not as one for each id."""
    name = free_names(docs, "id")[0]
    rows = docs.select(F.col(id_col).alias(name), F.col(text_col).alias("text"))
    fields = [T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("tail", T.BinaryType())]

    def values(codec, found):
        whole = [np.append(x, np.int32(end)) for x in found]
        crcs = [[crc32(x[k : k + length]) for k in range(0, len(x) - length + 1, length)] for x in whole]
        tails = [x[len(x) // length * length :].astype(kind).tobytes() for x in whole]
        return [pa.array([len(x) for x in whole], pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(tails, pa.binary())]

    return encoded(rows, path, "text", [name], fields, values).withColumnRenamed(name, "id")


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, group: int = GROUP, room: int = ROOM, seed: int = SEED, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece, in sequences of `length` tokens; with
    `with_ids` the ids of the pieces that are shorter than a sequence, too (null for the others, which are cut of their own
    document at `start`).

    A document is the ids of its whole text (null: empty) and `end`; so an empty one is one token. Pieces of a sequence lie
    one behind another from offset 0. Sequences hold at least `length` - `room` tokens, or a power of two; of each group of
    some `group` tails at most as many as a length has bits are of the latter kind. Rows that repeat an id are documents of
    their own; a null id is kept. An empty table gives an empty result; further columns are not read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    # the row's number is written, so that a task that runs again deals its rows as before
    kind = id_type(path, end)
    rows = scratch.save(cut(docs, path, id_col, text_col, length, end, kind).withColumn("row", F.monotonically_increasing_id()))
    fills = rows.where(F.size("crcs") > 0).select(F.col("id").alias("doc_id"), "n", F.posexplode("crcs").alias("k", "crc"))
    whole = fills.select(
        "doc_id", (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"),
        (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *([F.lit(None).cast("array<int>").alias("ids")] if with_ids else []),
    )
    tails = rows.where(F.octet_length("tail") > 0)
    groups = max(1, -(-tails.count() // group))
    dealt = tails.select("id", "n", "tail", F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)).alias("group"))
    pieces = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")

    def run(key, table):
        ids, n = table.column("id").to_pylist(), table.column("n").to_numpy()
        tails = [np.frombuffer(x, dtype=kind).astype(np.int32) for x in table.column("tail").to_pylist()]
        out: list[tuple] = []
        for b, sequence in enumerate(packed([len(x) for x in tails], length, room)):
            at = 0
            for i, start, size in sequence:
                some = tails[i][start : start + size]
                out.append((ids[i], int(n[i]) - len(tails[i]) + start, size, crc32(some), int(n[i]), 2 * ((key[0].as_py() << 24) + b) + 1, at, *([some] if with_ids else [])))
                at += size
        columns = list(zip(*out)) or [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema)], schema=schema)

    whole_numbers = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    schema = pa.schema([*((c, pa.int64()) for c in whole_numbers), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])
    return whole.unionByName(dealt.groupBy("group").applyInArrow(run, pieces))
