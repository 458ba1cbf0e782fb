"""Vector codes of integer parts, with codebooks by Hamerly's variant of Lloyd's rounds.

Vectors of integers are cut into equal parts; every part position has a codebook, whose entries are moved to the means of
the parts that are nearest to them, round by round. Each part of each vector keeps two bounds from round to round: one from
above for the distance to its entry and one from below for that to any other entry. When entries move, the bounds are moved
by as much. Where the upper one stays strictly below the lower one, or below half of the way from its entry to the next one,
no other entry can be as near and the part is not looked at; else the upper bound is set to the exact distance, and only if
that doesn't help all entries are scanned in integers, so that ties go to the lower index. The rows and their bounds are
written each round, in the tasks that read them: nothing is shuffled but sums of the parts of each entry.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import Scratch, for_python, trimmed
from lithos.llm.exact_search import usable

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows of an Arrow batch, and distances that are held at once.
ROWS, AT_ONCE = 4096, 1 << 20
#: Bounds are real numbers; they are moved outwards by this share so that their rounding can't make a wrong one.
SLACK = 1e-9


def squared(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row to each entry."""
    most = int(max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0)))
    bound = 4 * most * most * max(1, x.shape[1])
    if bound >= 2**63:
        raise ArithmeticError("squared distances don't fit 64 bits")
    if bound < 2**53:  # whole numbers of 53 bits are exact in floating point
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)).astype(np.int64)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(axis=1)


def own_distance(x: np.ndarray, entries: np.ndarray, code: np.ndarray) -> np.ndarray:
    d = x - entries[code]
    return (d * d).sum(axis=1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals), and both bounds: its distance and that of the nearest of the others."""
    code, upper, lower = np.empty(len(x), np.int64), np.empty(len(x)), np.full(len(x), np.inf)
    step = max(1, AT_ONCE // max(1, len(entries)))
    for lo in range(0, len(x), step):
        d = squared(x[lo : lo + step], entries)
        at = np.arange(len(d))
        code[lo : lo + step] = best = d.argmin(axis=1)
        upper[lo : lo + step] = np.sqrt(d[at, best].astype(np.float64)) * (1 + SLACK)
        if d.shape[1] > 1:
            d[at, best] = np.iinfo(np.int64).max
            lower[lo : lo + step] = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - SLACK)
    return code, upper, lower


class Moves:
    """A codebook of one part position, how far its entries have moved since the last one, and half of the way from each to
    the nearest other."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None):
        self.entries = entries
        way = np.zeros(len(entries)) if before is None else np.sqrt(((entries - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + SLACK)
        self.moved, order = way, np.argsort(-way, kind="stable")
        # the largest move among the others of each entry
        self.others = np.full(len(entries), way[order[0]] if len(order) else 0.0)
        if len(order):
            self.others[order[0]] = way[order[1]] if len(order) > 1 else 0.0
        apart = squared(entries, entries).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(axis=1, initial=np.inf)) / 2 * (1 - SLACK)

    def assign(self, x: np.ndarray, code: np.ndarray | None, upper: np.ndarray, lower: np.ndarray) -> tuple:
        """Codes and bounds anew, and how many rows were scanned."""
        if code is None:
            return *scan(x, self.entries), len(x)
        upper, lower = (upper + self.moved[code]) * (1 + SLACK), lower - self.others[code]
        lower = np.where(lower > 0, lower * (1 - SLACK), lower)
        safe = np.maximum(lower, self.half[code])
        tight = np.flatnonzero(~(upper < safe))
        upper[tight] = np.sqrt(own_distance(x[tight], self.entries, code[tight]).astype(np.float64)) * (1 + SLACK)
        again = tight[~(upper[tight] < safe[tight])]
        code = code.copy()
        code[again], upper[again], lower[again] = scan(x[again], self.entries)
        return code, upper, lower, len(again)


def matrix(column: pa.Array, n: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(n, -1)


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]))[: len(x) + 1], pa.int32()), pa.array(x.ravel()))


#: A row of the written state is a vector with its codes and bounds, or (part not null) what a task adds to an entry.
STATE = "id long, label string, v array<long>, code array<int>, upper array<double>, lower array<double>, part int, entry int, count long, sums array<long>, scanned long"


def assigned(state: DataFrame, codebooks: list[np.ndarray], before: list[np.ndarray] | None, with_sums: bool = True) -> DataFrame:
    """The rows of `state` (id, label, v and, but in the first round, code, upper, lower) with codes and bounds for
    `codebooks`, and, one for each task and entry, the count and sum of the entry's parts."""
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((codebooks, before))
    names = [x.split()[0] for x in STATE.split(", ")]

    def run(batches):
        codebooks, before = shared.value
        moves = [Moves(c, None if before is None else before[p]) for p, c in enumerate(codebooks)]
        width = codebooks[0].shape[1]
        counts = [np.zeros(len(c), np.int64) for c in codebooks]
        sums = [np.zeros(c.shape, np.int64) for c in codebooks]
        scanned = np.zeros(len(codebooks), np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            v = matrix(batch.column("v"), n, np.int64)
            old = [matrix(batch.column(c), n, t) for c, t in (("code", np.int64), ("upper", np.float64), ("lower", np.float64))] if before is not None else None
            code, upper, lower = np.empty((n, len(moves)), np.int32), np.empty((n, len(moves))), np.empty((n, len(moves)))
            for p, m in enumerate(moves):
                x = v[:, p * width : (p + 1) * width]
                code[:, p], upper[:, p], lower[:, p], full = m.assign(x, *((None, None, None) if old is None else (o[:, p] for o in old)))
                scanned[p] += full
                counts[p] += np.bincount(code[:, p], minlength=len(m.entries))
                np.add.at(sums[p], code[:, p], x)
            none = lambda t: pa.nulls(n, t)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), lists(code), lists(upper), lists(lower), none(pa.int32()), none(pa.int32()), none(pa.int64()), none(pa.list_(pa.int64())), none(pa.int64())], names=names)
        for p, c in enumerate(counts) if with_sums else ():
            used = np.flatnonzero(c)
            if len(used):
                n = len(used)
                empty = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))]
                more = np.zeros(n, np.int64)
                more[0] = scanned[p]
                yield pa.RecordBatch.from_arrays([*empty, pa.array(np.full(n, p, np.int32)), pa.array(used.astype(np.int32)), pa.array(c[used]), lists(sums[p][used]), pa.array(more)], names=names)

    return state.mapInArrow(trimmed(run), STATE)


def moved(sums: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry at the componentwise floor of the mean of its parts; unused ones stay. One row an entry and component comes
    to the driver, as many as the codebooks hold."""
    each = sums.select("part", "entry", "count", F.posexplode("sums").alias("place", "x"))
    totals = each.groupBy("part", "entry", "place").agg(F.sum("x").alias("x"), F.sum("count").alias("n")).collect()
    out = [c.copy() for c in codebooks]
    for r in totals:
        out[r.part][r.entry, r.place] = r.x // r.n
    return out


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for c in codebooks for x in c.ravel().tolist()).encode()).hexdigest()


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray], list[int]]:
    """The state of `vectors` (id, label, v: integers, all of one length) after the last assignment, its codebooks, and how
    many parts were scanned in each round."""
    scratch = Scratch(vectors.sparkSession, "codes")
    order = [F.asc_nulls_last("id"), F.col("v")]
    first = np.array([r.v for r in vectors.orderBy(*order).limit(entries).select("v").collect()], dtype=np.int64)
    width = first.shape[1] // parts
    codebooks, before, state, scanned = [first[:, p * width : (p + 1) * width] for p in range(parts)], None, vectors, []
    for k in range(rounds + 1):
        above = scratch.save(assigned(state, codebooks, before))
        sums = above.where("part IS NOT NULL")
        scanned.append(sums.agg(F.sum("scanned")).first()[0])
        if k:
            scratch.drop(old)
        old, state = above, above.where("part IS NULL")
        if k < rounds:
            before, codebooks = codebooks, moved(sums, codebooks)
    return state, codebooks, scanned


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every vector that can be coded.

    Components become floor(scale * component). Rows whose vector is null, empty or holds null or non-finite components are
    left out; so are those of another length than the first vector by id, and all if that can't be cut into `parts`. Null ids
    come last where the first codebook is filled, rows that repeat an id by their vectors; each row is coded by itself. With
    fewer rows than `entries` the codebooks are as short. error is the sum of the parts' squared distances, label_error its
    sum over equal labels, nulls together. Squared distances beyond 64 bits are an error. An empty table gives an empty
    result; further columns are not read, whatever their names.
    """
    spark = vectors.sparkSession
    for_python(spark, ROWS)
    scratch = Scratch(spark, "vectors")
    whole = F.transform(F.col(vec_col), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    kept = vectors.where(usable(F.col(vec_col))).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), whole.alias("v"))
    rows = scratch.save(kept.where(F.size("v") > 0))
    lead = rows.orderBy(F.asc_nulls_last("id"), F.col("v")).select(F.size("v").alias("n")).first()
    if lead is None or lead.n % parts:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    state, codebooks, _ = train(rows.where(F.size("v") == lead.n), parts, entries, rounds)
    shared, width = spark.sparkContext.broadcast(codebooks), lead.n // parts

    def errors(batches):
        for batch in batches:
            n = batch.num_rows
            v, code = matrix(batch.column("v"), n, np.int64), matrix(batch.column("code"), n, np.int64)
            error = sum((own_distance(v[:, p * width : (p + 1) * width], c, code[:, p]) for p, c in enumerate(shared.value)), np.zeros(n, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([bytes(x).hex() for x in code.astype(np.uint8)], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = scratch.save(state.select("id", "label", "v", "code").mapInArrow(trimmed(errors), "vec_id long, label string, code string, error long"))
    # labels may be few: their sums are made from partial ones, and joined to a written table that Spark can split
    sums = scratch.save(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))
