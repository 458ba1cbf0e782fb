"""The most likely way of a walker through a grid, by products of step matrices.

A state is a cell, one of eight orientations and a speed. A task goes step by step through records of up to LONG steps, many of
them side by side. Of longer ones a step's matrix holds the log probability of going from any state to
any other and of what is observed there; in the algebra of maximum and sum the matrices of a row of steps have a product that
says how likely the best way between any two states is. Their steps are dealt into blocks of time; every block's product is made by
a task of its own, neighbouring products are joined pairwise up a tree, and the best end is handed down it: each pair of blocks
learns the state in which they meet, and each block finds its own way between two known states. So one long record is the
work of many tasks, in as many rounds as its number of blocks has bits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.scratch import Scratch
from lithos.session import ship

# Fixed values of the walk: directions of orientations 0 to 7 as steps (lati, loni) from north clockwise.
DIRECTIONS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))
# end of fixed values

START = -1
BLOCK = 64
#: Records of up to this many steps are one task's work: the layers of one take 19 MB with 144 states. Products of matrices
#: take as many times the work of a pass as there are states, so only longer records are dealt into blocks.
LONG = 16_384
#: Rows of short records that a task goes through at once.
SIDE_BY_SIDE = 20_000


@dataclass(frozen=True)
class Walk:
    """How walkers move in a grid of `rows` x `columns` cells: chances of turning by 45 degrees to either side, of changing
    between slow and fast, of standing still when slow, of one step (else two) when fast, and of being slow at first."""

    rows: int
    columns: int
    turn: float = 0.2
    change: float = 0.1
    stand: float = 0.4
    one: float = 0.95
    slow: float = 0.5

    @property
    def states(self) -> int:
        return self.rows * self.columns * 16

    def cell(self, state):
        return state // 16

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source, target and log probability of all moves, by target. Who would leave the grid can't; who can't make two steps
        stands still instead. Of several moves between two states the likeliest counts."""
        best: dict = {}
        for lati in range(self.rows):
            for loni in range(self.columns):
                for turned in range(8):
                    for fast in range(2):
                        src = ((lati * self.columns + loni) * 8 + turned) * 2 + fast
                        di, dj = DIRECTIONS[turned]
                        inside = lambda k, di=di, dj=dj, lati=lati, loni=loni: 0 <= lati + k * di < self.rows and 0 <= loni + k * dj < self.columns
                        moves = [(1, self.one), (2 if inside(1) else 0, 1 - self.one)] if fast else [(0, self.stand), (1, 1 - self.stand)]
                        for k, p in moves:
                            if not inside(k):
                                continue
                            cell = (lati + k * di) * self.columns + loni + k * dj
                            for turn, q in ((-1, self.turn / 2), (0, 1 - self.turn), (1, self.turn / 2)):
                                for to, r in ((fast, 1 - self.change), (1 - fast, self.change)):
                                    dst = (cell * 8 + (turned + turn) % 8) * 2 + to
                                    best[dst, src] = max(best.get((dst, src), -np.inf), float(np.log(p * q * r)))
        order = sorted(best)
        return np.array([s for _, s in order]), np.array([d for d, _ in order]), np.array([best[x] for x in order])

    def start(self) -> np.ndarray:
        """Log probability of each state before anything is seen."""
        speed = np.log(np.where(np.arange(self.states) % 2 == 0, self.slow, 1 - self.slow))
        return speed - np.log(8 * self.rows * self.columns)


class Steps:
    """The moves of a walk, ready for many steps at once."""

    def __init__(self, walk: Walk):
        self.walk, (self.src, self.dst, self.logp) = walk, walk.edges()
        self.reached, self.first = np.unique(self.dst, return_index=True)
        self.cells = walk.cell(np.arange(walk.states))
        # the moves into each state, in order, filled up with some that can't be
        nth = np.arange(len(self.dst)) - self.first[np.searchsorted(self.reached, self.dst)]
        self.from_, self.by = (np.full((walk.states, nth.max() + 1), x) for x in (0, -np.inf))
        self.from_[self.dst, nth], self.by[self.dst, nth] = self.src, self.logp

    def forward(self, ways: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Log probabilities of each state (row) after one more step, at which the cells' log probabilities are `seen`; a column
        for each state that ways may come from."""
        out = np.full(ways.shape, -np.inf)
        out[self.reached] = np.maximum.reduceat(ways[self.src] + self.logp[:, None], self.first, axis=0)
        return out + seen[self.cells][:, None]

    def best(self, seen: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states of the best ways of records that stand one after another in `seen`, and each way's log probability. The
        records go side by side, the longest first, so that those under way at a step are the first ones."""
        order = np.argsort(-lengths, kind="stable")
        begin, n = (np.cumsum(lengths) - lengths)[order], lengths[order]
        layers = [self.walk.start()[:, None] + seen[begin].T[self.cells]]
        for t in range(1, n[0]):
            some = np.searchsorted(-n, -t)
            out = np.full((self.walk.states, some), -np.inf)
            out[self.reached] = np.maximum.reduceat(layers[-1][:, :some][self.src] + self.logp[:, None], self.first, axis=0)
            layers.append(out + seen[begin[:some] + t].T[self.cells])
        path, total, now, going = np.empty(len(seen), dtype=np.int64), np.empty(len(n)), np.empty(len(n), dtype=np.int64), 0
        for t in range(n[0] - 1, -1, -1):
            layer = layers[t]
            at = np.arange(going)
            into = self.from_[now[:going]]
            now[:going] = into[at, np.argmax(layer[into, at[:, None]] + self.by[now[:going]], axis=1)]
            ends = slice(going, layer.shape[1])
            now[ends], total[order[ends]] = np.argmax(layer[:, ends], axis=0), np.max(layer[:, ends], axis=0)
            going = layer.shape[1]
            path[begin[:going] + t] = now[:going]
        return path, total

    def product(self, seen: np.ndarray, begins: bool) -> np.ndarray:
        """The matrix of a block of steps; one row, from the start, if the record begins with it."""
        if begins:
            ways, seen = (self.walk.start() + seen[0][self.cells])[:, None], seen[1:]
        else:
            ways = np.where(np.eye(self.walk.states, dtype=bool), 0.0, -np.inf)
        for row in seen:
            ways = self.forward(ways, row)
        return ways.T

    def path(self, seen: np.ndarray, src: int, dst: int) -> list[int]:
        """The states of a block's best way that comes from `src` (the state before it, or START) and ends in `dst`."""
        layers = [(self.walk.start() + seen[0][self.cells]) if src == START else self.forward(np.where(np.arange(self.walk.states) == src, 0.0, -np.inf)[:, None], seen[0])[:, 0]]
        for row in seen[1:]:
            layers.append(self.forward(layers[-1][:, None], row)[:, 0])
        out = [dst]
        for layer in reversed(layers[:-1]):
            into = np.flatnonzero(self.dst == out[-1])
            out.append(int(self.src[into[np.argmax(layer[self.src[into]] + self.logp[into])]]))
        return out[::-1]


@lru_cache(4)
def steps_of(walk: Walk) -> Steps:
    """The moves of a walk, once in a process."""
    return Steps(walk)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([(row[:, None] + b).max(axis=0) for row in a])


def packed(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, dtype="<f8").tobytes()


def most_likely_walk(seen: DataFrame, walk: Walk, block: int = BLOCK, longest: int = LONG) -> DataFrame:
    """key, t, lati, loni, orientation, speed, logp of the most likely way of each walker through `seen` (key, t, logp): t are
    whole numbers from 0 without gaps, logp an array of the log probabilities of what is observed at t in each cell, row by row
    from the south. logp is that of the whole way. Of equally likely ways any one is told. Records of more than `longest` steps
    are dealt into blocks of `block`."""
    ship(seen.sparkSession)
    seen = seen.select("key", "t", "logp")
    beyond = seen.where(F.col("t") == longest).select(F.col("key").alias("__long"))
    if beyond.isEmpty():
        return _side_by_side(seen, walk)
    beyond = Scratch(seen.sparkSession, "walk").save(beyond)
    is_long = F.col("key").eqNullSafe(F.col("__long"))
    return _side_by_side(seen.join(beyond, is_long, "left_anti"), walk).union(_by_blocks(seen.join(beyond, is_long, "left_semi"), walk, block))


def _side_by_side(seen: DataFrame, walk: Walk) -> DataFrame:
    """The ways of records that a task can hold: each task goes through its records some thousand rows at once."""

    def told(table: pa.Table) -> pa.Table:
        t = table.column("t").to_numpy()
        begin = np.flatnonzero(t == 0)
        lengths = np.diff(np.append(begin, len(t)))
        flat = table.column("logp").combine_chunks().flatten().to_numpy().reshape(len(t), -1)
        path, total = steps_of(walk).best(flat, lengths)
        cell = path // 16
        columns = {"lati": cell // walk.columns, "loni": cell % walk.columns, "orientation": path // 2 % 8, "speed": path % 2}
        return pa.table({"key": table.column("key"), "t": pa.array(t, pa.int64()), **{c: pa.array(v.astype(np.int32)) for c, v in columns.items()}, "logp": pa.array(np.repeat(total, lengths))})

    def walk_all(batches):
        held = None
        for batch in batches:
            new = pa.Table.from_batches([batch])
            held = new if held is None else pa.concat_tables([held, new])
            if held.num_rows < SIDE_BY_SIDE:
                continue
            # the last record may go on in the next batch
            whole = int(np.flatnonzero(held.column("t").to_numpy() == 0)[-1])
            if whole:
                yield from told(held.slice(0, whole)).to_batches()
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from told(held).to_batches()

    kind = dict(seen.dtypes)["key"]
    rows = seen.select("key", F.col("t").cast("long").alias("t"), F.col("logp").cast("array<double>").alias("logp"))
    return rows.repartition("key").sortWithinPartitions("key", "t").mapInArrow(walk_all, OUT.format(kind))


OUT = "key {}, t long, lati int, loni int, orientation int, speed int, logp double"


def _by_blocks(seen: DataFrame, walk: Walk, block: int) -> DataFrame:
    """The ways of records of any length, by products of matrices."""
    spark = seen.sparkSession
    scratch = Scratch(spark, "walk")
    states = walk.states
    kind = dict(seen.dtypes)["key"]
    rows = scratch.save(seen.select("key", "t", F.floor(F.col("t") / block).cast("int").alias("block"), "logp"))

    def ordered(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        t = table.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        return t[order], np.array(table.column("logp").to_pylist(), dtype=float)[order]

    def matrix(data: bytes) -> np.ndarray:
        return np.frombuffer(data, dtype="<f8").reshape(-1, states)

    def multiply(key, table):
        _, x = ordered(table)
        return pa.table({"key": table.column("key").slice(0, 1), "block": pa.array([key[1].as_py()], pa.int32()), "m": [packed(steps_of(walk).product(x, key[1].as_py() == 0))]})

    def join(key, table):
        both = sorted(zip(table.column("block").to_pylist(), table.column("m").to_pylist()))
        m = both[0][1] if len(both) == 1 else packed(joined(matrix(both[0][1]), matrix(both[1][1])))
        return pa.table({"key": table.column("key").slice(0, 1), "block": pa.array([key[1].as_py()], pa.int32()), "m": [m]})

    def meet(key, ends, table):
        """Between the ends of a pair of blocks the state in which they meet."""
        if not ends.num_rows or not table.num_rows:
            return pa.table({"key": ends.column("key").slice(0, 0), "block": pa.array([], pa.int32()), "src": pa.array([], pa.int32()), "dst": pa.array([], pa.int32()), "total": pa.array([], pa.float64())})
        both = sorted(zip(table.column("block").to_pylist(), table.column("m").to_pylist()))
        src, dst, total = (ends.column(c)[0].as_py() for c in ("src", "dst", "total"))
        out = [(both[0][0], src, dst)]
        if len(both) == 2:
            mid = int(np.argmax(matrix(both[0][1])[max(src, 0)] + matrix(both[1][1])[:, dst]))
            out = [(both[0][0], src, mid), (both[1][0], mid, dst)]
        name = pa.concat_arrays([table.column("key").slice(0, 1).combine_chunks()] * len(out))
        return pa.table({"key": name, "block": pa.array([x[0] for x in out], pa.int32()), "src": pa.array([x[1] for x in out], pa.int32()), "dst": pa.array([x[2] for x in out], pa.int32()), "total": pa.array([total] * len(out))})

    def find(key, ends, table):
        t, x = ordered(table)
        path = np.array(steps_of(walk).path(x, ends.column("src")[0].as_py(), ends.column("dst")[0].as_py()))
        cell, turned, fast = path // 16, path // 2 % 8, path % 2
        name = pa.concat_arrays([table.column("key").slice(0, 1).combine_chunks()] * len(t))
        return pa.table({"key": name, "t": pa.array(t, pa.int64()), **{c: pa.array(v.astype(np.int32)) for c, v in (("lati", cell // walk.columns), ("loni", cell % walk.columns), ("orientation", turned), ("speed", fast))}, "logp": pa.array([ends.column("total")[0].as_py()] * len(t))})

    level = scratch.save(rows.groupBy("key", "block").applyInArrow(multiply, f"key {kind}, block int, m binary"))
    levels = [level]
    while (levels[-1].agg(F.max("block")).first()[0] or 0) > 0:
        up = levels[-1].withColumn("up", F.shiftright("block", 1))
        levels.append(scratch.save(up.groupBy("key", "up").applyInArrow(join, f"key {kind}, block int, m binary")))

    def tops(batches):
        for batch in batches:
            best = [matrix(m)[0] for m in batch.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("block"), pa.array([START] * len(best), pa.int32()), pa.array([int(np.argmax(x)) for x in best], pa.int32()), pa.array([float(np.max(x)) for x in best], pa.float64())], names=["key", "block", "src", "dst", "total"])

    ends = scratch.save(levels[-1].mapInArrow(tops, f"key {kind}, block int, src int, dst int, total double"))
    for below in reversed(levels[:-1]):
        pairs = below.withColumn("up", F.shiftright("block", 1))
        told = ends.groupBy("key", "block").cogroup(pairs.groupBy("key", "up")).applyInArrow(meet, f"key {kind}, block int, src int, dst int, total double")
        ends = scratch.save(told)
    return ends.groupBy("key", "block").cogroup(rows.groupBy("key", "block")).applyInArrow(find, OUT.format(kind))


def seen_near(lati: Column, loni: Column, walk: Walk, sd: float) -> Column:
    """Log probabilities, but for a constant, of an observed place (in cells) in each cell: normal with `sd`."""
    far = lambda c: -((F.floor(c / walk.columns) - lati) * (F.floor(c / walk.columns) - lati) + (c % walk.columns - loni) * (c % walk.columns - loni)) / F.lit(2 * sd * sd)
    return F.transform(F.sequence(F.lit(0), F.lit(walk.rows * walk.columns - 1)), far)
