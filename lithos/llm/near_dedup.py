"""Near-duplicate detection by MinHash.

Universal hash minima of each document's shingle set are banded; documents that share a band are candidates, which
their signatures and then their full sets confirm. Connected components come from alternating large-star and small-star
steps. Documents with the same words are one class from the start, so copies never meet each other as candidates.

Inside a band nobody is compared with everybody: each document meets one of its members; what they link becomes one
component; and only what may still hide a link goes on. Pairs of one component need no comparison. Documents of bands that
hold many components, as those do that share a long passage, meet by their rarest shingles: two sets with a link share
one of these, and a passage that many share is not among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import Scratch, for_python, held, trimmed

#: A pair at the least similarity of 0.8 shares none of 40 bands of 5 minima with a chance of 1.3e-7.
ROWS, BANDS, SEED = 5, 40, 20_011
#: Links: 100 * intersection >= 80 * union.
PERCENT = 80
#: A signature may fall short of the least similarity by so many deviations; beyond, the pair is no link (chance 1e-9).
DEVIATIONS = 6.0
#: Members outside a band's largest component that may meet all its members at once: of MinHash bands, of rare shingles.
FEW, MINOR = 2, 16
#: Documents of either side of a block, and shingles of all of them, on average: blocks are as many as both call for.
STRANGERS, EVERYBODY, SHINGLES = 256, 1024, 1 << 21
#: Counters of shingles' rarity; 4 MB.
COUNTERS = 1 << 20
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, one after the other, and where each text's words end. Words are
    hashed eight bytes at a time straight from Arrow's buffers; null texts have none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    low, high = offsets[0], offsets[-1]
    size = int(high - low)
    raw = np.zeros(size + 8, dtype=np.uint8)
    if size:
        raw[:size] = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high]
    raw += ((raw >= 65) & (raw <= 90)).astype(np.uint8) << 5
    gap = np.empty(size + 1, dtype=bool)
    gap[:size] = (raw[:size] == 32) | ((raw[:size] >= 9) & (raw[:size] <= 13))
    gap[size] = True
    first = np.zeros(size + 1, dtype=bool)  # where a text begins, a word does, too
    first[offsets - low] = True
    starts = np.flatnonzero(~gap[:size] & (first[:size] | np.concatenate([[True], gap[:size]])[:size]))
    ends = np.flatnonzero(~gap[:size] & (gap[1:] | first[1:])) + 1
    eight = np.ndarray((size + 1,), dtype=np.uint64, buffer=raw.data, strides=(1,))
    length = (ends - starts).astype(np.uint64)
    out = length * GOLDEN
    at, left, of = starts.copy(), ends - starts, np.arange(len(starts))
    while len(of):
        bits = np.minimum(left, 8).astype(np.uint64) * np.uint64(8)
        block = eight[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - bits))
        out[of] = mixed(out[of] * GOLDEN + block)
        more = left > 8
        of, at, left = of[more], at[more] + 8, left[more] - 8
    return out, np.searchsorted(starts, offsets[1:] - low, side="left")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the `size`-word shingles of a sequence of word hashes; the whole sequence if shorter."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.full(n, np.uint64(min(size, len(words))), dtype=np.uint64)
    for k in range(min(size, len(words))):
        out = mixed(out * GOLDEN + words[k : k + n])
    return np.unique(out)


def sequence_hashes(words: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each text's words in order."""
    begins = np.concatenate([[0], ends[:-1]])
    place = (np.arange(len(words)) - np.repeat(begins, ends - begins)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(words + mixed(place * GOLDEN + np.uint64(seed))))])
    return mixed(total[ends] - total[begins] + (ends - begins).astype(np.uint64))


def minima(sets: list[np.ndarray], rows: int, bands: int, seed: int) -> np.ndarray:
    """Minima of rows * bands multiply-shift hashes (universal) of each non-empty set, as 32-bit integers."""
    r = np.random.default_rng(seed)
    a = r.integers(0, 1 << 63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = r.integers(0, 1 << 63, rows * bands, dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), rows * bands), dtype=np.uint32)
    for k in range(rows * bands):
        out[:, k] = np.minimum.reduceat(((flat * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def slices(ends: np.ndarray, most: int = 100_000):
    """Ranges of rows that hold about `most` words each."""
    lo = begun = 0
    for i, e in enumerate(ends, 1):
        if e - begun >= most or i == len(ends):
            yield lo, i
            lo, begun = i, e


def lists(values: np.ndarray, lengths) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(values))


LONGS, BYTES = T.ArrayType(T.LongType()), T.ArrayType(T.ByteType())


def sketches(docs: DataFrame, size: int, per: int, bands: int, seed: int) -> DataFrame:
    """id, k1, k2 (hashes of the words in order), n (size of the shingle set), signature (the lowest byte of each minimum)
    and the keys of the bands of each row of docs (id, text); the last two null without words."""

    def run(batches):
        held("near", object)
        for batch in batches:
            words, ends = word_hashes(batch.column("text"))
            for lo, hi in slices(ends):
                begin = ends[lo - 1] if lo else 0
                part, stops = words[begin : ends[hi - 1]], ends[lo:hi] - begin
                sets = [shingle_hashes(part[a:b], size) for a, b in zip([0, *stops], stops)]
                full = np.array([len(x) > 0 for x in sets], dtype=bool)
                some = [x for x in sets if len(x)]
                sig = minima(some, per, bands, seed) if some else np.zeros((0, per * bands), np.uint32)
                keys = np.arange(bands, dtype=np.uint64)[None, :] + np.zeros((len(some), 1), dtype=np.uint64)
                for k in range(per):
                    keys = mixed(keys * GOLDEN + sig[:, k * bands : (k + 1) * bands])
                own = [pa.array(sequence_hashes(part, stops, x).view(np.int64)) for x in (1, 2)]
                own += [pa.array([len(x) for x in sets], pa.int64()), spread(sig.astype(np.uint8).view(np.int8), full), spread(keys.view(np.int64), full)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(lo, hi - lo), *own], names=["id", "k1", "k2", "n", "signature", "keys"])

    own = [("k1", T.LongType()), ("k2", T.LongType()), ("n", T.LongType()), ("signature", BYTES), ("keys", LONGS)]
    return docs.mapInArrow(trimmed(run), T.StructType([docs.schema["id"], *(T.StructField(*x) for x in own)]))


def spread(rows: np.ndarray, full: np.ndarray) -> pa.Array:
    """Lists of the rows of a matrix, one for each true value of `full`; null for the others."""
    found = lists(np.ascontiguousarray(rows).ravel(), [rows.shape[1]] * len(rows))
    place = np.where(full, np.cumsum(full) - 1, -1)
    return found.take(pa.array(place, mask=~full)) if not full.all() else found


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """id, shingles of docs (id, text)."""

    def run(batches):
        for batch in batches:
            words, ends = word_hashes(batch.column("text"))
            sets = [shingle_hashes(words[a:b], size) for a, b in zip([0, *ends], ends)]
            both = np.concatenate([np.zeros(0, np.uint64), *sets])
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists(both.view(np.int64), map(len, sets))], names=["id", "shingles"])

    return docs.mapInArrow(trimmed(run), T.StructType([docs.schema["id"], T.StructField("shingles", LONGS)]))


class Confirm:
    """Decides which pairs (a, b) are links: by length, then by signature, then by their full sets."""

    def __init__(self, docs: DataFrame, sets: DataFrame, scratch: Scratch, size: int, percent: int, hashes: int):
        self.docs, self.sets, self.scratch, self.size, self.percent = docs, sets, scratch, size, percent
        least = percent / 100
        self.same = least * hashes - DEVIATIONS * (least * (1 - least) * hashes) ** 0.5

    def __call__(self, pairs: DataFrame) -> DataFrame:
        sig = self.sets.select("id", "n", "signature")
        one, two = (sig.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in ("a", "b"))
        near = pairs.join(one, "a").join(two, "b").where(100 * F.least("na", "nb") >= self.percent * F.greatest("na", "nb"))
        same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
        likely = self.scratch.save(near.where(same >= self.same).select("a", "b", "na", "nb"))
        # the texts of these pairs only are read again; a small list of them is broadcast, by Spark's own size check
        ids = self.scratch.save(likely.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("pairs")))
        full = self.scratch.save(full_sets(self.docs.join(ids, "id", "left_semi"), self.size))
        # the set of the one with more pairs comes last, so that it isn't moved with each of them
        one, two = (ids.select(F.col("id").alias(x), F.col("pairs").alias(f"p{x}")) for x in ("a", "b"))
        turned = F.col("pa") > F.col("pb")
        met = likely.join(one, "a").join(two, "b").withColumn("few", F.when(turned, F.col("b")).otherwise(F.col("a"))).withColumn("many", F.when(turned, F.col("a")).otherwise(F.col("b")))
        one, two = (full.select(F.col("id").alias(x), F.col("shingles").alias(f"w{x}")) for x in ("few", "many"))
        seen = met.join(one, "few").join(two, "many").withColumn("both", F.size(F.array_intersect("wfew", "wmany")))
        out = self.scratch.save(seen.where(100 * F.col("both") >= self.percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b"))
        for old in (likely, ids, full):
            self.scratch.drop(old)
        return out


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """id, component of every node that the edges (a, b) hold: the smallest id reachable.

    Alternates large-star (each node links its larger neighbours to its smallest) and small-star (each node links its
    smaller neighbours and itself to the smallest) until nothing changes: every tree is a star then.
    """
    links = scratch.save(edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("m").alias("u"), "v")
        large = scratch.save(large.distinct())
        low2 = scratch.save(large.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")))
        small = large.join(low2.where("n > 1"), "v").where("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))
        after = scratch.save(small.union(low2.select(F.col("m").alias("u"), "v")).distinct())
        # every tree is a star when no node has two smaller neighbours and none with larger ones has a smaller one
        star = after.join(after.select(F.col("v").alias("u")), "u", "left_semi").isEmpty() and after.groupBy("v").count().where("count > 1").isEmpty()
        for old in (links, low, large, low2):
            scratch.drop(old)
        links = after
        if star:
            return links.select(F.col("v").alias("id"), F.col("u").alias("component"))


def prefixes(full: DataFrame, percent: int) -> DataFrame:
    """band, id, n: each set's rarest shingles, so many that two sets with a link share one of them at least.

    That holds in any order of shingles that is the same for all sets; it is efficient if rare ones come first, because what
    many documents share is then in the prefix of hardly any. Rarity is counted in COUNTERS counters by hash, a table of
    fixed size that is broadcast; shingles that share a counter cost some candidates and lose none.
    """
    spark = full.sparkSession
    rows = full.select(F.explode("shingles").alias("s")).groupBy(F.pmod("s", F.lit(COUNTERS)).alias("c")).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counters = np.zeros(COUNTERS, dtype=np.uint32)
    counters[rows.column("c").to_numpy()] = np.minimum(rows.column("n").to_numpy(), 2**32 - 1)
    shared = spark.sparkContext.broadcast(counters)

    def run(batches):
        held("near", object)
        for batch in batches:
            sets = [x.values.to_numpy() for x in batch.column("shingles")]
            size = np.array([len(x) for x in sets], dtype=np.int64)
            most = size - (size * percent + 99) // 100 + 1
            rare = [s[np.lexsort((s, shared.value[s % COUNTERS]))[:k]] for s, k in zip(sets, most)]
            of = np.repeat(np.arange(len(sets)), [len(x) for x in rare])
            bands = np.concatenate([np.zeros(0, np.int64), *rare])
            yield pa.RecordBatch.from_arrays([pa.array(bands), batch.column("id").take(pa.array(of)), pa.array(size[of])], names=["band", "id", "n"])

    fields = [T.StructField("band", T.LongType()), full.schema["id"], T.StructField("n", T.LongType())]
    return full.mapInArrow(trimmed(run), T.StructType(fields))


class Components:
    """Components of the nodes that have had a link so far, and the bands that may still hide one."""

    def __init__(self, confirm: Confirm, scratch: Scratch):
        self.confirm, self.scratch, self.table = confirm, scratch, None

    def named(self, rows: DataFrame) -> DataFrame:
        """band, id, n with the component."""
        if self.table is None:
            return rows.withColumn("component", F.col("id"))
        now = self.table.select("id", F.col("component").alias("now"))
        return rows.join(now, "id", "left").select("band", "id", "n", F.coalesce("now", "id").alias("component"))

    def merge(self, links: DataFrame) -> None:
        """Merge what links (a, b) hold together."""
        if not links.isEmpty():
            stars = links.limit(0) if self.table is None else self.table.select(F.col("component").alias("a"), F.col("id").alias("b"))
            self.table = self.scratch.save(connected_components(links.union(stars), self.scratch))

    def state(self, rows: DataFrame) -> DataFrame:
        """Bands of several components: the largest one (main), the members outside (minor), all members (m)."""
        size = rows.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
        bands = size.groupBy("band").agg(F.sum("n").alias("m"), F.max(F.struct("n", "component")).alias("top"))
        return self.scratch.save(bands.where("top.n < m").select("band", F.col("top.component").alias("main"), (F.col("m") - F.col("top.n")).alias("minor"), "m"))

    def meet(self, rows: DataFrame, hubs: DataFrame) -> DataFrame:
        """Pairs of hubs (band, hub, of, size) and members of other components whose sizes allow a link."""
        near = 100 * F.least("n", "size") >= self.confirm.percent * F.greatest("n", "size")
        met = rows.join(self.scratch.save(hubs), "band").where((F.col("component") != F.col("of")) & near)
        return met.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))

    def outside(self, rows: DataFrame, bands: DataFrame) -> DataFrame:
        """The members of these bands that aren't in the largest component, as hubs."""
        own = rows.join(bands.select("band", "main"), "band").where("component <> main")
        return own.select("band", F.col("id").alias("hub"), F.col("component").alias("of"), F.col("n").alias("size"))


def link_bands(member: DataFrame, confirm: Confirm, scratch: Scratch) -> DataFrame | None:
    """id, component of the nodes of the bands `member` (band, id, n) that have a link; None if there are no pairs.

    First each band's members meet one of them. A band is done when it is one component. Where few members are outside its
    largest component, they meet all. The documents of the other bands meet by shared rare shingles instead, and where many
    of these are outside a large component, in blocks.
    """
    many = member.groupBy("band").agg(F.count(F.lit(1)).alias("members"), F.min_by("id", F.xxhash64("id", "band")).alias("hub")).where("members > 1")
    left = scratch.save(member.join(scratch.save(many), "band"))
    if left.isEmpty():
        return None
    known = Components(confirm, scratch)
    links = confirm(scratch.save(left.where("id <> hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()))
    known.merge(links)
    left = scratch.save(known.named(left.select("band", "id", "n")))
    state = known.state(left)
    pairs = known.meet(left, known.outside(left, state.where(F.col("minor") <= FEW)))
    crowded = scratch.save(left.join(state.where(F.col("minor") > FEW), "band", "left_semi").select("id").distinct())
    met = links.limit(0)
    if not crowded.isEmpty():
        full = scratch.save(full_sets(confirm.docs.join(crowded, "id", "left_semi"), confirm.size))
        rare = scratch.save(prefixes(full, confirm.percent))
        shared = rare.groupBy("band").agg(F.count(F.lit(1)).alias("members")).where("members > 1").select("band")
        rows = scratch.save(known.named(rare.join(scratch.save(shared), "band")))
        state = known.state(rows)
        dominated = F.col("minor") > MINOR
        pairs = pairs.union(known.meet(rows, known.outside(rows, state.where(~dominated))))
        groups = rows.join(state.where(dominated).select("band", "main"), "band")
        strangers = scratch.save(groups.where("component <> main").select("main", "id", "n").distinct())
        everybody = scratch.save(groups.select("main", "id", "n").distinct())
        met = scratch.save(in_blocks(strangers, everybody, full, confirm.percent))
    known.merge(confirm(scratch.save(pairs.distinct())).union(met))
    return known.table


def shared_counts(sets: list[np.ndarray], others):
    """For each of `others`, how many elements it shares with each of `sets`; all are sorted and hold an element once. What
    it takes is the size of the sets."""
    size = [len(x) for x in sets]
    every = np.concatenate([np.zeros(0, np.int64), *sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], np.repeat(np.arange(len(sets)), size)[order]
    for s in others:
        lo, hi = np.searchsorted(every, s, "left"), np.searchsorted(every, s, "right")
        n = hi - lo
        at = np.arange(n.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        yield np.bincount(of[at], minlength=len(sets))


def in_blocks(strangers: DataFrame, everybody: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the strangers of a group (main, id, n) and everybody of it. Both are dealt into blocks of bounded
    size, in documents and in shingles, that meet in a task of their own, so that no pair that is no link becomes a row."""
    def dealt(side, most):
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / most, F.sum("n") / SHINGLES)).cast("int")
        return side.select("main", "id"), side.groupBy("main").agg(blocks.alias("blocks"))

    (left, of_left), (right, of_right) = dealt(strangers, STRANGERS), dealt(everybody, EVERYBODY)
    both = of_left.withColumnRenamed("blocks", "lb").join(of_right.withColumnRenamed("blocks", "rb"), "main")
    number = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = left.join(both, "main").select("main", number("lb").alias("l"), every("rb").alias("r"), "id").join(full, "id")
    two = right.join(both, "main").select("main", every("lb").alias("l"), number("rb").alias("r"), "id").join(full, "id")
    kind = full.schema["id"].dataType.simpleString()

    def compare(key, a: pa.Table, b: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        if a.num_rows and b.num_rows:
            ids, sets = a.column("id").to_pylist(), [x.values.to_numpy() for x in a.column("shingles")]
            size = np.array([len(x) for x in sets])
            others = (x.values.to_numpy() for x in b.column("shingles_"))
            for other, m, n in zip(b.column("id_").to_pylist(), pc.list_value_length(b.column("shingles_")).to_pylist(), shared_counts(sets, others)):
                for k in np.flatnonzero(100 * n >= percent * (size + m - n)):
                    if ids[k] != other:
                        out_a.append(ids[k])
                        out_b.append(other)
        return pa.table({"x": pa.array(out_a, a.schema.field("id").type), "y": pa.array(out_b, a.schema.field("id").type)})

    key = ["main", "l", "r"]
    # other names, because both sides come from one table
    two = two.select(*(F.col(c).alias(f"{c}_") for c in (*key, "id", "shingles")))
    found = one.select(*key, "id", "shingles").groupBy(*key).cogroup(two.groupBy(*(f"{c}_" for c in key))).applyInArrow(compare, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = PERCENT, per: int = ROWS, bands: int = BANDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row of `docs`; documents are linked if `size`-word shingle sets have
    a similarity of `percent` / 100 or more.

    A text of fewer words is one shingle; a null text, and one without words, has none and is linked with nothing. The
    component's id is the smallest id reachable; kept marks the row with that id. A row with a null id is linked by equal
    words only; with rows with null ids alone, its component_id is null and it is kept. Rows that repeat an id are taken as
    one document whose texts all count. An empty table gives an empty result; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    for_python(spark)
    scratch = Scratch(spark, "near")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    every = scratch.save(sketches(rows, size, per, bands, seed))
    # classes of equal word sequences; partial aggregation meets hot ones
    classes = scratch.save(every.where("n > 0").groupBy("k1", "k2").agg(F.min("id").alias("id")))
    first = every.join(classes, ["k1", "k2", "id"], "left_semi").dropDuplicates(["id", "k1", "k2"])
    first = scratch.save(first.select("id", "n", "signature", "keys"))
    sets, first_keys = first.select("id", "n", "signature"), first.select(F.explode("keys").alias("band"), "id", "n")
    confirm = Confirm(rows, sets, scratch, size, percent, per * bands)
    component = link_bands(first_keys, confirm, scratch)
    named = classes if component is None else classes.join(component, "id", "left")
    found = F.col("id") if component is None else F.coalesce("component", "id")
    named = scratch.save(named.select("k1", "k2", found.alias("component_id")))
    linked = every.where("n > 0").select("id", "n", "k1", "k2").join(named, ["k1", "k2"]).select("id", "n", "component_id")
    alone = every.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return linked.union(alone).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
