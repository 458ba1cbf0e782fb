"""BPE encoding and decoding by tree concatenation.

A text is composed and lower-cased first, as the tokenizer does. It is then encoded in halves of halves: its leaves are
encoded on their own, in parallel, and neighbours are joined pairwise up the tree. At a join the text of a few tokens from
both sides is encoded again, in a window that grows until the new tokens meet a token of the left side and one of the right
side with the same id and place; from there on both sides stand, because whether a BPE sequence is the right one depends on
neighbouring tokens only. That holds for merges and not for the composition of characters, so a cut never falls where
characters may compose or change places, or inside a special token: what stands around such a place is held back, as text,
until both of its sides are there. Where the tokenizer always drops a character (a space or line end), the runs around it
are independent and a leaf is one such run, with its ids kept in a bounded cache. The texts of a batch are split into runs by
Arrow, which numbers the distinct ones; only these are looked up, and numpy lays their ids out in the order of the texts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from array import array
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import Scratch, for_python, held, quoted, trimmed

#: Texts above this many characters are dealt out to tasks in pieces of it.
PIECE = 32_768
#: Characters of a leaf inside an unsplit run, and tokens on either side of the first window.
LEAF, WINDOW = 512, 8
#: Distinct runs in each of the two generations that a worker keeps, and the longest of them.
CACHE, CACHED_CHARS = 200_000, 64
#: Characters of the texts that are split into runs at once; a text alone may hold more.
AT_ONCE = 1 << 21

@lru_cache(None)
def composers() -> frozenset:
    """Characters that may compose with the one before: seconds of canonical pairs, vowels and final consonants of Hangul."""
    pairs = (unicodedata.decomposition(chr(c)).split() for c in range(0x110000))
    seconds = {chr(int(p[1], 16)) for p in pairs if len(p) == 2 and not p[0].startswith("<")}
    return frozenset(seconds | {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))})


@lru_cache(65_536)
def apart(c: str) -> bool:
    """Whether nothing that stands before this character can change it or what follows it, or be changed by it, when a text
    is composed. An unassigned character may come to do so in a later version of Unicode."""
    if c < "\u0300":
        return True
    first = unicodedata.normalize("NFD", c)[0]
    return unicodedata.category(c) != "Cn" and not unicodedata.combining(first) and first not in composers()


class Codec:
    """A tokenizer file (the JSON of the tokenizers library) that composes, folds white space, lower-cases, splits by letters,
    digits and others without white space, and then encodes the bytes of each part. Other files are refused."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        kinds = json.loads(spec)
        steps = [[x["type"] for x in (kinds[k] or {}).get(f"{k.replace('_', '')}s", [])] for k in ("normalizer", "pre_tokenizer")]
        added = kinds["added_tokens"]
        splits = [x for x in (kinds["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"]
        if any(x["behavior"] != "Removed" or not x["invert"] for x in splits) or steps != [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] or any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"[ \n]", x["content"]) for x in added):
            raise ValueError("needs a tokenizer that lower-cases, splits without white space and encodes bytes")
        self.tokenizer = Tokenizer.from_str(spec)
        self.special = {x["content"]: x["id"] for x in added}
        #: Special tokens as they stand in a text, which the tokenizer looks for before it does anything else.
        self.specials = re.compile("|".join(map(re.escape, sorted(self.special, key=lambda x: (-len(x), x)))) or r"(?!)")
        self.begins, self.ends, self.reach = {x[0] for x in self.special}, {x[-1] for x in self.special}, max(map(len, self.special), default=1) - 1
        #: The tokenizer of texts that are composed and lower-cased already; what looks like a special token there is none.
        self.inner = Tokenizer(self.tokenizer.model)
        self.inner.pre_tokenizer = self.tokenizer.pre_tokenizer
        if self.tokenizer.post_processor:
            self.inner.post_processor = self.tokenizer.post_processor
        self.tokenize = self.tokenizer.model.tokenize
        #: The parts of a run.
        self.split = regex.compile(kinds["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.runs_ids = Kept(self.run)

    @cached_property
    def width(self) -> dict[int, int]:
        """Bytes of each token's spelling; the mark of a word's end is none of them."""
        return {i: len(x.removesuffix("</w>")) for x, i in self.tokenizer.get_vocab(with_added_tokens=False).items()}

    def normal(self, text: str) -> str:
        """A text without special tokens, composed and lower-cased. Characters of Latin-1 don't compose, and Python lower-cases
        them as the tokenizer does; a comma or stop that is a token of its own is set apart, so that fewer runs are distinct."""
        try:
            text.encode("latin-1")
        except UnicodeError:
            return self.tokenizer.normalizer.normalize_str(text)
        text = text.lower()
        for mark in ",.":
            parts = text.split(mark)
            if len(parts) > 1:
                apart = " " + mark
                marks = [apart if b[:1] in GAPS and a[-1:] in LETTERS else mark for a, b in zip(parts, parts[1:])]
                text = "".join(chain.from_iterable(zip(parts, marks))) + parts[-1]
        return text

    def stretches(self, text: str) -> tuple[list[str], list[int]]:
        """The stretches of a text around the special tokens that it spells out, normalised, and the ids of these."""
        out, marks, at = [], [], 0
        if any(c in text for c in self.begins):
            for m in self.specials.finditer(text):
                out.append(self.normal(text[at : m.start()]))
                marks.append(self.special[m[0]])
                at = m.end()
        return [*out, self.normal(text[at:])], marks

    def cuts(self, text: str) -> tuple[int, int]:
        """Where the first and the last place are at which `text`, cut from a longer one, may be cut again: characters on
        both sides don't compose, and no special token lies across. Its length twice if there is none."""
        n, r = len(text), self.reach
        inside = {i for m in self.specials.finditer(text) for i in range(m.start() + 1, m.end())}
        first = max((i + 1 for i in range(min(r, n)) if text[i] in self.ends), default=0)
        first = next((i for i in range(first, n) if i not in inside and apart(text[i])), n)
        last = next((i for i in range(max(0, n - r), n) if text[i] in self.begins), n - 1)
        last = next((i for i in range(last, first, -1) if i not in inside and apart(text[i])), first)
        return first, last

    def spans(self, text: str, at: int = 0) -> np.ndarray:
        """Rows (id, start, end), one a token of a normalised text, which begins at character `at` of a longer one."""
        e = self.inner.encode(text, add_special_tokens=False)
        return rows_of(e) + np.array([0, at, at], dtype=np.int32)

    def places(self, text: str, rows: np.ndarray) -> list[tuple]:
        """(id, character, byte) of each token of rows that begin with a character: the place where it begins, as a byte within
        the character that its offsets name. A character that is several tokens gives them all the same offsets; such a token
        begins where the one before it ends, which the lengths of their spellings say."""
        out, over = [], -1
        for token, start, end in rows.tolist():
            byte = 0
            if start < over:
                before, at, byte = out[-1]
                byte += self.width[before] - (len(text[at:start].encode()) if start > at else 0)
            out.append((token, start, byte))
            over = end
        return out

    def tree(self, text: str, at: int, size: int) -> np.ndarray:
        """Tokens of text[at:at + size]: both halves', joined."""
        if size <= LEAF:
            return self.spans(text[at : at + size], at)
        half = size // 2
        return self.join(text, self.tree(text, at, half), self.tree(text, at + half, size - half), at, at + half, at + size)

    def join(self, text: str, left: np.ndarray, right: np.ndarray, begin: int, cut: int, end: int) -> np.ndarray:
        """Tokens of text[begin:end] from those of text[begin:cut] and text[cut:end]."""
        width = WINDOW
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            while i and left[i, 1] < left[i - 1, 2]:  # several tokens from one character: not apart
                i -= 1
            while 0 < j < len(right) and right[j, 1] < right[j - 1, 2]:
                j += 1
            a = int(left[i, 1]) if i else begin
            b = int(right[j - 1, 2]) if j < len(right) else end
            new = self.spans(text[a:b], a)
            place = {t: k for k, t in enumerate(self.places(text, new))}
            # a token of each side that the window has too; a side that the window holds whole needs none
            before, behind = self.places(text, left[i:]), self.places(text, right[:j])
            first = (0, 0) if not i else next(((p, place[t]) for p, t in enumerate(before, i) if t in place), None)
            last = (j, len(new)) if j == len(right) else next(((p, place[behind[p]]) for p in range(j - 1, -1, -1) if behind[p] in place), None)
            if first and last and first[1] <= last[1]:
                return np.concatenate([left[: first[0]], new[first[1] : last[1]], right[last[0] :]])
            if not i and j == len(right):
                return new
            width *= 2

    def rows(self, text: str) -> tuple[str, np.ndarray]:
        """A text without gaps, normalised, and its token rows."""
        run = self.normal(text)
        return run, self.tree(run, 0, len(run))

    def run(self, run: str) -> bytes:
        """Packed ids of a run. One of printable Latin-1 is split into its parts here, which are runs of their own; a part goes to
        the model as the vocabulary spells it. The tokenizer itself takes all others."""
        if len(run) > LEAF:
            return packed(self.tree(run, 0, len(run))[:, 0])
        if run.isascii() and run.isalpha():
            return packed([t.id for t in self.tokenize(run)])
        if run.isprintable() and LATIN(run):
            parts = [] if run.isalpha() else self.split.findall(run)
            if len(parts) > 1:
                return b"".join(map(self.runs_ids.__getitem__, parts))
            return packed([t.id for t in self.tokenize(run if run.isascii() else run.encode().decode("latin-1").translate(BYTES))])
        return packed(self.inner.encode(run, add_special_tokens=False).ids)

    def laid_out(self, stretches: list[str]) -> list[np.ndarray]:
        """Ids of each of some normalised stretches, whose equal runs are looked up once."""
        split = pc.split_pattern(pc.replace_substring(pa.array(stretches, pa.large_string()), "\n", " "), " ")
        runs = split.flatten().dictionary_encode()
        found = list(map(self.runs_ids.__getitem__, runs.dictionary.to_numpy(zero_copy_only=False).tolist()))
        self.runs_ids.age()
        ids, which = np.frombuffer(b"".join(found), dtype=np.int32), runs.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // ids.itemsize
        each, begins = sizes[which], (np.cumsum(sizes) - sizes)[which]
        ends = np.concatenate([[0], np.cumsum(each)])
        out = ids[np.repeat(begins - ends[:-1], each) + np.arange(ends[-1])]
        bounds = ends[split.offsets.to_numpy()].tolist()
        return [out[a:b] for a, b in zip(bounds, bounds[1:])]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, whole. Equal texts are encoded once."""
        found, waiting, chars = {}, {}, 0
        for t in dict.fromkeys(texts):
            waiting[t] = self.stretches(t)
            chars += len(t)
            if chars >= AT_ONCE:
                found |= self.put_together(waiting)
                waiting, chars = {}, 0
        found |= self.put_together(waiting)
        return [found[t] for t in texts]

    def put_together(self, waiting: dict) -> dict:
        """Ids of each text from its stretches and the ids of the special tokens between them."""
        some = iter(self.laid_out([s for stretches, _ in waiting.values() for s in stretches]))
        out = {}
        for t, (stretches, marks) in waiting.items():
            x = next(some)
            out[t] = np.concatenate([x, *chain.from_iterable((np.array([m], dtype=np.int32), next(some)) for m in marks)]) if marks else x
        return out


class Kept(dict):
    """What make(key) gives, for the keys asked for of late: when there are CACHE, the short ones become the older generation,
    from which those that are asked for again come back."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        if (x := self.old.get(key)) is None:
            x = self.make(key)
        self[key] = x
        return x

    def age(self) -> None:
        if len(self) > CACHE:
            self.old = {w: x for w, x in self.items() if len(w) <= CACHED_CHARS}
            self.clear()


GAP = re.compile("[ \n]")
LATIN = re.compile("[\0-\xff]+").fullmatch
#: In lower case, a comma or stop behind one of these letters and before a gap is a token of its own.
LETTERS, GAPS = frozenset(map(chr, [*range(97, 123), *range(0xDF, 0xF7), *range(0xF8, 0x100)])), frozenset(" \n")


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte of a byte-level vocabulary: itself where it is printable, else the next free
    one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


BYTES = byte_characters()


def packed(ids) -> bytes:
    return array("i", ids).tobytes()


def rows_of(e) -> np.ndarray:
    return np.array([(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)], dtype=np.int32).reshape(-1, 3)


def codec_of(spec: str) -> Codec:
    """The codec of this tokenizer file, built once in a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return held(("bpe", hashlib.sha256(spec.encode()).hexdigest()), lambda: Codec(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def in_arrow(rows: DataFrame, drop: list[str], fields: list, run) -> DataFrame:
    """`rows` without the columns `drop` and with `fields`, whose values run(batch) gives as Arrow arrays."""
    carried = [c for c in rows.columns if c not in drop]
    schema = T.StructType([rows.schema[c] for c in carried] + fields)
    names = [*carried, *(f.name for f in fields)]

    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *run(batch)], names=names)

    return rows.mapInArrow(trimmed(each), schema)


INTS = T.ArrayType(T.IntegerType())
#: A piece of a long text: text that is held back at its begin; what stands before its first gap (space, line end, special
#: token), normalised, with its token rows; the ids between that and the last gap (null if there is none: then all is in
#: front); what stands behind, with its rows; text that is held back at its end. A null front: all of it is held back.
PART = [
    T.StructField("head", T.StringType()), T.StructField("front", T.StringType()), T.StructField("front_rows", INTS), T.StructField("ids", INTS),
    T.StructField("behind", T.StringType()), T.StructField("behind_rows", INTS), T.StructField("tail", T.StringType()),
]


class Run:
    """Normalised text in tokens: a run up to its first gap, ids up to its last one (None without gaps), a run behind."""

    def __init__(self, front="", front_rows=None, ids=None, behind="", behind_rows=None):
        self.front, self.behind, self.ids = front, behind, None if ids is None else np.asarray(ids, dtype=np.int32)
        self.front_rows, self.behind_rows = (np.asarray([] if x is None else x, dtype=np.int32).reshape(-1, 3) for x in (front_rows, behind_rows))

    @classmethod
    def of(cls, codec: Codec, text: str) -> "Run":
        gaps = [m.span() for m in codec.specials.finditer(text)]
        if m := GAP.search(text):
            end = 1 + max(text.rfind(" "), text.rfind("\n"))
            gaps += [m.span(), (end - 1, end)]
        if not gaps:
            return cls(*codec.rows(text))
        first, last = min(a for a, _ in gaps), max(b for _, b in gaps)
        return cls(*codec.rows(text[:first]), codec.ids([text[first:last]])[0], *codec.rows(text[last:]))

    def then(self, codec: Codec, other: "Run") -> "Run":
        a, rows = (self.front, self.front_rows) if self.ids is None else (self.behind, self.behind_rows)
        cut, run = len(a), a + other.front
        rows = codec.join(run, rows, other.front_rows + np.array([0, cut, cut], dtype=np.int32), 0, cut, len(run))
        if self.ids is None:
            return Run(run, rows, other.ids, other.behind, other.behind_rows)
        if other.ids is None:
            return Run(self.front, self.front_rows, self.ids, run, rows)
        return Run(self.front, self.front_rows, np.concatenate([self.ids, rows[:, 0], other.ids]), other.behind, other.behind_rows)

    def all_ids(self) -> np.ndarray:
        return np.concatenate([self.front_rows[:, 0], np.zeros(0, np.int32) if self.ids is None else self.ids, self.behind_rows[:, 0]])


class Part:
    """A piece of a long text, or several joined: a run between texts that are held back. Without a run, all is in `head`."""

    def __init__(self, head: str, run: Run | None, tail: str = ""):
        self.head, self.run, self.tail = head, run, tail

    @classmethod
    def of(cls, codec: Codec, text: str) -> "Part":
        first, last = codec.cuts(text)
        return cls(text[:first], Run.of(codec, text[first:last]) if first < len(text) else None, text[last:])

    def then(self, codec: Codec, other: "Part") -> "Part":
        if self.run is None:
            return Part(self.head + other.head, other.run, other.tail)
        if other.run is None:
            return Part(self.head, self.run, self.tail + other.head)
        middle = Run.of(codec, self.tail + other.head)
        return Part(self.head, self.run.then(codec, middle).then(codec, other.run), other.tail)

    def all_ids(self, codec: Codec) -> np.ndarray:
        """Ids of a whole text, of which nothing is held back any more."""
        ends = [Run.of(codec, x) for x in (self.head, self.tail)]
        return (ends[0] if self.run is None else ends[0].then(codec, self.run).then(codec, ends[1])).all_ids()

    @staticmethod
    def arrays(parts: list["Part"]) -> list:
        runs = [p.run or Run() for p in parts]
        text = lambda xs: pa.array(xs, pa.string())
        ints = lambda xs: pa.array([None if x is None else x.ravel() for x in xs], pa.list_(pa.int32()))
        front = text([None if p.run is None else p.run.front for p in parts])
        return [text([p.head for p in parts]), front, ints([r.front_rows for r in runs]), ints([r.ids for r in runs]), text([r.behind for r in runs]), ints([r.behind_rows for r in runs]), text([p.tail for p in parts])]

    @staticmethod
    def read(batch, mark: str = "") -> list:
        columns = [[x.values.to_numpy() if x.is_valid else None for x in c] if pa.types.is_list(c.type) else c.to_pylist() for c in (batch.column(f.name + mark) for f in PART)]
        return [None if x[0] is None else Part(x[0], None if x[1] is None else Run(*x[1:6]), x[6]) for x in zip(*columns)]


def ids_array(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def decoded_array(codec: Codec, ids) -> pa.Array:
    return pa.array([codec.tokenizer.decode(x.tolist(), skip_special_tokens=False) for x in ids], pa.string())


def tree_encode(texts: DataFrame, shared, piece: int, fields: list, values) -> DataFrame:
    """key and `fields`, whose arrays values(codec, ids) gives, of each distinct (key, text): its pieces are encoded by
    different tasks and joined up the tree. Pieces are longer than any special token, so that one lies in two at most."""
    scratch = Scratch(texts.sparkSession, "bpe")
    n = F.ceil(F.length("text") / F.lit(piece)).cast("int")
    cut = texts.select("key", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring("text", i * piece + 1, F.lit(piece)))).alias("k", "part"))
    pieces = cut.dropDuplicates(["key", "k"])

    def encode(batch):
        codec = codec_of(shared.value)
        if piece <= codec.reach:
            raise ValueError("pieces must be longer than special tokens")
        return Part.arrays([Part.of(codec, t) for t in batch.column("part").to_pylist()])

    def pair(batch):
        codec = codec_of(shared.value)
        return Part.arrays([a if b is None else a.then(codec, b) for a, b in zip(Part.read(batch), Part.read(batch, "2"))])

    def finish(batch):
        codec = codec_of(shared.value)
        return values(codec, [p.all_ids(codec) for p in Part.read(batch)])

    names = [f.name for f in PART]
    level = scratch.save(in_arrow(pieces, ["part"], PART, encode))
    while (level.agg(F.max("k")).first()[0] or 0) > 0:
        odd = level.where("k % 2 = 1").select("key", F.shiftright("k", 1).alias("k"), *(F.col(c).alias(f"{c}2") for c in names))
        even = level.where("k % 2 = 0").withColumn("k", F.shiftright("k", 1))
        rows = even.join(odd, ["key", "k"], "left")
        above = scratch.save(in_arrow(rows, [*names, *(f"{c}2" for c in names)], PART, pair))
        scratch.drop(level)
        level = above
    return in_arrow(level.drop("k"), names, fields, finish)


def encoded(docs: DataFrame, path: str, text_col: str, carried: list[str], out: list, values, piece: int = PIECE) -> DataFrame:
    """The columns `carried` of `docs` and the fields `out`, whose Arrow arrays values(codec, ids) makes of the ids of some
    texts. Texts of more than `piece` characters are encoded in pieces by different tasks and joined up a tree."""
    spark = docs.sparkSession
    for_python(spark)
    shared = spark.sparkContext.broadcast(read_spec(path))
    # columns go to Python by number, because names may hold anything
    numbered = [f"c{k}" for k in range(len(carried))]
    rows = docs.select(*(F.col(quoted(c)) for c in carried), F.coalesce(F.col(quoted(text_col)), F.lit(""))).toDF(*numbered, "text")
    fields = [T.StructField(f"f{k}", f.dataType) for k, f in enumerate(out)]

    def whole(batch):
        codec = codec_of(shared.value)
        return values(codec, codec.ids(batch.column("text").to_pylist()))

    short = in_arrow(rows.where(F.length("text") <= piece), ["text"], fields, whole)
    long = rows.where(F.length("text") > piece).withColumn("key", F.sha2("text", 256))
    joined = long.drop("text").join(tree_encode(long.select("key", "text"), shared, piece, fields, values), "key").drop("key")
    return short.unionByName(joined).toDF(*carried, *(f.name for f in out))


def bpe_encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, piece: int = PIECE, keep_text: bool = True) -> DataFrame:
    """`docs` with the column `ids_col` (array<int>): the ids that the tokenizer file at `path` gives to the whole text,
    without special tokens added; and, if named, `decoded_col`, what they decode to. They replace columns of their names.
    Without `keep_text` the column `text_col` is left out, so that it doesn't come back from Python.

    A null text counts as empty; an empty one has no ids. Special tokens that a text spells out are encoded as such, as
    the library does. Rows may repeat; an empty table gives an empty result; all other columns are kept, whatever their
    names.
    """
    carried = [c for c in docs.columns if c not in (ids_col, decoded_col) and (keep_text or c != text_col)]
    fields = [T.StructField(ids_col, INTS), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]

    def values(codec, ids):
        return [ids_array(ids), *([decoded_array(codec, ids)] if decoded_col else [])]

    return encoded(docs, path, text_col, carried, fields, values, piece)


def bpe_decode(rows: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """`rows` with the column `decoded_col`: what the tokenizer's decode() gives for `ids_col`, special tokens kept. Null
    ids give an empty text; an id that the file doesn't have adds nothing, as in the library."""
    spark = rows.sparkSession
    for_python(spark)
    shared = spark.sparkContext.broadcast(read_spec(path))

    def run(batch):
        return [decoded_array(codec_of(shared.value), (x.values.to_numpy() if x.is_valid else np.zeros(0, np.int32) for x in batch.column(ids_col)))]

    return in_arrow(rows.drop(decoded_col), [], [T.StructField(decoded_col, T.StringType())], run)


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row of `docs` (doc_id, text)."""
    rows = bpe_encode(docs.select("doc_id", "text"), path, decoded_col="decoded", keep_text=False)
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
