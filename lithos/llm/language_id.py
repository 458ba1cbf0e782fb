"""Language identification by cross-parsing.

A suffix automaton of each language's sample answers which strings occur in it. A text is parsed greedily into phrases,
each the longest match at its place; the language that needs the fewest phrases, normalised by the logarithm of its
sample's length (the cross-parsing estimate of entropy), wins. Whole texts are parsed, in segments of a fixed length
that run through the automata side by side, so that numpy steps many segments at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import by_batches, for_python, held, quoted

UNDETERMINED = "und"
#: The classifier is fitted on at most this many documents a language, a window of so many characters from each.
SAMPLE_DOCS, SAMPLE_WINDOW, SAMPLE_CHARS = 200, 1024, 32_768
MOST_LANGUAGES = 1000
#: Characters parsed at a stretch; of that many segments at once.
SEGMENT, LANES = 256, 8_192
#: Parts into which a language's rows are dealt before its lowest are taken; places of an automaton for each transition, and
#: rounds in which they must come to rest.
DEALT, PLACES, ROUNDS = 256, 2, 100


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton that accepts every substring of `symbols`; state 0 is the start."""
    following: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p != -1:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return following


class Automaton:
    """A suffix automaton in flat arrays: the transition of state s on class c stands at one of two places that the pair
    (s, c) is hashed to (cuckoo hashing), so that a step looks twice, and the arrays grow with the number of transitions and
    not with the alphabet or with how wide a state is."""

    def __init__(self, following: list[dict[int, int]], width: int):
        n = len(following)
        # class 0 matches nothing
        rows = [(s, c, to) for s, x in enumerate(following) for c, to in x.items() if c]
        state, code, to = np.array(rows, dtype=np.int64).reshape(-1, 3).T
        self.width = np.uint64(width)
        keys, bits, place = state.astype(np.uint64) * self.width + code.astype(np.uint64), max(4, (PLACES * len(rows)).bit_length()), None
        r = np.random.default_rng(n)
        while place is None:
            self.hashes, self.shift = r.integers(1 << 62, 1 << 63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.uint64(64 - bits)
            place = self.placed(keys, bits)
            bits += 1
        self.key, self.to = np.full(len(place), np.iinfo(np.uint64).max), np.zeros(len(place), dtype=np.int32)
        full = place >= 0
        self.key[full], self.to[full] = keys[place[full]], to[place[full]]
        #: Where a phrase stands after its first character; state n, without transitions, for one that occurs nowhere.
        self.start = n
        self.first = np.full(width, n, dtype=np.int32)
        self.first[code[state == 0]] = to[state == 0]

    def placed(self, keys: np.ndarray, bits: int) -> np.ndarray | None:
        """Which key stands at each place. Keys are put at their first place all at once; those that were pushed out go to
        their other place, and so on. None if they don't come to rest in ROUNDS; then more places and other hashes are tried."""
        at = np.stack([(keys * h) >> self.shift for h in self.hashes]).astype(np.int64)
        place = np.full(1 << bits, -1, dtype=np.int64)
        choice, moving = np.zeros(len(keys), dtype=np.int64), np.arange(len(keys))
        for _ in range(ROUNDS):
            to = at[choice[moving], moving]
            out = place[to]
            place[to] = moving
            pushed = np.unique(np.concatenate([moving, out[out >= 0]]))
            moving = pushed[place[at[choice[pushed], pushed]] != pushed]
            if not len(moving):
                return place
            choice[moving] ^= 1
        return None

    def step(self, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one more character each, and whether a phrase begins with it."""
        key = state.astype(np.uint64) * self.width + code.astype(np.uint64)
        one, two = (((key * h) >> self.shift).astype(np.int64) for h in self.hashes)
        at_one, at_two = self.key.take(one) == key, self.key.take(two) == key
        to = np.where(at_one, self.to.take(one), np.where(at_two, self.to.take(two), self.first.take(code)))
        return to, ~(at_one | at_two)


class Model:
    """The languages' automata over classes of characters.

    Class 0 stands for letters that no sample has and for the seams between sampled windows: nothing matches it. Class 1
    stands for all that isn't a letter.
    """

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        folded = {k: [x.lower() for x in v] for k, v in samples.items()}
        letters = sorted({c for v in folded.values() for x in v for c in x if unicodedata.category(c)[0] == "L"})
        self.classes = np.zeros(0x110000, dtype=np.int32)
        self.classes[: 0x110000] = [0 if unicodedata.category(chr(c))[0] == "L" else 1 for c in range(0x110000)]
        self.classes[[ord(c) for c in letters]] = np.arange(2, len(letters) + 2)
        self.automata, self.cost = [], []
        for language in self.languages:
            symbols = [s for x in folded[language] for s in [*self.codes(x).tolist(), 0]]
            self.automata.append(Automaton(suffix_automaton(symbols), len(letters) + 2))
            self.cost.append(np.log2(max(2, len(symbols))))

    def codes(self, text: str) -> np.ndarray:
        return self.classes[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]

    def phrases(self, texts: list[str]) -> np.ndarray:
        """Phrases that each text (row) takes in each language (column)."""
        parts = [self.codes(x.lower()) for x in texts]
        sizes = np.array([len(x) for x in parts], dtype=np.int64)
        flat = np.concatenate([*parts, np.zeros(SEGMENT, dtype=np.int32)])
        n_segments = (sizes + SEGMENT - 1) // SEGMENT
        of = np.repeat(np.arange(len(texts)), n_segments)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n_segments) - n_segments, n_segments)
        begins = np.repeat(np.cumsum(sizes) - sizes, n_segments) + nth * SEGMENT
        lengths = np.minimum(SEGMENT, np.repeat(sizes, n_segments) - nth * SEGMENT)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for lo in range(0, len(order), LANES):
            lanes = order[lo : lo + LANES]
            active = np.searchsorted(-lengths[lanes], -np.arange(SEGMENT), side="left")
            grid = flat[begins[lanes][None, :] + np.arange(SEGMENT)[:, None]]
            for k, automaton in enumerate(self.automata):
                state = np.full(len(lanes), automaton.start, dtype=np.int32)
                count = np.zeros(len(lanes), dtype=np.int32)
                for row, n in zip(grid, active):
                    if not n:
                        break
                    state[:n], fresh = automaton.step(state[:n], row[:n])
                    count[:n] += fresh
                out[:, k] += np.bincount(of[lanes], weights=count, minlength=len(texts)).astype(np.int64)
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: the share by which the runner-up's normalised phrases exceed the winner's.
        Ties go to the first language by code point, with score 0."""
        if not texts:
            return [], []
        need = self.phrases(texts) * np.array(self.cost) / np.maximum(1, [len(x) for x in texts])[:, None]
        best = need.argmin(axis=1)
        if len(self.languages) == 1:
            return [self.languages[0]] * len(texts), [1.0] * len(texts)
        two = np.partition(need, 1, axis=1)
        score = np.where(two[:, 1] > 0, (two[:, 1] - two[:, 0]) / np.maximum(two[:, 1], 1e-300), 0.0)
        return [self.languages[i] for i in best], np.clip(score, 0, 1).tolist()


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text leaves 1 when divided by 3. A null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def lowest(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first `n` rows of each lang, with their rank."""
    for keys in (["lang", F.pmod(F.xxhash64(*order), F.lit(DEALT))], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
    return rows


def language_samples(labelled: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", docs: int = SAMPLE_DOCS, window: int = SAMPLE_WINDOW, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Bounded samples: of each language the `docs` documents whose ids hash lowest, a seeded window from each, `chars`
    characters in all. Ids are ranked before any text is read; the second ranking bounds repeated ids. Both rank within DEALT
    parts of a language first, so that no task sees more than these parts' lowest."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    place = F.xxhash64(F.lit(5), "id")
    chosen = lowest(rows.select("id", "lang"), [place, F.col("id")], docs)
    texts = rows.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).join(F.broadcast(chosen.select("id", "lang").distinct()), ["id", "lang"], "left_semi")
    begin = F.pmod(F.xxhash64(F.lit(6), "id"), F.greatest(F.lit(1), F.length("text") - window)) + 1
    cut = texts.select("lang", place.alias("place"), F.col("text").substr(begin.cast("int"), F.lit(window)).alias("part"))
    bounded = lowest(cut, [F.col("place"), F.col("part")], docs)
    samples: dict[str, list[str]] = {}
    for row in bounded.limit(MOST_LANGUAGES * docs + 1).toLocalIterator():
        samples.setdefault(row.lang, []).append((row.rank, row.part))
    if len(samples) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out = {}
    for language, parts in samples.items():
        left, out[language] = chars, []
        for _, part in sorted(parts):
            out[language].append(part[:left])
            left -= len(part)
            if left <= 0:
                break
    return out


def lettered(text: Column) -> Column:
    """Whether a text has a letter; a null one has none."""
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, samples: dict[str, list[str]], text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """`docs` with two more columns, `pred_col` and `score_col`, in place of columns of these names.

    `und` with score 0 for a null or empty text, one without a letter, and every text where there are no samples.
    """
    spark = docs.sparkSession
    for_python(spark)
    carried = [c for c in docs.columns if c not in (pred_col, score_col)]
    shared = spark.sparkContext.broadcast(Model(samples) if samples else None)

    def run(texts, lettered):
        held("language", object)
        model, texts = shared.value, texts.to_pylist()
        at = [i for i, ok in enumerate(lettered.to_pylist()) if ok and model]
        said, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        begin = chars = 0
        for k, i in enumerate(at, 1):
            chars += len(texts[i])
            if chars >= SEGMENT * LANES or k == len(at):
                for j, x, s in zip(at[begin:k], *model.predict([texts[j] for j in at[begin:k]])):
                    said[j], scores[j] = x, s
                begin, chars = k, 0
        return [pa.array(said, pa.string()), pa.array(scores, pa.float64())]

    text, fields = F.col(quoted(text_col)), [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    return by_batches(docs, carried, [text, lettered(text)], fields, run)


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of `docs` (doc_id, text, lang), learnt from the rows that are not
    held out and have a language. Repeated rows are predicted one by one; an empty table gives an empty result; further
    columns are not read."""
    samples = language_samples(docs.where(~held_out(F.col("doc_id"))))
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, samples).select("doc_id", "held_out", "lang_pred", "score")
