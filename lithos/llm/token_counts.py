"""Token counts by a count-only Viterbi.

An Aho-Corasick automaton enumerates the pieces of a unigram vocabulary that end at each character; dynamic programming
carries the best score and the number of pieces of the best way to get there, with the tie rules of the tokenizers
library's Unigram model: of equal scores the piece that begins first; a character that is no piece itself may be unknown,
10 below the least score; unknowns in a row are one token, or with byte fallback as many as they have bytes. No ids and no
paths are kept. The best way through a text is that through its units, runs of spaces with the word behind, as long as no
piece goes on from a word into a space, which the vocabulary is asked for; if one does, the text is one unit. A worker keeps
the counts of frequent units.
"""

from __future__ import annotations

import re
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithos.llm.common import by_batches, for_python, held, quoted

SPACE = "▁"
UNIT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Penalty of an unknown character below the least score of the vocabulary.
UNKNOWN = 10.0
#: Words in each of the two generations that a worker keeps, and the longest of them.
CACHE, CACHED_CHARS = 100_000, 64


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece model file, without its control, unknown and byte pieces. In a file of merges the
    scores are ranks and no probabilities: the best segmentation is then the one with the least sum of ranks."""
    model = read(path)
    ids = range(model.get_piece_size())
    return [(model.id_to_piece(i), model.get_score(i)) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def falls_back(path: str) -> bool:
    """Whether a sentencepiece model file has a piece for each byte."""
    model = read(path)
    return sum(model.is_byte(i) for i in range(model.get_piece_size())) == 256


def read(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


class Counter:
    """Counts the tokens of units of one vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.byte_fallback = byte_fallback
        self.apart = SPACE in self.single and not any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _ in pieces)
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.young: dict[str, tuple[int, float]] = {}
        self.old: dict[str, tuple[int, float]] = {}

    def word(self, word: str) -> tuple[int, float]:
        """Number of tokens and score of the best segmentation of one unit."""
        n = len(word)
        score: list = [None] * (n + 1)
        count, unknown = [0] * (n + 1), [False] * (n + 1)
        score[0] = 0.0
        matches = self.automaton.iter(word)
        end, (size, own) = next(matches, (n, (0, 0.0)))
        for e in range(1, n + 1):
            while end == e - 1:  # matches of one end come longest first, so by their begin
                s = e - size
                if score[e] is None or own + score[s] > score[e]:
                    score[e], count[e] = own + score[s], count[s] + 1
                end, (size, own) = next(matches, (n, (0, 0.0)))
            if word[e - 1] not in self.single and (score[e] is None or self.unknown + score[e - 1] > score[e]):
                more = len(word[e - 1].encode("utf-8", "replace")) if self.byte_fallback else not unknown[e - 1]
                score[e], count[e], unknown[e] = self.unknown + score[e - 1], count[e - 1] + more, True
        return count[n], score[n]

    def counts(self, texts: list[str]) -> list[tuple[int, float]]:
        """Number of tokens and score of each text."""
        parts = [units(t, self.apart) for t in texts]
        for w in set(chain.from_iterable(parts)) - self.young.keys():
            self.young[w] = self.old.get(w) or self.word(SPACE + w)
        out = []
        for p in parts:
            known = [self.young[w] for w in p]
            out.append((sum(n for n, _ in known), float(sum(s for _, s in known))))
        if len(self.young) > CACHE:
            self.old = {w: x for w, x in self.young.items() if len(w) <= CACHED_CHARS}
            self.young = {}
        return out


def units(text: str, apart: bool = True) -> list[str]:
    """The units of a text, each without the space that it begins with; a text that begins with none is given one."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    text = text[1:] if text[0] == " " else text
    if not apart:
        return [text.replace(" ", SPACE)]
    if "  " not in text and not text.startswith(" "):
        return text.split(" ")
    return [u[1:] for u in UNIT.findall(SPACE + text.replace(" ", SPACE))]


def counter_of(pieces: list[tuple[str, float]], byte_fallback: bool) -> Counter:
    """The counter of this vocabulary, built once in a process."""
    return held(("tokens", byte_fallback, hash(tuple(pieces))), lambda: Counter(pieces, byte_fallback))


def token_counts(docs: DataFrame, pieces: list[tuple[str, float]], text_col: str = "text", byte_fallback: bool = False, keep_text: bool = True) -> DataFrame:
    """`docs` with n_tokens (long) and score (double), in place of columns of these names: tokens of the whole text under
    a unigram vocabulary of (piece, score), and the sum of the best segmentation's scores.

    Spaces are U+2581, and a text that begins with none is given one. Pieces of several spaces match runs of spaces. With
    `byte_fallback` the vocabulary has a piece for each byte, and an unknown character as many tokens as it has bytes; else
    unknown characters in a row are one token. A null or empty text has 0 tokens and score 0. Rows may repeat; an empty
    table gives an empty result; all other columns are kept, whatever their names; without `keep_text` the text isn't.
    """
    spark = docs.sparkSession
    for_python(spark)
    shared = spark.sparkContext.broadcast(pieces)
    carried = [c for c in docs.columns if c not in ("n_tokens", "score") and (keep_text or c != text_col)]

    def run(texts):
        found = counter_of(shared.value, byte_fallback).counts([x or "" for x in texts.to_pylist()])
        return [pa.array([n for n, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())]

    own = [T.StructField("n_tokens", T.LongType()), T.StructField("score", T.DoubleType())]
    return by_batches(docs, carried, [F.col(quoted(text_col))], own, run)
