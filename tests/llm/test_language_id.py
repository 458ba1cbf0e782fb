import random
import zlib

import numpy as np

import lithos.llm.language_id as L
from lithos.llm.language_id import Model, identify, language_id, language_samples

SF = "/root/testdata/sf0.01"


def test_phrases_against_a_greedy_parse():
    samples = {"x": ["abcabcaab"], "y": ["ccba", "abab"]}
    model = Model(samples)
    for text in ("abcab", "ccc", "b", "zzab", "a1b", "abababccba"):
        for k, language in enumerate(model.languages):
            def code(t):
                return model.codes(t.lower()).tolist()

            source = [c for part in samples[language] for c in [*code(part), 0]]
            inside = {tuple(source[i:j]) for i in range(len(source)) for j in range(i + 1, len(source) + 1) if 0 not in source[i:j]}
            n, now = 0, ()
            for c in code(text):
                if now and now + (c,) in inside:
                    now += (c,)
                else:
                    n, now = n + 1, (c,)
            assert model.phrases([text])[0][k] == n, (text, language)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language_id(docs).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(0, "hello there my friend", "en", 1), (1, "bonjour mon ami", "fr", 1), (3, None, "en", 1), (5, "", None, 1), (6, "123 !", "en", 1), (None, "hello friend", None, 1), (7, "bonjour" * 3000, None, 1)]
    found = {(r.doc_id, r.lang_pred) for r in language_id(spark.createDataFrame(rows * 2, schema)).collect()}
    assert {(3, "und"), (5, "und"), (6, "und"), (None, "en"), (7, "fr")} <= found
    assert language_id(spark.createDataFrame([], schema)).collect() == []
    docs = spark.createDataFrame(rows, schema)
    assert {r.lang_pred for r in identify(docs, {}).collect()} == {"und"}
    assert set(language_samples(docs)) == {"en", "fr"}


def longest_matches(text, sample):
    """Phrases of the greedy parse, by search; letters that the sample doesn't have match nothing."""
    n = i = 0
    while i < len(text):
        k = 1
        while i + k < len(text) and text[i : i + k + 1] in sample:
            k += 1
        n, i = n + 1, i + k
    return n


def test_phrases_against_search():
    r = random.Random(4)
    for alphabet in ("abc ", "".join(map(chr, range(0x4E00, 0x4E00 + 400)))):
        samples = {k: ["".join(r.choice(alphabet) for _ in range(600))] for k in "xyz"}
        model = L.Model(samples)
        texts = ["".join(r.choice(alphabet + "q") for _ in range(r.randint(1, L.SEGMENT))) for _ in range(60)]
        found = model.phrases(texts)
        for t, row in zip(texts, found):
            assert row.tolist() == [longest_matches(t, samples[k][0]) for k in "xyz"]


def test_wide_alphabets_need_little_memory():
    """Samples with 20,000 letters beside ten languages with few: arrays grow with transitions, not with letters."""
    r = random.Random(5)
    wide = [chr(0x4E00 + i) for i in range(20_000)]
    samples = {"wide": ["".join(r.sample(wide, 20_000)), "".join(r.choice(wide) for _ in range(12_000))]}
    samples |= {f"l{k}": ["".join(r.choice("etaoin shrdlu") for _ in range(2000))] for k in range(10)}
    model = L.Model(samples)
    assert sum(x.nbytes for a in model.automata for x in (a.key, a.to, a.first)) < 50e6
    assert model.predict([samples["wide"][0][:300], samples["l3"][0][100:900]])[0] == ["wide", "l3"]


def zipf(r, letters, n):
    """A text of letters by Zipf's law, as a sample of a script with many of them."""
    weights = [1 / k for k in range(1, letters + 1)]
    return "".join(chr(0x4E00 + k) for k in r.choices(range(letters), weights, k=n))


def test_scripts_with_many_letters_are_built_soon():
    import time

    r = random.Random(6)
    for letters in (60, 1000, 3000, 20_000):
        text = zipf(r, letters, L.SAMPLE_CHARS)
        following = L.suffix_automaton([ord(c) - 0x4E00 + 1 for c in text])
        start = time.time()
        automaton = L.Automaton(following, letters + 1)
        assert time.time() - start < 5
        assert automaton.key.nbytes + automaton.to.nbytes + automaton.first.nbytes < 50e6
        for s in r.sample(range(len(following)), 500):
            for c in {*following[s], r.randrange(1, letters)}:
                to, fresh = automaton.step(np.array([s], np.int32), np.array([c], np.int32))
                assert (fresh[0], to[0]) == ((False, following[s][c]) if c in following[s] else (True, automaton.first[c]))


def test_held_out_accuracy_on_other_scripts(spark):
    """Generated languages over CJK, Cyrillic and Greek letters, two of each script, that differ in their words."""
    r, rows = random.Random(7), []
    scripts = {"han": (0x4E00, 2500, 1, 2), "cyrillic": (0x430, 32, 2, 8), "greek": (0x3B1, 24, 2, 8)}
    for name, (begin, n, least, most) in scripts.items():
        for k in range(2):
            words = ["".join(chr(begin + r.randrange(n)) for _ in range(r.randint(least, most))) for _ in range(800)]
            weights = [1 / i for i in range(1, 801)]
            rows += [(0, ("" if name == "han" else " ").join(r.choices(words, weights, k=80)), f"{name}{k}") for _ in range(60)]
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    found = language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    held = [x for x in found if x.held_out]
    assert len(held) > 60 and sum(x.lang_pred == rows[x.doc_id][2] for x in held) >= 0.95 * len(held)


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "hello there", "en", 2, 3)], "doc_id long, text string, lang string, `__text` int, `__letters.x` int")
    row = identify(df, {"en": ["hello there"], "fr": ["bonjour"]}).first()
    assert tuple(row) == (1, "hello there", "en", 2, 3, "en", row.score)
