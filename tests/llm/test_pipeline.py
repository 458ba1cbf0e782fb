"""Each stage of the pipeline held against what it says, on a small corpus with planted copies."""

import random

import corpus_pipeline as C
from lithos.llm.mixing import mix
from lithos.scratch import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(3)
    words = [w + e for w in "the river mountain and house tree walking singing over under small great old new".split() for e in ("", "s", "ly", "er")]
    texts = [" ".join(r.choice(words) for _ in range(60)) for _ in range(40)]
    near = [" ".join([*t.split(" ")[:-1], "changed"]) for t in texts[:5]]
    every = [*texts, *texts[:5], *near, "", "123 456", None]
    return [(i, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(every)]


def test_stages(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark, "test")
    stage = dict(C.STAGES)
    kept = scratch.save(stage["language_id"](spark, docs, None))
    assert {r.doc_id for r in kept.collect()} == {i for i, t, *_ in rows if t and any(c.isalpha() for c in t)}
    once = scratch.save(stage["exact_dedup"](spark, kept, None))
    by_text = {}
    for r in kept.collect():
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert {r.doc_id for r in once.collect()} == set(by_text.values())
    apart = scratch.save(stage["near_dedup"](spark, once, None))
    left = {r.doc_id for r in apart.collect()}
    assert len(left) == 40 and all((40 + k in left) != (45 + k in left) for k in range(5))
    mixed = scratch.save(stage["mix_to_weights"](spark, apart, None))
    taken = {r.doc_id: r.taken // r.size for r in mix(apart).collect()}
    times = {}
    for r in mixed.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {k: v for k, v in taken.items() if v}
    assert docs.columns == kept.columns == once.columns == apart.columns == mixed.columns
    encoded = stage["bpe_encode"](spark, mixed, None)
    assert encoded.count() == mixed.count() and encoded.where("n_tokens <> size(ids) OR n_tokens = 0").count() == 0


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, f in C.STAGES:
        docs = f(spark, docs, None)
    assert docs.collect() == []


def test_language_without_labels(spark):
    rows = [(i, t, None, "s", 0) for i, (t, *_) in enumerate([("one text",), ("été",), ("123",), ("",), (None,)])]
    kept = C.keep_language(spark, spark.createDataFrame(rows, SCHEMA), None)
    assert {r.doc_id for r in kept.collect()} == {0, 1}
    unlettered = spark.createDataFrame([(1, "123", "en", "s", 3), (None, "abc", "en", "s", 3), (3, "abc", None, "s", 3)], SCHEMA)
    assert C.keep_language(spark, unlettered, None).count() == 2


def test_null_and_repeated_ids(spark):
    r = random.Random(5)
    one, two, three, four = (" ".join(r.choice("abcdefghijklmnop") * r.randint(1, 6) for _ in range(80)) for _ in range(4))
    close = lambda t: t.rsplit(" ", 1)[0] + " changed"
    make = lambda rows: spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], SCHEMA)
    exact = make([(None, one, "a"), (None, two, "a"), (5, two, "a"), (7, three, "a"), (7, two, "a"), (8, three, "a"), (9, four, "a"), (9, four, "b")])
    assert sorted(((x.doc_id, x.text) for x in C.drop_copies(spark, exact, None).collect()), key=repr) == sorted([(None, one), (7, two), (8, three), (9, four)], key=repr)
    near = make([(None, one, "a"), (None, close(one), "a"), (None, two, "a"), (3, close(two), "a"), (4, three, "a"), (4, close(three), "a"), (4, four, "a"), (6, close(four), "b")])
    kept = [(x.doc_id, x.text) for x in C.drop_near_copies(spark, near, None).collect()]
    assert len(kept) == 4 and (3, close(two)) in kept and (4, four) in kept and sum(i is None for i, _ in kept) == 1 and sum(i == 4 for i, _ in kept) == 2
    texts = [" ".join(["w"] * n) for n in range(1, 40)]
    mixed = make([(n % 3 or None, t, "abc"[n % 2]) for n, t in enumerate(texts)])
    wanted = {(x.doc_id, x.size, x.pattern[0]): x.taken // x.size for x in mix(mixed).collect()}
    found = {}
    for x in C.mix_sources(spark, mixed, None).collect():
        k = x.doc_id, len(x.text.split()), x.source
        found[k] = found.get(k, 0) + 1
    assert found == {k: n for k, n in wanted.items() if n}


def test_clashing_columns(spark):
    extra = ", size int, taken string, score int, lang_pred string, pattern string, kept boolean, component_id string, keep_id string, ids string, n_tokens string, __x int"
    row = (7, "x", 7, "x", "x", None, "x", "x", "x", "x", 7)
    docs = spark.createDataFrame([(i, f"text number {w} in words", "en", "s", 0, *row) for i, w in enumerate("one two three".split())], SCHEMA + extra)
    for _, f in C.STAGES[:-1]:
        docs = Scratch(spark, "test").save(f(spark, docs, None))
        assert {tuple(r)[5:] for r in docs.collect()} == {row}
    assert C.encode(spark, docs, None).count() == docs.count()
