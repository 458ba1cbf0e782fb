import random
import re

import duckdb
import pytest

from lithos.llm.queries import ORACLES
from lithos.llm.quotation import link_quotations, reply_blocks, with_planted_quotes

SCHEMA = "conv_id long, turn long, role string, text string"
ROWS = [
    (1, 0, "user", "The first point is this. And here\nis a second one!"),
    (1, 1, "assistant", "On Monday someone wrote:\n> The first point is\n> this. And\n\nI agree with that."),
    (1, 2, "user", ">> The first point is this.\n> I agree with that.\r\nSo do I."),
    (1, 3, "user", "> so do I.\nThanks."),
    (1, 4, "user", "> Nobody said this.\nThanks."),
    (1, 4, "user", "> I AGREE   with that.\nThanks."),
    (2, 0, "user", None),
    (2, 1, "user", ""),
    (2, 2, "user", "> I agree with that.\n>\n>"),
    (None, 0, "user", "Say it."),
    (None, 1, None, ">say it.\nit"),
    (3, None, "user", "> Say it."),
    (3, None, "user", "> Say it."),
]


def by_oracle(rows):
    c = duckdb.connect()
    c.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        c.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cursor = c.execute(ORACLES["op1_quotation_linking"])
    return sorted(cursor.fetchall(), key=repr)


def ours(spark, rows):
    return link_quotations(spark.createDataFrame(rows, SCHEMA))


def planted(rows):
    """The rows with planted quotes, line by line."""
    said = {}
    for c, t, _, x in rows:
        if t is not None:
            said[c, t] = min((y for y in (said.get((c, t)), x) if y is not None), default=None)
    out = []
    for c, t, r, x in rows:
        one, two, quote = (None, None, None) if t is None else (said.get((c, t - 1)), said.get((c, t - 2)), None)
        if x is not None and t is not None and one is not None:
            if t % 4 == 1:
                quote = ["> " + one.split("\n")[0]]
            elif t % 4 == 2:
                quote = ["On the turn before, the other one wrote:", "> " + one.replace("\n", " ").replace(", ", ",\n> ")]
            elif t % 4 == 3 and two is not None:
                quote = [f"{m} {y}" for m, z in ((">>", two), (">", one)) for y in z.split("\n")]
        out.append((c, t, r, "\n".join([*quote, x]) if quote else x))
    return out


def brute(rows):
    """What link_quotations() gives, message by message and passage by passage."""
    def split(text):
        text = re.sub(r"[\t\n\x0B\f\r ]+", " ", text).lower()
        return {p for p in (x.strip(" ") for x in re.findall(r"[^.!?]+[.!?]*", text)) if p}

    read = []
    for c, t, r, x in rows:
        lines = []
        for line in re.split("\r\n|\n|\r", x or ""):
            marks = re.match(r"[\t ]*((?:>[\t ]*)*)", line)
            lines.append((marks[1].count(">"), line[marks.end() :]))
        below = [level for level, _ in lines[1:]] + [0]
        own = [y for (level, y), b in zip(lines, below) if not level and not (b and re.search(r"^(?:on|le|am|el) .* (?:wrote|écrit|schrieb|escribió)[\t ]*:$", y.lower()))]
        own = "\n".join(own).strip(" \t\r\n")
        quoted = {(level, p) for level in {k for k, _ in lines if k} for p in split(" ".join(y for k, y in lines if k == level))}
        read.append((c, t, r, own, quoted))
    first = {}
    for c, t, _, own, _ in read:
        for p in split(own) if t is not None else ():
            first[c, p] = min(first.get((c, p), t), t)
    linked, parent = [], {}
    for c, t, _, _, quoted in read:
        found = [(-level, first[c, p]) for level, p in quoted if t is not None and first.get((c, p), t) < t]
        linked.append(len(found))
        if found:
            parent[c, t] = max(max(found), parent.get((c, t), (-99, 0)))
    def root(c, t):
        return root(c, parent[c, t][1]) if (c, t) in parent else t

    def depth(c, t):
        return 1 + depth(c, parent[c, t][1]) if (c, t) in parent else 0

    places = sorted({(str(c), root(c, t), t) for c, t, *_ in read if t is not None})
    out = []
    for (c, t, r, own, quoted), n in zip(read, linked):
        at = None if t is None else 1 + [x for x in places if x[0] == str(c)].index((str(c), root(c, t), t))
        out.append((c, t, r, own, len(quoted), n, parent.get((c, t), (0, None))[1], root(c, t), depth(c, t), at))
    return sorted(out, key=repr)


def random_rows(seed):
    r = random.Random(seed)
    words = ["one", "two", "Three,", "four, five", "six"]
    sentence = lambda: " ".join(r.choice(words) for _ in range(r.randint(1, 3))) + r.choice(".!?")
    text = lambda: r.choice([" ", "\n"]).join(sentence() for _ in range(r.randint(0, 4)))
    rows = [(r.choice([1, 2, None]), r.randint(0, 9), r.choice(["user", None]), text()) for _ in range(60)]
    return rows + [(3, None, "user", "> " + text()), (3, 1, "user", None), *rows[:3]]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(spark, seed):
    rows = random_rows(seed)
    df = with_planted_quotes(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(planted(rows), key=repr)
    assert sorted(map(tuple, link_quotations(df).collect()), key=repr) == brute(planted(rows)) == by_oracle(rows)


def test_blocks(spark):
    rows = [(7, t, "user", (f"> Word number {t - 1}.\n" if t else "") + f"Word number {t}.") for t in range(10)] + [(None, None, None, None)]
    found = reply_blocks(ours(spark, rows), most=4).collect()
    assert sorted((r.block, r.n_messages) for r in found if r.conv_id == 7) == [(0, 4), (1, 4), (2, 2)]
    assert next(r.text for r in found if r.block == 2) == "user: Word number 8.\nuser: Word number 9."
    assert [(r.n_messages, r.text) for r in found if r.conv_id is None] == [(1, ": ")]


def test_matches_the_oracle(spark):
    assert sorted(map(tuple, ours(spark, planted(ROWS)).collect()), key=repr) == by_oracle(ROWS) == brute(planted(ROWS))


def test_links(spark):
    at = {(r.conv_id, r.turn): r for r in ours(spark, ROWS[:5]).collect()}
    assert [at[1, t].parent_turn for t in range(5)] == [None, 0, 1, 2, None]
    assert [at[1, t].depth for t in range(5)] == [0, 1, 2, 3, 0]
    assert at[1, 1].text == "I agree with that." and at[1, 2].text == "So do I."
    assert at[1, 3].root_turn == 0 and at[1, 1].n_linked == 1 and at[1, 1].n_quoted == 2


@pytest.mark.parametrize("length", [40])
def test_chain_and_order(spark, length):
    rows = [(7, t, "user", (f"> Word number {t - 1}.\n" if t else "") + f"Word number {t}.") for t in range(length)]
    found = ours(spark, rows).orderBy("position").collect()
    assert [r.position for r in found] == list(range(1, length + 1))
    assert [r.turn for r in found] == list(range(length)) and [r.depth for r in found] == list(range(length))


def test_empty_and_clashing_columns(spark):
    assert ours(spark, []).collect() == []
    clash = spark.createDataFrame([(1, 0, "user", "a. b.", 5, "x", 3)], SCHEMA + ", level int, hash string, root long")
    assert link_quotations(clash).count() == 1


def test_no_python_in_the_plan(spark):
    plan = ours(spark, ROWS)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
