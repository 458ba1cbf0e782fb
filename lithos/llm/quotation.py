"""Chat formatting by quotation linking, with DataFrame functions only.

The lines of a message have a quote level, the number of `>` at their begin. The text of each level is normalised and cut
into passages, sentence by sentence, so that a quote that was wrapped anew or cut short still has the passages of the
original. Passages are hashed; a quoted one is joined to the first message of its conversation that says it itself. A
message replies to the message that it quotes at the shallowest level, the latest if there are several; roots are found
by doubling the steps up. Messages get a position in their conversation, by root and turn, so that replies follow what they
reply to, without quotes; `reply_blocks` packs them into texts of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lithos.llm.common import Scratch
from lithos.operators.order import prefix

BLANK = r"[\t\n\x0B\f\r ]"
#: A line's quote marks; a line that announces a quote; a passage of normalised text.
MARKS, ANNOUNCES, PASSAGE = r"^[\t ]*((?:>[\t ]*)*)", r"^(?:on|le|am|el) .* (?:wrote|écrit|schrieb|escribió)[\t ]*:$", r"[^.!?]+[.!?]*"


def lines_of(text: Column) -> Column:
    """Lines of a text as structs (level, content)."""
    marks = lambda x: F.regexp_extract(x, MARKS, 1)
    level = lambda x: F.length(F.regexp_replace(marks(x), "[^>]", ""))
    return F.transform(F.split(text, "\r\n|\n|\r"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("content")))


def passages(text: Column) -> Column:
    """Distinct hashes of the passages of a text, white space folded and lower-cased."""
    plain = F.lower(F.regexp_replace(text, f"{BLANK}+", " "))
    parts = F.transform(F.regexp_extract_all(plain, F.lit(PASSAGE), F.lit(0)), lambda x: F.trim(x))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.sha2(x, 256)))


def without_quotes(lines: Column) -> Column:
    """The message's own lines, without those that announce a quote right below."""
    def own(x, i):
        below = F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
        return (x["level"] == 0) & ~((below > 0) & F.lower(x["content"]).rlike(ANNOUNCES))

    return F.trim(F.array_join(F.transform(F.filter(lines, own), lambda x: x["content"]), "\n"), F.lit(" \t\r\n"))


def link_quotations(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text, n_quoted, n_linked, parent_turn, root_turn, depth, position of each row of `messages`.

    text is the message without quotes; n_quoted the number of its distinct quoted passages and levels, n_linked that of
    those found in earlier messages; parent_turn the message that it replies to (null if it quotes none), root_turn the
    first of its thread, depth the number of replies between; position counts the conversation's turns from 1 in reply order, by
    root and turn. A null text counts as empty. Rows of one conversation and
    turn are one place in it: they share the parent that any of them quotes. Null conversations are one conversation;
    a row with a null turn quotes and is quoted by nobody, its root_turn and position are null and its depth 0. Repeated rows come out
    as often as they go in. An empty table gives an empty result; other columns are not read.
    """
    scratch = Scratch(messages.sparkSession, "quotes")
    rows = messages.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("raw"))
    lined = rows.withColumn("lines", lines_of(F.col("raw"))).withColumn("text", without_quotes(F.col("lines")))
    deep = F.array_sort(F.array_distinct(F.filter(F.transform("lines", lambda x: x["level"]), lambda x: x > 0)))
    text_at = lambda n: F.array_join(F.transform(F.filter("lines", lambda x: x["level"] == n), lambda x: x["content"]), " ")
    quoted = F.flatten(F.transform(deep, lambda n: F.transform(passages(text_at(n)), lambda h: F.struct(n.alias("level"), h.alias("hash")))))
    read = scratch.save(lined.select("conv_id", "turn", "role", "text", F.sha2("raw", 256).alias("row"), passages(F.col("text")).alias("own"), quoted.alias("quoted")))
    # nulls take part in joins as a key of their own
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    placed = read.where("turn IS NOT NULL")
    said = placed.select(conv, F.col("conv_id").isNull().alias("none"), "turn", F.explode("own").alias("hash"))
    first = scratch.save(said.groupBy("conv", "none", "hash").agg(F.min("turn").alias("first")))
    quotes = placed.where(F.size("quoted") > 0).select(conv, F.col("conv_id").isNull().alias("none"), "turn", "row", F.explode("quoted").alias("q"))
    quotes = scratch.save(quotes.select("conv", "none", "turn", "row", "q.level", "q.hash").distinct())
    found = quotes.join(first, ["conv", "none", "hash"]).where("first < turn")
    links = scratch.save(found.groupBy("conv", "none", "turn", "row").agg(F.count(F.lit(1)).alias("n_linked"), F.max(F.struct(-F.col("level"), "first")).alias("best")))
    parents = links.groupBy("conv", "none", "turn").agg(F.max("best").alias("best"))
    up = scratch.save(parents.select("conv", "none", "turn", F.col("best.first").alias("parent"), F.col("best.first").alias("root"), F.lit(1).alias("depth")))
    while True:
        above = up.select("conv", "none", F.col("turn").alias("root"), F.col("root").alias("further"), F.col("depth").alias("more"))
        step = up.join(above, ["conv", "none", "root"], "left")
        after = scratch.save(step.select("conv", "none", "turn", "parent", F.coalesce("further", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved")))
        moved = not after.where("moved").isEmpty()
        up = after.drop("moved")
        if not moved:
            break
    key = ["conv", "none", "turn"]
    places = placed.select(conv, F.col("conv_id").isNull().alias("none"), "turn").distinct().join(up, key, "left").withColumn("root", F.coalesce("root", "turn"))
    ordered = scratch.save(prefix(places, ["root", "turn"], by=["conv", "none"], out="position"))
    keyed = read.withColumn("conv", conv).withColumn("none", F.col("conv_id").isNull())
    counts = links.select(*key, "row", "n_linked")
    out = keyed.join(counts, [*key, "row"], "left").join(ordered, key, "left")
    return out.select(
        "conv_id", "turn", "role", "text", F.size("quoted").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.col("parent").alias("parent_turn"), F.col("root").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("position").cast("long").alias("position"),
    )


def reply_blocks(linked: DataFrame, most: int = 64) -> DataFrame:
    """conv_id, block, n_messages, text: what link_quotations() gives, packed in reply order into texts of `most` messages at
    most, a line `role: text` each. A long conversation goes on in the next block, so that none is ever in one place whole.

    Messages without a position come last in their conversation; a null role or text is empty; ties go by role and text.
    Null conversations are one; an empty table gives an empty result.
    """
    rows = linked.select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = prefix(rows, [F.col("position").asc_nulls_last(), "role", "text"], by=["conv_id"], out="n")
    said = F.transform(F.array_sort(F.collect_list(F.struct("n", "role", "text"))), lambda x: F.concat_ws(": ", x["role"], x["text"]))
    return placed.groupBy("conv_id", F.floor((F.col("n") - 1) / most).alias("block")).agg(F.count(F.lit(1)).alias("n_messages"), F.array_join(said, "\n").alias("text"))


def with_planted_quotes(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of `messages` with quotes planted, for tables whose messages quote nothing. A turn that leaves
    1 by 4 quotes the first line of the turn before; one that leaves 2 announces and quotes all of it, wrapped anew behind
    commas; one that leaves 3 quotes all of it and, at the second level, the turn before that. Where a turn has several rows,
    the least text is quoted. A message whose own text or quoted turn is null stays as it is."""
    conv = lambda: (F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").isNull().alias("none"))
    rows = messages.select("conv_id", "turn", "role", "text", *conv())
    base = messages.where("turn IS NOT NULL").groupBy(*conv(), "turn").agg(F.min("text").alias("said"))
    before = lambda k, name: base.select("conv", "none", (F.col("turn") + k).alias("turn"), F.col("said").alias(name)).where(F.pmod("turn", F.lit(4)) >= k)
    both = rows.join(before(1, "one"), ["conv", "none", "turn"], "left").join(before(2, "two").where("pmod(turn, 4) = 3"), ["conv", "none", "turn"], "left")
    left, br = F.pmod("turn", F.lit(4)), F.lit("\n")
    marked = lambda text, mark: F.concat(F.lit(mark), F.replace(text, br, F.lit("\n" + mark)))
    one = F.col("one")
    first = F.concat(F.lit("> "), F.split_part(one, br, F.lit(1)))
    wrapped = F.concat(F.lit("On the turn before, the other one wrote:\n> "), F.replace(F.replace(one, br, F.lit(" ")), F.lit(", "), F.lit(",\n> ")))
    nested = F.concat_ws("\n", marked(F.col("two"), ">> "), marked(one, "> "))
    quote = F.when(left == 1, first).when(left == 2, wrapped).when(left == 3, F.when(F.col("two").isNotNull() & one.isNotNull(), nested))
    return both.select("conv_id", "turn", "role", F.coalesce(F.concat(quote, br, F.col("text")), F.col("text")).alias("text"))
