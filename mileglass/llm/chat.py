"""Chat formatting: conversations logged as growing snapshots are collapsed, then rendered.

Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turn numbers per part: the window in which turns are ranked, and what one rendered row holds at most.
PART = 256
#: Marks around a turn; the same marks inside a text are broken up, so a text cannot forge a turn.
START, END, BROKEN = "<|im_start|>", "<|im_end|>", "<| im_"


def _content_hash(salt: int, role: Column, text: Column) -> Column:
    parts = [F.lit(salt), role.isNull(), F.coalesce(role, F.lit("")), text.isNull(), F.coalesce(text, F.lit(""))]
    return F.xxhash64(*parts)


def _turns(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns of conversations that have an id, with two hashes of their content and their part."""
    t = conversations.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
                             F.col(text).alias("text")).filter(F.col("conv_id").isNotNull())
    return (t.withColumn("a", _content_hash(1, F.col("role"), F.col("text")))
            .withColumn("b", _content_hash(2, F.col("role"), F.col("text")))
            .withColumn("part", F.coalesce(F.floor(F.col("turn") / PART), F.lit(-1)).cast("long")))


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, place, n, x, y): a 128-bit hash of the first ``place`` turns of each conversation of ``n`` turns.

    The hash is rolled over places: each turn adds (by exclusive or) a hash of its place and content, so a prefix
    hash is the sum of the parts before it and of the turns before it in its part.  A conversation is thus ranked
    part by part; only one row per part meets in its window, even if it has a third of all rows.
    """
    light = turns.select("conv_id", "part", "turn", "a", "b").distinct()
    order = Window.partitionBy("conv_id").orderBy("part")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sizes = (light.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
             .withColumn("done", F.coalesce(F.sum("size").over(before), F.lit(0)))
             .withColumn("n", F.sum("size").over(Window.partitionBy("conv_id")))
             .drop("size"))
    within = Window.partitionBy("conv_id", "part").orderBy("turn", "a", "b")
    placed = (light.join(sizes, ["conv_id", "part"])
              .withColumn("place", F.col("done") + F.row_number().over(within))
              .withColumn("x", F.xxhash64(F.col("place"), F.col("a")))
              .withColumn("y", F.xxhash64(F.lit(3), F.col("place"), F.col("b"))))
    sums = (placed.groupBy("conv_id", "part").agg(F.bit_xor("x").alias("px"), F.bit_xor("y").alias("py"))
            .withColumn("bx", F.coalesce(F.bit_xor("px").over(before), F.lit(0)))
            .withColumn("by", F.coalesce(F.bit_xor("py").over(before), F.lit(0))).drop("px", "py"))
    rolled = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (placed.join(sums, ["conv_id", "part"])
            .select("conv_id", "place", "n",
                    F.col("bx").bitwiseXOR(F.bit_xor("x").over(rolled)).alias("x"),
                    F.col("by").bitwiseXOR(F.bit_xor("y").over(rolled)).alias("y")))


def maximal_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                          text: str = "text") -> DataFrame:
    """(conv_id, n_turns, n_logged) of the conversations that are no proper prefix of another one.

    Of conversations with the same turns the smallest id stays, and ``n_logged`` counts them.  A conversation whose
    whole hash is the hash of a proper prefix of a longer one is removed by an anti-join; prefixes are made distinct
    first, so one very common first turn is one row per task.
    """
    hashes = prefix_hashes(_turns(conversations, conv_id, turn, role, text))
    whole = (hashes.filter(F.col("place") == F.col("n")).groupBy("n", "x", "y")
             .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged")))
    proper = hashes.filter(F.col("place") < F.col("n")).select(F.col("place").alias("n"), "x", "y").distinct()
    return whole.join(proper, ["n", "x", "y"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_logged")


def render_turn(role: Column, text: Column) -> Column:
    """One turn between marks; a NULL role is ``unknown``, a NULL text empty."""
    safe = [F.replace(F.coalesce(c, F.lit(d)), F.lit("<|im_"), F.lit(BROKEN)) for c, d in ((role, "unknown"), (text, ""))]
    return F.concat(F.lit(START), safe[0], F.lit("\n"), safe[1], F.lit(END + "\n"))


def format_chats(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """(conv_id, part, n_turns, n_logged, chat): maximal conversations as training text.

    Turns are ordered by number, NULL first; turns with the same number by a hash of their content.  The same turn
    logged twice in a conversation (same number, role and text) is one turn.  A conversation is one row, or one row
    for each ``PART`` turn numbers, to be read in order of ``part``; ``n_turns`` counts the whole conversation.
    Rows without a conversation id belong to no conversation.  Other columns are ignored.
    """
    kept = maximal_conversations(conversations, conv_id, turn, role, text)
    turns = _turns(conversations, conv_id, turn, role, text).distinct()
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "a", "b", "role", "text"))),
                        lambda t: render_turn(t["role"], t["text"]))
    return (turns.join(kept, "conv_id").groupBy("conv_id", "part", "n_turns", "n_logged")
            .agg(F.array_join(lines, "").alias("chat")))
