"""Chat formatting of reply trees, in DataFrame functions only.

Messages of a tree point at their parents. Iterative self-joins, each of which
doubles the distance, enumerate the paths from leaf to root; a tree's branches
are ranked by their mean score, and the best path is formatted as one
conversation. The template marks turns; control strings inside texts are
escaped by a backslash after their first character (one more where there are
some already), which is undone exactly.

Cases: a null text or role counts as empty; turns with the same number follow
one another by role and text; a repeated row is a turn of its own; among equal
scores the longer path wins, then the smaller leaf; messages whose parent is
missing are roots, and so is each message of a circle of parents; of several
rows of one node that with the smallest parent, role, text and score counts; an
empty table gives no rows; further columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Kept

#: The template's control strings.
BEGIN, END = "<s>[INST]", "[/INST]</s>"
_CONTROL = r"(?=/?s>|/?INST\])"
TRAINED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*+)" + _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*+)" + _CONTROL, r"$1$2")


def paths(messages: DataFrame, kept: Kept) -> DataFrame:
    """tree, leaf, node and dist (from the leaf) of all root-to-leaf paths of `messages` (tree, node, parent), a row a node."""
    nodes = messages.select("tree", "node")
    up = messages.where("parent is not null").select("tree", "node", F.col("parent").alias("to"))
    up = kept.write(up.join(nodes.select("tree", F.col("node").alias("to")), ["tree", "to"], "left_semi"))
    leaves = nodes.join(up.select("tree", F.col("to").alias("node")), ["tree", "node"], "left_anti")
    # what each round finds is written once
    found = [kept.write(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).alias("dist")))]
    step = 1
    longest = messages.groupBy("tree").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    while not up.isEmpty():
        if step > longest:
            # who has an ancestor so far up runs into a circle, and all ancestors that far up are in circles
            circles = kept.write(up.select("tree", F.col("to").alias("node"), F.lit(True).alias("round")).distinct())
            cut = messages.join(circles, ["tree", "node"], "left").withColumn("parent", F.when(F.col("round").isNull(), F.col("parent")))
            return paths(cut.drop("round"), kept)
        further = reduce(DataFrame.union, found).join(up, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("dist") + step).alias("dist"))
        found.append(kept.write(further))
        two = up.alias("a").join(up.alias("b"), (F.col("a.tree") == F.col("b.tree")) & (F.col("a.to") == F.col("b.node")))
        old, up = up, kept.write(two.select(F.col("a.tree").alias("tree"), F.col("a.node").alias("node"), F.col("b.to").alias("to")))
        kept.drop(old)
        step *= 2
    return reduce(DataFrame.union, found)


def format_trees(messages: DataFrame) -> DataFrame:
    """tree and `segments` (text, loss) of each tree's best branch; the segments' texts joined are the conversation, `loss` is the mask.

    `messages`: tree, node, parent, role, text, score.
    """
    kept = Kept(messages.sparkSession)
    said = F.min(F.struct("parent", "role", "text", "score")).alias("m")
    messages = kept.write(messages.groupBy("tree", "node").agg(said).select("tree", "node", "m.*"))
    # branches are ranked before texts travel
    found = paths(messages.select("tree", "node", "parent"), kept)
    along = found.join(messages.select("tree", "node", "score"), ["tree", "node"])
    ranked = along.groupBy("tree", "leaf").agg(F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"), F.count("*").alias("n"))
    best = ranked.groupBy("tree").agg(F.max(F.struct("mean", "n", (-F.col("leaf")).alias("minus"))).alias("b")).select("tree", (-F.col("b.minus")).alias("leaf"))
    turn = F.struct((-F.col("dist")).alias("at"), F.url_encode(F.coalesce("role", F.lit(""))).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), (F.coalesce("role", F.lit("")) == TRAINED).alias("loss"))
    chosen = found.join(best, ["tree", "leaf"]).select("tree", "node", "dist")
    turns = chosen.join(messages, ["tree", "node"]).groupBy("tree").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    no = F.lit(False).alias("loss")
    segments = F.flatten(F.transform("turns", lambda t: F.array(F.struct(F.concat(F.lit(BEGIN), t["role"], F.lit("\n")).alias("text"), no), F.struct(t["text"].alias("text"), t["loss"].alias("loss")), F.struct(F.lit(END).alias("text"), no))))
    return turns.select("tree", segments.alias("segments"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    pieces = F.filter(F.split(formatted, r"\[/INST\]</s>"), lambda p: p != "")
    inside = F.transform(pieces, lambda p: F.substr(p, F.lit(len(BEGIN) + 1)))
    return F.transform(inside, lambda p: F.struct(F.url_decode(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))


def from_turns(conversations: DataFrame) -> DataFrame:
    """Messages of conversations that are rows by turn: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("node"))
    return numbered.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("tree"), "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Each conversation's digests, read back from what the formatting returns."""
    out = format_trees(from_turns(conversations)).select("tree", "segments", F.array_join(F.col("segments.text"), "").alias("formatted"))
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    read = out.select("tree", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("turns"), F.array_join(masked, "").alias("loss"))
    return read.select(
        F.when(F.col("tree") != "", F.col("tree").cast("long")).alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )
