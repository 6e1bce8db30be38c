"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation again and again, each time with more turns. Every turn gets a rolling hash of all turns
up to it: the exclusive or of hashes of each turn with its place. A conversation whose last hash is a hash inside a
longer one is its prefix; an anti-join drops it. Of conversations with the same turns the one with the smallest id
stays. What is left is rendered.

Turns meet their conversation in a window that spills, without texts; hashes of distinct prefixes are counted before
they meet, so that a first turn that all conversations share is one row. Texts are gathered only for conversations
that stay; a conversation is the unit of output.

Nulls and edge cases: turns in order of `turn` (null first), then role, then the MD5 of the text; a null role or text
counts as empty. A turn without conv_id is a conversation of its own, id null, that counts as the largest id. Repeated
rows are turns of their own. A very long text is rendered whole. An empty table gives no rows. Other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the public ChatML form.
START, END = "<|im_start|>", "<|im_end|>"


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and said (the text's hash, that orders turns of one number and role)."""
    filled = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")]
    return turns.select("conv_id", "turn", *filled).withColumn("said", F.md5("text"))


def _ranked(turns: DataFrame) -> DataFrame:
    """conv_id, pos, the rolling hashes and whether the turn is the last, for each turn of _plain()."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "said")
    some = turns.filter("conv_id IS NOT NULL").select("conv_id", "turn", "role", "said", F.row_number().over(w).alias("pos"), F.lead(F.lit(True)).over(w).isNull().alias("last"))
    lone = turns.filter("conv_id IS NULL").select("conv_id", "turn", "role", "said", F.lit(1).alias("pos"), F.lit(True).alias("last"))
    hashes = [F.xxhash64("pos", "role", "said").alias("a"), F.xxhash64("said", "role", "pos").alias("b")]
    rolling = [F.bit_xor(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in "ab"]
    some = some.select("*", *hashes).select("conv_id", "pos", "last", *rolling)
    return some.union(lone.select("conv_id", "pos", "last", *hashes))


def collapse(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same (conversations with just these turns) and a, b (the hash of all turns) of each maximal conversation."""
    held = _ranked(_plain(turns))
    inner = held.filter("NOT last").select("a", "b").distinct()
    smallest = F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id"))
    whole = held.filter("last").groupBy("a", "b").agg(smallest.alias("first"), F.first("pos").alias("n_turns"), F.count(F.lit(1)).alias("n_same"))
    return whole.join(inner, ["a", "b"], "left_anti").select(F.col("first.conv_id").alias("conv_id"), "n_turns", "n_same", "a", "b")


def _line(role, text):
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_same (conversations with just these turns) and the rendered text of each maximal conversation."""
    kept, plain = collapse(turns), _plain(turns)
    texts = plain.join(kept.filter("conv_id IS NOT NULL").select("conv_id"), "conv_id", "left_semi")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "said", "text"))), lambda t: _line(t["role"], t["text"]))
    texts = texts.groupBy("conv_id").agg(F.array_join(lines, "\n").alias("rendered"))
    named = kept.filter("conv_id IS NOT NULL").join(texts, "conv_id").select("conv_id", "n_turns", "n_same", "rendered")
    # Of turns without an id one of each kind stays, found by its hash.
    lone = plain.filter("conv_id IS NULL").select("role", "text", F.xxhash64(F.lit(1), "role", "said").alias("a"), F.xxhash64("said", "role", F.lit(1)).alias("b"))
    lone = lone.groupBy("a", "b").agg(F.first(_line(F.col("role"), F.col("text"))).alias("rendered"))
    return named.union(kept.filter("conv_id IS NULL").join(lone, ["a", "b"]).select("conv_id", "n_turns", "n_same", "rendered"))
