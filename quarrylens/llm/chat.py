"""Chat formatting: logged conversations that are a prefix of longer ones collapse into them before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|", "|>\n", "<|end|>\n")


def _halves(x: Column) -> list[Column]:
    """Two independent 64-bit hashes of a string, from its SHA-256."""
    digest = F.sha2(x, 256)
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("long") for at in (1, 17)]


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that no other one continues; see chat_format."""
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where("conv_id is not null")
    content = F.to_json(F.struct("role", "text"))  # tells null from empty, and where the role ends
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    placed = turns.select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("at"), content.alias("content"))
    a, b = _halves(F.concat_ws("\n", F.col("at").cast("string"), "content"))
    # The hash of a prefix is the xor of its turns' hashes, each salted with its place: a running window that keeps no rows.
    rolling = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = placed.select("conv_id", "at", a.alias("a"), b.alias("b")).select("conv_id", "at", F.bit_xor("a").over(rolling).alias("pa"), F.bit_xor("b").over(rolling).alias("pb"))
    last = Window.partitionBy("conv_id").orderBy("at")
    prefixes = prefixes.withColumn("more", F.lead("at").over(last).isNotNull())
    whole = prefixes.where(~F.col("more")).groupBy("at", "pa", "pb").agg(F.min("conv_id").alias("conv_id"))
    proper = prefixes.where("more").groupBy("at", "pa", "pb").agg(F.lit(1).alias("one"))
    kept = whole.join(proper, ["at", "pa", "pb"], "left_anti")
    return kept.select("conv_id", F.col("at").cast("long").alias("n_turns"))


def chat_format(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, rendered: the maximal conversations of turns (conv_id, turn, role, text), rendered.

    Turns are ordered by turn (null first), then role and text, so that repeated and tied turns have one order. A
    conversation that equals the first turns of a longer one goes; of equal ones the smallest conv_id stays. Two turns
    are equal if role and text are, null and empty being different. A turn is rendered as template[0] + role +
    template[1] + text + template[2], null as empty. Turns with a null conv_id belong to no conversation and are left
    out. Only DataFrame functions are used; hashes have 120 bits.
    """
    kept = maximal_conversations(turns)
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    empty = F.lit("")
    one = F.concat(F.lit(template[0]), F.coalesce("role", empty), F.lit(template[1]), F.coalesce("text", empty), F.lit(template[2]))
    mine = turns.join(kept, "conv_id").select("conv_id", "n_turns", F.struct("turn", "role", "text", one.alias("shown")).alias("t"))
    whole = mine.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.array_sort(F.collect_list("t")).alias("t"))
    return whole.select("conv_id", "n_turns", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("rendered"))
