"""Parallel records: sides, directions, prompts, and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAMES = {"kek_Latn": "Q'eqchi'", "eng_Latn": "English", "spa_Latn": "Spanish"}


def language_name(code: Column, names: dict[str, str] | None = None) -> Column:
    """Display name of a language code; an unknown code stands for itself."""
    table = F.create_map(*[F.lit(x) for kv in (names or NAMES).items() for x in kv])
    return F.coalesce(F.try_element_at(table, code), code)


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, src_text, tgt_text, src_lang, tgt_lang): a user's turn with the assistant's directly after it."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return rows.filter((F.col("role") == "user") & (F.col("_role") == "assistant")).select(
        "conv_id", "turn", F.col("text").alias("src_text"), F.col("_text").alias("tgt_text"), F.lit("kek_Latn").alias("src_lang"),
        F.when(F.col("conv_id") % 2 == 0, "eng_Latn").otherwise("spa_Latn").alias("tgt_lang"))


def pivot_side(pivot: str = "kek_Latn") -> Column:
    """The text in the pivot language: the target if it is, else the source if it is, else NULL."""
    return F.when(F.col("tgt_lang") == pivot, F.col("tgt_text")).when(F.col("src_lang") == pivot, F.col("src_text"))


def both_present(a: str = "src_text", b: str = "tgt_text") -> Column:
    return (F.length(F.coalesce(F.col(a), F.lit(""))) > 0) & (F.length(F.coalesce(F.col(b), F.lit(""))) > 0)


def directions(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Each pair with both texts as two records, there and back; extra columns ride on both."""
    one = [F.col(c) for c in pairs.columns if c not in ("src_text", "tgt_text", "src_lang", "tgt_lang") and (extra is None or c in extra)]
    there = F.struct(F.lit(0).alias("direction"), *[F.col(c).alias(c) for c in ("src_lang", "tgt_lang", "src_text", "tgt_text")])
    back = F.struct(F.lit(1).alias("direction"), F.col("tgt_lang").alias("src_lang"), F.col("src_lang").alias("tgt_lang"), F.col("tgt_text").alias("src_text"), F.col("src_text").alias("tgt_text"))
    return pairs.filter(both_present()).withColumn("_d", F.explode(F.array(there, back))).select(*one, "_d.*")


def records(directed: DataFrame, kind: str = "synthetic") -> DataFrame:
    """The nested record of each direction."""
    return directed.select(F.struct(F.col("src_lang").alias("src_lang_code"), F.col("tgt_lang").alias("tgt_lang_code"), "src_text", "tgt_text", F.lit(kind).alias("type")).alias("translation"))


def prompt(kind: str | None = "synthetic") -> Column:
    """'translate kind Source to Target: text', without a kind where it is None."""
    lead = "translate " + (f"{kind} " if kind else "")
    return F.concat(F.lit(lead), language_name(F.col("src_lang")), F.lit(" to "), language_name(F.col("tgt_lang")), F.lit(": "), F.col("src_text"))


def direction_label(text: Column) -> Column:
    """Which of the four directions a prompt names, by its words."""
    low = F.lower(text)
    out = F.lit(None).cast("string")
    for a, b in (("spanish", "q'eqchi'"), ("q'eqchi'", "spanish"), ("english", "q'eqchi'"), ("q'eqchi'", "english")):
        out = F.when(low.contains(f"{a} to {b}"), f"{a}->{b}").otherwise(out)
    return out


def multitask(directed: DataFrame, pivot: str = "kek_Latn", weights: tuple[float, float, float] = (1.0, 0.4, 0.8)) -> DataFrame:
    """(…, task, input_text, target_text, task_weight): translation of every record, and tags of those from the pivot that have them."""
    tagged = (F.col("src_lang") == pivot) & (F.length(F.coalesce("pos_kek", F.lit(""))) > 0) & (F.length(F.coalesce("semantic_kek", F.lit(""))) > 0)

    def task(name: str, lead: Column, target: str, w: float) -> Column:
        return F.struct(F.lit(name).alias("task"), F.concat(lead, F.col("src_text")).alias("input_text"), F.col(target).alias("target_text"), F.lit(w).alias("task_weight"))

    base = F.concat(F.lit("translate "), language_name(F.col("src_lang")), F.lit(" to "), language_name(F.col("tgt_lang")), F.lit(": "))
    all_ = F.array(task("translation", base, "tgt_text", weights[0]), F.when(tagged, task("pos", F.lit("tag pos: "), "pos_kek", weights[1])), F.when(tagged, task("semantic", F.lit("tag semantic: "), "semantic_kek", weights[2])))
    keep = [c for c in directed.columns if c not in ("src_text", "tgt_text", "src_lang", "tgt_lang", "pos_kek", "semantic_kek")]
    return directed.withColumn("_t", F.explode(F.array_compact(all_))).select(*keep, "_t.*")


def first_per_direction(df: DataFrame, text: str, order: str) -> DataFrame:
    """The first row of each direction that prompts name."""
    labelled = df.withColumn("direction_label", direction_label(F.col(text))).filter("direction_label is not null")
    return labelled.withColumn("_r", F.row_number().over(Window.partitionBy("direction_label").orderBy(order))).filter("_r = 1").drop("_r")
