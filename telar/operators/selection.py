"""Picks and filters of lexicon rows and training samples, and the persons of sentences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telar.functions.text import blank, split_set, strip
from telar.operators.constraints import NOT_OWNED, possessability
from telar.operators.sampling import hashed

PERSONS = ("1sg", "2sg", "3sg", "1pl", "2pl", "3pl")


def same_text(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose column reads like value."""
    return df.filter(F.col(column).cast("string") == str(value))


def future_adverbs(adverbs: DataFrame) -> DataFrame:
    """Adverbs whose tenses name the future."""
    return adverbs.filter(F.array_contains(split_set(F.col("tense_compat")), "fut"))


def comparable(adjectives: DataFrame) -> DataFrame:
    """Adjectives that may be compared: not of colour or shape."""
    return adjectives.filter(~F.lower(strip(blank(F.col("adj_type")))).isin("color", "shape"))


def possessable(nouns: DataFrame) -> DataFrame:
    """Nouns that can be owned, and those that must be."""
    return nouns.filter(possessability(F.lower(strip(blank(F.col("class")))), NOT_OWNED).isin("optional", "obligatory"))


def not_human(nouns: DataFrame) -> DataFrame:
    """Nouns that may be what is owned: nobody."""
    return nouns.filter(~F.lower(blank(F.col("is_human"))).isin("1", "true", "yes"))


def name_rows(names: DataFrame) -> DataFrame:
    """Rows like those of nouns, for names (name, gender)."""
    gender = F.lower(F.coalesce(F.col("gender"), F.lit("m")))
    text = [F.col("name").alias(c) for c in ("lemma_kek", "gloss_en", "gloss_es")]
    return names.select(F.concat(F.lit("name::"), F.col("name")).alias("id"), *text, F.lit("human").alias("class"), F.lit("1").alias("is_human"),
                        F.lit("optional").alias("possessability"), gender.alias("gender_es"), F.lit("0").alias("has_color"))


def coin(seed: str, sides: tuple[str, str], *by: Column) -> Column:
    """One of two sides, by hash."""
    return F.when(hashed(seed, *by) % 2 == 0, sides[0]).otherwise(sides[1])


def shared_gender(seed: str, named: Column, *by: Column) -> Column:
    """m or f: the gender that is known, or a coin that all languages of a sentence share."""
    known = F.lower(strip(blank(named)))
    return F.when(known.isin("m", "f"), known).otherwise(coin(seed, ("m", "f"), *by))


def subject_person(subject: Column) -> Column:
    """The person that a subject's label begins with, as in '3pl - Noun'; NULL without one."""
    found = F.regexp_extract(F.lower(strip(blank(subject))), r"^(1sg|2sg|3sg|1pl|2pl|3pl)\b", 1)
    return F.when(found != "", found)


def inferred_person(default: Column, plural_slot: Column) -> Column:
    """A valid default or 3sg; a slot of a plural subject makes it plural."""
    p = F.lower(strip(blank(default)))
    p = F.when(p.isin(*PERSONS), p).otherwise("3sg")
    return F.when(plural_slot, F.regexp_replace(p, "sg$", "pl")).otherwise(p)


def sentence_person(subject: Column, mood: Column, default: Column, plural_slot: Column) -> Column:
    """The person a template's verbs agree with: its subject's, in an imperative otherwise the second, else the default."""
    own, order = subject_person(subject), F.upper(strip(blank(mood))).startswith("IMP")
    second = F.when(plural_slot | F.lower(strip(blank(default))).endswith("pl"), "2pl").otherwise("2sg")
    return inferred_person(F.when(order & own.isNull(), second).otherwise(F.coalesce(own, default)), plural_slot)


def unseen_samples(df: DataFrame, seen: DataFrame, text: str, task: str, order: list[str], n: int) -> DataFrame:
    """The first n rows in order of each task, each text once over all tasks, none that `seen` has."""
    first = df.join(seen.select(text).distinct(), text, "left_anti")
    first = first.withColumn("_copy", F.row_number().over(Window.partitionBy(text).orderBy(*order))).filter("_copy = 1").drop("_copy")
    return first.withColumn("_turn", F.row_number().over(Window.partitionBy(task).orderBy(*order))).filter(F.col("_turn") <= n).drop("_turn")


def aligned(left: DataFrame, right: DataFrame, row: str) -> DataFrame:
    """Rows of two tables side by side by their row number; what one side lacks is left out."""
    return left.join(right, row)


def truncated(ids: Column, limit: int = 128) -> Column:
    return F.slice(ids, 1, limit)


def padded(ids: Column, length: Column, pad: int) -> Column:
    """ids filled up to a length on the right."""
    return F.concat(ids, F.array_repeat(F.lit(pad).cast("int"), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def label_mask(ids: Column, pad: int, ignored: int = -100) -> Column:
    """Labels for a loss: padding is ignored."""
    return F.transform(ids, lambda x: F.when(x == pad, ignored).otherwise(x))


def encoded(df: DataFrame, source: str, target: str, tokenize: Callable[[Column], Column], pad: int, limit: int = 128, weight: str | None = None) -> DataFrame:
    """df with input_ids, labels and task_weight: both sides tokenised and cut to `limit`, padding masked, weights 1 by default.

    tokenize gives the column of a text's ids, arrays of integers; an external tokenizer fits in as a Pandas UDF.
    """
    return df.withColumns({
        "input_ids": truncated(tokenize(F.coalesce(F.col(source), F.lit(""))), limit), "labels": label_mask(truncated(tokenize(F.coalesce(F.col(target), F.lit(""))), limit), pad),
        "task_weight": F.coalesce(F.col(weight).cast("double"), F.lit(1.0)) if weight else F.lit(1.0)})


def rounded_metrics(df: DataFrame) -> DataFrame:
    """Doubles with four decimals, learning rates with six."""
    return df.select(*[F.round(c, 6 if c == "learning_rate" else 4).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
