"""Corpus analytics: distributions, audits, groups, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telar.functions.text import bigrams, corpus_tokens, pair_key, strip


def distribution(lines: DataFrame, text: str, pairs: bool = False, top: int = 40) -> DataFrame:
    """(rank, token, n, percent): the most frequent words, or pairs of neighbours, per hundred lines; ties by token.

    Counts are added up by partial aggregation, and only the top goes on to be ranked.
    """
    tokens = corpus_tokens(F.col(text))
    counted = lines.select(F.explode(bigrams(tokens) if pairs else tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    best = counted.orderBy(F.desc("n"), "token").limit(top)
    total = lines.agg(F.count("*").alias("_lines"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "token")).cast("long"))
    return ranked.crossJoin(F.broadcast(total)).select("rank", "token", "n", F.round(F.col("n") * 100 / F.col("_lines"), 6).alias("percent"))


def audit(df: DataFrame, source: Column, target: Column, limit: int = 128, lead: int = 8) -> DataFrame:
    """Length statistics of max(source + lead, target): count, mean, max, percentiles with interpolation, share over the limit."""
    n = F.greatest(source + lead, target)
    return df.select(n.alias("n")).agg(
        F.count("*").alias("records"), F.round(F.avg("n"), 4).alias("mean"), F.max("n").alias("longest"), F.floor(F.percentile("n", F.lit(0.95))).cast("long").alias("p95"),
        F.floor(F.percentile("n", F.lit(0.99))).cast("long").alias("p99"), F.count_if(F.col("n") > limit).alias("over"), F.round(F.count_if(F.col("n") > limit) / F.count("*"), 6).alias("over_share"))


def balance(df: DataFrame, group: Column) -> DataFrame:
    """Records and share of each group."""
    counted = df.groupBy(group.alias("language")).agg(F.count("*").alias("n"))
    return counted.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 6))


def concept_groups(directed: DataFrame) -> DataFrame:
    """(key_a, key_b, records): records of one concept, whichever their direction."""
    a, b = pair_key(F.col("src_text"), F.col("tgt_text"))
    return directed.groupBy(a.alias("key_a"), b.alias("key_b")).agg(F.count("*").alias("records"))


def dedup(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row in order of each distinct key: an aggregate, so copies are reduced before the shuffle."""
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in keys]), F.col(order)).alias("_row"))
    return first.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def not_in_history(df: DataFrame, history: DataFrame, key: str) -> DataFrame:
    return df.join(history.select(F.col(key)).distinct(), key, "left_anti")


def new_by_batch(df: DataFrame, batch: str, key: str) -> DataFrame:
    """Rows whose key no earlier batch has; rows of one batch may share it."""
    first = df.groupBy(key).agg(F.min(batch).alias("_first"))
    return df.join(first, key).filter(F.col(batch) == F.col("_first")).drop("_first")


def rejection(df: DataFrame, batch: str, key: str) -> DataFrame:
    """(batch, raw, final, rate, seen): what each batch brings, keeps, loses, and the distinct keys so far."""
    kept = new_by_batch(df, batch, key).groupBy(batch).agg(F.count("*").alias("final"), F.countDistinct(key).alias("_new"))
    both = df.groupBy(batch).agg(F.count("*").alias("raw")).join(kept, batch, "left").fillna(0, ["final", "_new"])
    return both.select(F.col(batch).alias("batch"), "raw", "final", F.round((F.col("raw") - F.col("final")) / F.col("raw"), 6).alias("rate"),
                       F.sum("_new").over(Window.partitionBy(F.lit(0)).orderBy(batch).rowsBetween(Window.unboundedPreceding, 0)).alias("seen"))


def zipf(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, zipf): log10 of a word's occurrences per thousand million tokens of its language."""
    words = df.select(F.col(lang).alias("lang"), F.explode(corpus_tokens(F.col(text))).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    total = words.groupBy("lang").agg(F.sum("n").alias("_total"))
    return words.join(total, "lang").select("lang", "word", F.round(F.log10(F.col("n") * 1e9 / F.col("_total")), 6).alias("zipf"))


def content_words(gloss: Column, stopwords: tuple[str, ...]) -> Column:
    """The words of a text that are not stop words."""
    return F.array_except(F.filter(F.split(F.lower(gloss), r"\s+"), lambda w: w != ""), F.array(*map(F.lit, stopwords)))


def smart_frequency(glosses: DataFrame, gloss: str, frequencies: DataFrame, stopwords: list[str], unknown: float = 1.5, all_stop: float = 5.0) -> DataFrame:
    """glosses with zipf: the largest frequency of a gloss's content words, up to its first bracket or slash.

    A blank gloss has 0; one of stopwords alone has all_stop; a word without a frequency has `unknown`.
    """
    cut = F.lower(strip(F.split(F.split(F.coalesce(F.col(gloss), F.lit("")), r"\(")[0], "/")[0]))
    words = F.filter(F.split(cut, r"\s+"), lambda w: (w != "") & ~w.isin(*stopwords))
    keyed = glosses.select(F.col(gloss)).distinct().withColumn("_cut", cut).withColumn("_words", words)
    found = keyed.withColumn("word", F.explode("_words")).join(frequencies.select("word", "zipf"), "word", "left")
    best = found.groupBy(gloss).agg(F.max(F.when(F.coalesce("zipf", F.lit(0.0)) > 0, F.col("zipf")).otherwise(unknown)).alias("_z"))
    value = F.when(F.col("_cut") == "", 0.0).when(F.size("_words") == 0, all_stop).otherwise(F.col("_z"))
    scored = keyed.withColumnRenamed(gloss, "_g").join(best.withColumnRenamed(gloss, "_b"), F.col("_g").eqNullSafe(F.col("_b")), "left").select("_g", value.alias("zipf"))
    return glosses.join(scored, F.col(gloss).eqNullSafe(F.col("_g"))).drop("_g")


def weights(df: DataFrame, en: str, es: str, temperature: float = 1.5) -> DataFrame:
    """df with p_weight = 10 ^ (max(en, es) / temperature) and its percent of the total."""
    w = df.withColumn("p_weight", F.pow(F.lit(10.0), F.greatest(en, es) / temperature))
    return w.withColumn("p_debug_percent", F.col("p_weight") / F.sum("p_weight").over(Window.partitionBy(F.lit(0))) * 100)


def validated(rows: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Rows whose key a validator returned."""
    return rows.join(valid.select(key).distinct(), key, "left_semi")
