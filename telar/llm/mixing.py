"""Mixing of sources to target weights by Poisson replication."""

from __future__ import annotations

from math import log, pi

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from telar.llm._common import materialize, named, sent

#: Characters of an output partition, where the session's number of partitions makes larger ones.
PARTITION = 128 << 20


def _uniform(seed: str, *cols: str) -> F.Column:
    """A number of [0, 1) with 48 bits, the same for the same values on every engine that has md5."""
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / float(1 << 48)


def _log_factorial(k: F.Column) -> F.Column:
    """Stirling's series, to double precision from 64 on."""
    return k * F.log(k) - k + F.log(k) / 2 + log(2 * pi) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)


def poisson_mix(docs: DataFrame, weights: DataFrame | None = None, alpha: float = 0.5, seed: str = "mix", copy: str = "copy", key: str = "mix_key") -> DataFrame:
    """Replicate documents so that the sources' shares of the text become their target weights.

    The target share of a source is its weight in `weights` (source, weight), where given, or its present share of
    the characters to the power alpha; shares are normalised over the sources present. The mean repetition rate of a
    document is rate = target share * characters of all sources / characters of its source, so the mixture keeps its
    size in expectation. Its number of copies inverts the Poisson distribution of that mean at a uniform number
    hashed from the seed and doc_id. Returns the columns of docs, with copy (from 0) and mix_key, by which rows are
    shuffled globally: keys are uniform, so their ranges are the output partitions, in order and sorted, without sampling.

    A source absent from `weights` has weight 0: its documents go. A null source is a source of its own. Null and
    empty texts count no character and are repeated like the rest of their source; a source without any character
    has rate 1. Texts of any length only count their characters. Rows with the same doc_id, or a null one, have the same
    number of copies within a source. An empty table gives an empty result. Columns of docs named like `copy` or `key` are
    replaced; all others stay, whatever their names.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c.lower() not in (copy.lower(), key.lower())]
    mass = materialize(docs.groupBy(F.col("source").alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).alias("mass")))
    total = mass.agg(F.sum("mass")).first()[0] or 0
    if weights is None:
        weighed = mass.withColumn("weight", F.pow(F.col("mass").cast("double") / F.lit(total or 1), F.lit(alpha)))
    else:
        given = weights.groupBy(F.col("source").alias("given")).agg(F.sum("weight").alias("weight"))
        weighed = mass.join(given, F.col("source").eqNullSafe(F.col("given")), "left").drop("given").fillna(0.0, ["weight"])
    every = weighed.filter("mass > 0").agg(F.sum(F.col("weight").cast("double"))).first()[0]
    share = F.col("weight") / F.lit(every)
    rated = weighed.select("source", F.when(F.col("mass") > 0, share * F.lit(total) / F.col("mass")).otherwise(1.0).alias("rate"))
    # cumulative probabilities of lowest, lowest + 1, ... copies, as far on both sides as the rest is below 2^-48; by logarithms, which don't underflow
    low = F.floor(F.col("rate") - 12 * F.sqrt("rate") - 20).cast("int")
    low = F.when(low < 64, 0).otherwise(low)
    high = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    by_k = Window.partitionBy("source").orderBy("k")
    terms = rated.filter("rate > 0").withColumn("low", low).withColumn("k", F.explode(F.sequence("low", high)))
    step = F.when((F.col("k") == F.col("low")) & (F.col("low") > 0), _log_factorial(F.col("low").cast("double"))).otherwise(F.log(F.greatest("k", F.lit(1)).cast("double")))
    terms = terms.withColumn("lf", F.sum(step).over(by_k))
    terms = terms.withColumn("cdf", F.sum(F.exp(F.col("k") * F.log("rate") - F.col("rate") - F.col("lf"))).over(by_k))
    tables = materialize(terms.groupBy(F.col("source").alias("_source")).agg(F.min("low").alias("low"), F.array_sort(F.collect_list("cdf")).alias("steps")))
    # every column of a document but these two travels in one, so that no name clashes
    rows = docs.select(F.struct(*[named(c).alias(c) for c in kept]).alias("row"), F.col("source").alias("source"), F.col("doc_id").alias("doc_id")).withColumn("u", _uniform(seed, "doc_id"))
    joined = rows.join(sent(tables, F.size("steps") * 8 + 64), F.col("source").eqNullSafe(F.col("_source")))
    n = F.col("low") + F.size(F.filter("steps", lambda c: c <= F.col("u")))
    out = joined.select("row", "doc_id", n.alias("n")).filter("n > 0").select("row", "doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy"))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION))
    out = out.withColumn("key", _uniform(seed + "-order", "doc_id", "copy"))
    out = out.repartitionById(parts, F.least(F.floor(F.col("key") * parts).cast("int"), F.lit(parts - 1))).sortWithinPartitions("key", "doc_id")
    return out.select("row.*", F.col("copy").alias(copy), F.col("key").alias(key))


POISSON_SQL = """
WITH mass AS (SELECT source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS mass FROM documents GROUP BY source),
weighed AS (SELECT source, mass, pow(CAST(mass AS DOUBLE) / sum(mass) OVER (), 0.5) AS weight FROM mass),
rated AS (SELECT source, CASE WHEN mass > 0 THEN weight / sum(CASE WHEN mass > 0 THEN weight END) OVER () * (sum(mass) OVER ()) / mass ELSE 1.0 END AS rate FROM weighed),
ks AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS BIGINT) + 1)) AS k FROM rated WHERE rate > 0),
lf AS (SELECT *, sum(ln(greatest(k, 1))) OVER (PARTITION BY source ORDER BY k) AS lf FROM ks),
cdf AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k) AS cdf FROM lf),
u AS (SELECT *, CAST(('0x' || substr(md5('mix|' || doc_id), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM documents),
n AS (SELECT u.doc_id, count(*) AS n FROM u JOIN cdf ON u.source IS NOT DISTINCT FROM cdf.source AND cdf.cdf <= u.u GROUP BY u.doc_id),
copies AS (SELECT d.*, CAST(unnest(range(0, n.n)) AS INTEGER) AS copy FROM documents d JOIN n ON d.doc_id = n.doc_id)
SELECT doc_id, text, lang, source, n_chars, copy, CAST(('0x' || substr(md5('mix-order|' || doc_id || '|' || copy), 1, 12)) AS BIGINT) / 281474976710656.0 AS mix_key FROM copies
"""
