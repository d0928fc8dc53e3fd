"""Writers of corpora, splits, reports and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telar.operators.bitext import directions, records


def write_bitext(pairs: DataFrame, path: str, mode: str = "overwrite", tagged: bool = False) -> None:
    """Both directions of every pair as JSON lines, by language pair: pair=kek_en, pair=kek_es."""
    directed = directions(pairs)
    other = F.when(F.col("src_lang") == "kek_Latn", F.col("tgt_lang")).otherwise(F.col("src_lang"))
    name = F.concat(F.lit("kek_"), F.when(other == "eng_Latn", "en").when(other == "spa_Latn", "es").otherwise(other))
    if tagged:
        fields = [F.col("src_lang").alias("src_lang_code"), F.col("tgt_lang").alias("tgt_lang_code"), "src_text", "tgt_text", *[F.coalesce(c, F.lit("")).alias(c) for c in ("pos_kek", "semantic_kek")]]
        out = directed.select(F.struct(*fields).alias("translation"), name.alias("pair"))
    else:
        out = directed.select("*", name.alias("pair")).select(F.struct(F.col("src_lang").alias("src_lang_code"), F.col("tgt_lang").alias("tgt_lang_code"), "src_text", "tgt_text", F.lit("synthetic").alias("type")).alias("translation"), "pair")
    out.write.mode(mode).partitionBy("pair").json(path)


def write_dump(triples: DataFrame, path: str) -> None:
    """One line of text for each triple."""
    triples.select(F.format_string("[%s] KEK: %s | ES: %s | EN: %s", F.col("id").cast("string"), "kek", "es", "en")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    """CSV with one header for each file; append adds files, and a reader takes the header of each away."""
    df.write.mode(mode).option("header", True).csv(path)


def write_split(df: DataFrame, path: str, mini: int = 1000, order: str = "line") -> None:
    """train, val and val_mini, the first rows of val in order."""
    for side in ("train", "val"):
        records(df.filter(F.col("side") == side)).write.mode("overwrite").json(f"{path}/{side}")
    records(df.filter("side = 'val'").orderBy(order).limit(mini)).write.mode("overwrite").json(f"{path}/val_mini")


def flush_predictions(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Prediction rows (Prompt, Target, Prediction, Match) of each micro-batch as CSV in a folder of its own, which a rerun replaces."""
    def flush(batch: DataFrame, number: int) -> None:
        batch.select("Prompt", "Target", "Prediction", "Match").write.mode("overwrite").option("header", True).csv(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append_log(rows: DataFrame, path: str, order: str, parameters: dict[str, object]) -> None:
    """Rows of a training log as lines in order; before the first, the parameters as comments and the columns' names; total_* columns go."""
    kept = [c for c in rows.columns if not c.startswith("total_")]
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/head")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        head = [f"# {k}: {v}" for k, v in parameters.items()] + ["# " + ",".join(kept)]
        spark.createDataFrame([(x,) for x in head], "value string").coalesce(1).write.text(f"{path}/head")
    line = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in kept])
    rows.orderBy(order).select(line.alias("value")).write.mode("append").text(f"{path}/rows")


def write_metrics(df: DataFrame, path: str) -> None:
    """Rows of a metrics summary, numbers with four decimals."""
    out = df.select(*[F.format_string("%.4f", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
    write_csv(out, path)
