"""Readers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions.text import strip

VERBS = ", ".join(f"{c} string" for c in "lemma_kek gloss_kek gloss_en gloss_en_past gloss_en_pp en_infl gloss_es gloss_es_past_3sg gloss_es_pp gloss_es_gerund es_infl category transitivity agent_class_any_of agent_class_none_of theme_class_any_of theme_class_none_of goal_class_any_of goal_none_of notes".split()) + ", p_weight double, p_debug_percent double"
ADJECTIVES = "lemma_kek string, gloss_en string, comp_en string, gloss_es string, copula_es string, adj_type string, class_any_of string, class_none_of string, notes string, p_weight double, p_debug_percent double"
ADVERBS = "lemma_kek string, gloss_en string, gloss_es string, category string, class_any_of string, class_none_of string, tense_compat string, rel_days double, p_weight double, p_debug_percent double"
NUMERALS = "lemma_kek string, gloss_en string, gloss_es string, value int"
BITEXT = "translation struct<src_lang_code:string, tgt_lang_code:string, src_text:string, tgt_text:string, type:string, pos_kek:string, semantic_kek:string>"


def lexicon(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A lexicon CSV with a header; texts are trimmed, and class names of an older spelling renamed."""
    df = spark.read.schema(schema).option("header", True).option("encoding", "UTF-8").csv(path)
    texts = {c: strip(F.col(c)) for c, t in df.dtypes if t == "string"}
    renamed = {c: F.regexp_replace(texts[c], r"\banimal_domestic\b", "animal_domesticated") for c in texts if c.endswith(("_any_of", "_none_of"))}
    return df.withColumns(texts | renamed)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def bitext(spark: SparkSession, paths: str | list[str], mode: str = "tolerant", limit: int | None = None) -> DataFrame:
    """JSON-lines records with dataset, the file's name without val_ and .jsonl.

    tolerant: bad lines and those without a translation are left out, and files that are not there have no lines; strict: both raise.
    With `limit` the first lines stay, in the order of files and lines.
    """
    if mode != "strict":
        there = [p for p in ([paths] if isinstance(paths, str) else paths) if _exists(spark, p)]
        if not there:
            return spark.createDataFrame([], BITEXT + ", dataset string")
        paths = there
    reader = spark.read.schema(BITEXT + ("" if mode == "strict" else ", _corrupt string"))
    if mode == "strict":
        df = reader.option("mode", "FAILFAST").json(paths)
    else:
        df = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(paths).filter("_corrupt is null and translation is not null").drop("_corrupt")
    df = df.withColumn("dataset", F.regexp_replace(F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.jsonl$", ""), "^val_", ""))
    if not limit:
        return df
    # within a partition rows follow the lines of its blocks
    place = df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_line": F.monotonically_increasing_id()})
    return place.orderBy("_file", "_block", "_line").limit(limit).drop("_file", "_block", "_line")


def training_log(lines: DataFrame, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """Training rows (5 numbers) and evaluation rows (9 numbers) of a ragged log; comments, blanks and other rows are left out."""
    good = lines.filter(~F.trim(F.col(text)).startswith("#") & (F.trim(F.col(text)) != ""))
    numbers = good.withColumn("_v", F.transform(F.split(F.trim(F.col(text)), ","), lambda x: x.try_cast("double"))).filter(F.forall("_v", lambda x: x.isNotNull()))
    keep = [c for c in lines.columns if c != text]

    def rows(names: str) -> DataFrame:
        cols = names.split()
        return numbers.filter(F.size("_v") == len(cols)).select(*keep, *[F.col("_v")[i].alias(c) for i, c in enumerate(cols)])

    return rows("train_loss grad_norm learning_rate epoch step"), rows("eval_loss bleu chrf ter runtime samples_per_sec steps_per_sec epoch step")


def checkpoints(df: DataFrame, path: str, start: int = 0) -> DataFrame:
    """Rows whose path's last part names a checkpoint, with step, from start on, by step."""
    name = F.element_at(F.split(F.col(path), "/"), -1)
    step = F.regexp_extract(name, r"-(\d+)$", 1)
    return df.filter(name.contains("checkpoint") & (step != "")).withColumn("step", step.cast("long")).filter(F.col("step") >= start).orderBy("step")


def names(spark: SparkSession) -> DataFrame:
    """A dimension of given names and places of our own."""
    people = {"f": "Ana Berta Clara Dora Elena Fidelia Gloria Hilda Irma Juana Lucia Marta Nora Olga", "m": "Adolfo Bruno Carlos Diego Emilio Felipe Gustavo Hugo Ismael Jorge Leandro Mario Nestor Oscar Pablo"}
    places = "Antigua Chisec Cobán Esquipulas Flores Ixcán Lanquín Panzós Purulhá Quetzaltenango Raxruhá Salamá Senahú Tactic Zacapa"
    rows = [(n, g, "person") for g, ns in people.items() for n in ns.split()] + [(n, None, "place") for n in places.split()]
    return spark.createDataFrame(rows, "name string, gender string, kind string")
