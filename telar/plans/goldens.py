"""Queries over small tables written out in their SQL, and over the driver's tables: picks, filters, persons, labels, encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from telar.operators import corpus, sampling, selection
from telar.operators.stopwords import STOPWORDS
from telar.plans import render
from telar.plans.catalogue import _BITEXT, _HASH, _read, _scored, query


def _values(rows: list[tuple], names: str) -> str:
    def one(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") t({names}))"


_LABELS = [("human", "B-HUMAN"), (" Body_Part ", "B-BODY-PART"), ("body part", "B-BODY-PART"), ("animal_wild", "B-ANIMAL-WILD"), ("animal_domesticated", "B-ANIMAL-DOMESTICATED"), ("place", "B-LOCATION"), ("furniture", "B-FURNITURE"),
           ("language", "B-LANGUAGE"), ("emotion", "B-EMOTION"), ("wood", "B-WOOD"), ("time", "O"), ("event", "O"), ("vegetable", "O"), ("abstract", "O"), ("", "O"), (None, "O"), ("corn", "B-CORN"), ("tool", "B-TOOL"), ("unheard_of", "O")]


@query(f"SELECT class, label FROM {_values(_LABELS, 'class, label')}")
def semantic_labels(spark, sf_dir):
    return spark.createDataFrame([(c,) for c, _ in _LABELS], "class string").select("class", render.label(F.col("class")).alias("label"))


_ADVERBS = [(1, "prs | fut"), (2, "pst"), (3, None), (4, "FUT"), (5, "future"), (6, "")]


@query(f"SELECT id FROM {_values(_ADVERBS, 'id, tense_compat')} WHERE list_contains(regexp_split_to_array(lower(tense_compat), '[;,/| ]+'), 'fut')")
def future_adverbs(spark, sf_dir):
    return selection.future_adverbs(spark.createDataFrame(_ADVERBS, "id int, tense_compat string")).select("id")


_ADJECTIVES = [(1, "color"), (2, " Shape"), (3, "size"), (4, None), (5, "")]


@query(f"SELECT id FROM {_values(_ADJECTIVES, 'id, adj_type')} WHERE coalesce(lower(trim(adj_type)), '') NOT IN ('color', 'shape')")
def comparable_adjectives(spark, sf_dir):
    return selection.comparable(spark.createDataFrame(_ADJECTIVES, "id int, adj_type string")).select("id")


_NOUNS = [(1, "kinship", "1"), (2, "weather", "0"), (3, "Tool ", None), (4, "body_part", "0"), (5, "human", "true"), (6, None, ""), (7, "animal_wild", "0"), (8, "food", "no")]


@query(f"SELECT id FROM {_values(_NOUNS, 'id, class, is_human')} WHERE coalesce(lower(trim(class)), '') NOT IN ('human', 'weather', 'animal_wild')")
def possessable_nouns(spark, sf_dir):
    return selection.possessable(spark.createDataFrame(_NOUNS, "id int, class string, is_human string")).select("id")


@query(f"SELECT id FROM {_values(_NOUNS, 'id, class, is_human')} WHERE coalesce(lower(is_human), '') NOT IN ('1', 'true', 'yes')")
def owned_nouns(spark, sf_dir):
    return selection.not_human(spark.createDataFrame(_NOUNS, "id int, class string, is_human string")).select("id")


@query("SELECT p_partkey FROM part WHERE CAST(p_size AS VARCHAR) = '7'")
def same_text_pick(spark, sf_dir):
    return selection.same_text(_read(spark, sf_dir, "part"), "p_size", 7).select("p_partkey")


_PEOPLE = [("Dora", "F"), ("Hugo", "m"), ("Alex", None)]


@query(f"SELECT 'name::' || name AS id, name AS lemma_kek, name AS gloss_en, name AS gloss_es, 'human' AS class, '1' AS is_human, 'optional' AS possessability, lower(coalesce(gender, 'm')) AS gender_es, '0' AS has_color FROM {_values(_PEOPLE, 'name, gender')}")
def name_rows(spark, sf_dir):
    return selection.name_rows(spark.createDataFrame(_PEOPLE, "name string, gender string"))


@query(f"SELECT range AS draw, CASE WHEN {_HASH.format(chr(39) + 'side|' + chr(39) + ' || range')} % 2 = 0 THEN 'pre' ELSE 'post' END AS style, CASE WHEN range % 5 = 0 THEN 'f' WHEN {_HASH.format(chr(39) + 'sex|' + chr(39) + ' || range')} % 2 = 0 THEN 'm' ELSE 'f' END AS gender FROM range(200)")
def coin_flips(spark, sf_dir):
    return spark.range(200).select(F.col("id").alias("draw"), selection.coin("side", ("pre", "post"), F.col("id")).alias("style"), selection.shared_gender("sex", F.when(F.col("id") % 5 == 0, "F"), F.col("id")).alias("gender"))


_SENTENCES = [  # subject, mood, default, slot of a plural subject, person
    ("3sg - Name", None, "1sg", False, "3sg"), ("3pl - Noun def", "", "1sg", False, "3pl"), (" 2PL", None, None, False, "2pl"), ("", "IMP", None, False, "2sg"), (None, "imp_neg", "3pl", False, "2pl"), ("", "IMP", "3sg", True, "2pl"),
    ("1pl", "IMP", None, False, "1pl"), (None, None, "1sg", True, "1pl"), (None, None, "9xx", False, "3sg"), ("Noun", "IND", "2sg", False, "2sg"), (None, None, None, True, "3pl"), ("3sg - Noun", None, None, True, "3pl")]


@query("SELECT id, person FROM " + _values([(i, r[4]) for i, r in enumerate(_SENTENCES)], "id, person"))
def person_inference(spark, sf_dir):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(_SENTENCES)], "id int, subject string, mood string, fallback string, many boolean")
    return df.select("id", selection.sentence_person(*map(F.col, ("subject", "mood", "fallback", "many"))).alias("person"))


@query(f"""WITH f AS (SELECT *, row_number() OVER (PARTITION BY src_text ORDER BY conv_id, turn) AS copy FROM {_BITEXT} WHERE src_text NOT IN (SELECT src_text FROM {_BITEXT} WHERE conv_id % 7 = 0)),
t AS (SELECT *, row_number() OVER (PARTITION BY tgt_lang ORDER BY conv_id, turn) AS k FROM f WHERE copy = 1) SELECT tgt_lang, conv_id, turn FROM t WHERE k <= 20""")
def unseen_samples(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    return selection.unseen_samples(rows, rows.filter("conv_id % 7 = 0"), "src_text", "tgt_lang", ["conv_id", "turn"], 20).select("tgt_lang", "conv_id", "turn")


@query(f"SELECT conv_id, turn, src_text = tgt_text AS match FROM {_BITEXT}")
def prediction_rows(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("row", F.struct("conv_id", "turn"))
    both = selection.aligned(rows.select("row", "src_text"), rows.select("row", "tgt_text"), "row")
    return both.select("row.conv_id", "row.turn", (F.col("src_text") == F.col("tgt_text")).alias("match"))


@query(f"""WITH i AS (SELECT conv_id, turn, list_transform(string_split(src_text, ' '), lambda x: CAST(length(x) AS INTEGER))[1:128] AS s, list_transform(string_split(tgt_text, ' '), lambda x: CAST(length(x) AS INTEGER))[1:128] AS t FROM {_BITEXT})
SELECT conv_id, turn, array_to_string(s, ' ') AS input_ids, array_to_string(list_transform(t, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ' ') AS labels, CASE WHEN turn % 2 = 0 THEN 1.0 ELSE 0.4 END AS task_weight FROM i""")
def encoded_rows(spark, sf_dir):
    rows = _scored(spark, sf_dir).withColumn("w", F.when(F.col("turn") % 2 != 0, 0.4))
    out = selection.encoded(rows, "src_text", "tgt_text", lambda c: F.transform(F.split(c, " "), F.length), 0, weight="w")
    return out.select("conv_id", "turn", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("input_ids", "labels")], "task_weight")


@query("SELECT event_id, round(value / 1000, 6) AS learning_rate, round(value / 3, 4) AS loss FROM events WHERE event_id % 10 = 0")
def metric_rounding(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").filter("event_id % 10 = 0")
    return selection.rounded_metrics(rows.select("event_id", (F.col("value") / 1000).alias("learning_rate"), (F.col("value") / 3).alias("loss")))


@query("""WITH w AS (SELECT p_partkey, sum(p_retailprice / 7000) OVER (ORDER BY p_partkey) AS high FROM part WHERE p_partkey <= 150),
r AS (SELECT p_partkey, high, coalesce(lag(high) OVER (ORDER BY p_partkey), 0) AS low, max(high) OVER () AS total FROM w),
d AS (SELECT range AS draw, CAST(('0x' || substr(md5('pick|' || range), 1, 12)) AS BIGINT) / 281474976710656.0 AS u FROM range(300))
SELECT draw, p_partkey FROM d JOIN r ON u * total >= low AND u * total < high""")
def weighted_pick_fractions(spark, sf_dir):
    pool = _read(spark, sf_dir, "part").filter("p_partkey <= 150").withColumn("w", F.col("p_retailprice") / 7000)
    return sampling.weighted_pick(spark.range(300).withColumnRenamed("id", "draw"), pool, "w", "p_partkey", "pick")


_GLOSSES = ["the", "house of my mother", "de la casa", "", "with", "red (color)"]


@query("SELECT gloss, words FROM " + _values([("the", ""), ("house of my mother", "house mother"), ("de la casa", "casa"), ("", ""), ("with", ""), ("red (color)", "red (color)")], "gloss, words"))
def content_words(spark, sf_dir):
    return spark.createDataFrame([(g,) for g in _GLOSSES], "gloss string").select("gloss", F.array_join(corpus.content_words(F.col("gloss"), STOPWORDS), " ").alias("words"))
