"""Queries over the driver's tables and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions import english, qeqchi, spanish, text
from telar.operators import bitext, constraints, corpus, metrics, sampling
from telar.plans import lexicon, render
from telar.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function as a query of its name, with the SQL of its result."""
    def take(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return take


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _english_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").filter("lang = 'en'").select("text")


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9''’ʼ]+')"
_BITEXT = """(SELECT conv_id, turn, src_text, tgt_text, 'kek_Latn' AS src_lang, CASE WHEN conv_id % 2 = 0 THEN 'eng_Latn' ELSE 'spa_Latn' END AS tgt_lang FROM
 (SELECT conv_id, turn, role, text AS src_text, lead(text) OVER w AS tgt_text, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next = 'assistant')"""
_DIRECTED = f"""(SELECT conv_id, turn, 0 AS direction, src_lang, tgt_lang, src_text, tgt_text FROM {_BITEXT} WHERE length(src_text) > 0 AND length(tgt_text) > 0
 UNION ALL SELECT conv_id, turn, 1, tgt_lang, src_lang, tgt_text, src_text FROM {_BITEXT} WHERE length(src_text) > 0 AND length(tgt_text) > 0)"""
_NAME = "CASE {0} WHEN 'kek_Latn' THEN 'Q''eqchi''' WHEN 'eng_Latn' THEN 'English' WHEN 'spa_Latn' THEN 'Spanish' ELSE {0} END"
_HASH = "CAST(('0x' || substr(md5({0}), 1, 8)) AS BIGINT)"


# Distributions and audits

@query(f"""WITH t AS (SELECT unnest({_TOKENS}) AS token FROM documents WHERE lang = 'en'), c AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n, round(n * 100 / (SELECT count(*) FROM documents WHERE lang = 'en'), 6) AS percent FROM c ORDER BY n DESC, token LIMIT 40""")
def word_distribution_top40(spark, sf_dir):
    return corpus.distribution(_english_docs(spark, sf_dir), "text")


@query(f"""WITH l AS (SELECT {_TOKENS} AS w FROM documents WHERE lang = 'en'), t AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS token FROM l WHERE len(w) > 1), c AS (SELECT token, count(*) AS n FROM t GROUP BY token)
SELECT row_number() OVER (ORDER BY n DESC, token) AS rank, token, n, round(n * 100 / (SELECT count(*) FROM documents WHERE lang = 'en'), 6) AS percent FROM c ORDER BY n DESC, token LIMIT 40""")
def bigram_distribution_top40(spark, sf_dir):
    return corpus.distribution(_english_docs(spark, sf_dir), "text", pairs=True)


@query("""WITH n AS (SELECT greatest(len(string_split_regex(trim(text), '[ \\t\\n]+')) + 8, n_chars // 6) AS n FROM documents)
SELECT count(*) AS records, round(avg(n), 4) AS mean, max(n) AS longest, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS p95, CAST(floor(quantile_cont(n, 0.99)) AS BIGINT) AS p99,
count(*) FILTER (WHERE n > 128) AS over, round(count(*) FILTER (WHERE n > 128) / count(*), 6) AS over_share FROM n""")
def corpus_audit(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return corpus.audit(docs, F.size(F.split(F.regexp_replace("text", r"^[ \t\n]+|[ \t\n]+$", ""), r"[ \t\n]+")), F.floor(F.col("n_chars") / 6).cast("int"))


@query("SELECT lang AS language, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY lang")
def language_balance(spark, sf_dir):
    return corpus.balance(_read(spark, sf_dir, "documents"), F.col("lang"))


# Bitext

@query(f"SELECT conv_id, turn, src_text AS pivot_text FROM {_BITEXT} WHERE length(src_text) > 0 AND length(tgt_text) > 0")
def pivot_side_selector(spark, sf_dir):
    pairs = bitext.turn_pairs(_read(spark, sf_dir, "conversations")).filter(bitext.both_present())
    return pairs.select("conv_id", "turn", bitext.pivot_side().alias("pivot_text")).filter("pivot_text is not null")


@query(f"SELECT * FROM {_DIRECTED}")
def direction_explode(spark, sf_dir):
    return bitext.directions(bitext.turn_pairs(_read(spark, sf_dir, "conversations")))


@query(f"SELECT least(trim(src_text), trim(tgt_text)) AS key_a, greatest(trim(src_text), trim(tgt_text)) AS key_b, count(*) AS records FROM {_DIRECTED} GROUP BY ALL")
def concept_groups(spark, sf_dir):
    return corpus.concept_groups(direction_explode(spark, sf_dir))


def _prompted(kind: str) -> str:
    return f"SELECT conv_id, turn, direction, 'translate {kind}' || {_NAME.format('src_lang')} || ' to ' || {_NAME.format('tgt_lang')} || ': ' || src_text AS prompt FROM {_DIRECTED}"


@query(_prompted("synthetic "))
def prompt_stl(spark, sf_dir):
    return direction_explode(spark, sf_dir).select("conv_id", "turn", "direction", bitext.prompt().alias("prompt"))


@query(_prompted(""))
def prompt_mtl(spark, sf_dir):
    return direction_explode(spark, sf_dir).select("conv_id", "turn", "direction", bitext.prompt(None).alias("prompt"))


_LABEL = """CASE WHEN contains(lower(prompt), 'q''eqchi'' to english') THEN 'q''eqchi''->english' WHEN contains(lower(prompt), 'english to q''eqchi''') THEN 'english->q''eqchi'''
 WHEN contains(lower(prompt), 'q''eqchi'' to spanish') THEN 'q''eqchi''->spanish' WHEN contains(lower(prompt), 'spanish to q''eqchi''') THEN 'spanish->q''eqchi''' END"""


@query(f"SELECT {_LABEL} AS label, count(*) AS n FROM ({_prompted('')}) GROUP BY ALL")
def direction_label(spark, sf_dir):
    return prompt_mtl(spark, sf_dir).groupBy(bitext.direction_label(F.col("prompt")).alias("label")).agg(F.count("*").alias("n"))


@query(f"""SELECT prompt, direction_label FROM (SELECT prompt, {_LABEL} AS direction_label, row_number() OVER (PARTITION BY {_LABEL} ORDER BY conv_id * 1000 + turn) AS r FROM ({_prompted('')})) WHERE r = 1 AND direction_label IS NOT NULL""")
def first_sample_per_direction(spark, sf_dir):
    rows = prompt_mtl(spark, sf_dir).withColumn("_o", F.col("conv_id") * 1000 + F.col("turn"))
    return bitext.first_per_direction(rows, "prompt", "_o").select("prompt", "direction_label")


_TAGGED = f"(SELECT *, 'POS ' || length(src_text) AS pos_kek, CASE WHEN turn % 4 = 0 THEN '' ELSE 'SEM ' || turn END AS semantic_kek FROM {_DIRECTED})"
_MULTI = f"""(SELECT conv_id, turn, direction, 'translation' AS task, 'translate ' || {_NAME.format('src_lang')} || ' to ' || {_NAME.format('tgt_lang')} || ': ' || src_text AS input_text, tgt_text AS target_text, 1.0::DOUBLE AS task_weight FROM {_TAGGED}
UNION ALL SELECT conv_id, turn, direction, 'pos', 'tag pos: ' || src_text, pos_kek, 0.4 FROM {_TAGGED} WHERE src_lang = 'kek_Latn' AND pos_kek <> '' AND semantic_kek <> ''
UNION ALL SELECT conv_id, turn, direction, 'semantic', 'tag semantic: ' || src_text, semantic_kek, 0.8 FROM {_TAGGED} WHERE src_lang = 'kek_Latn' AND pos_kek <> '' AND semantic_kek <> '')"""


@query(f"SELECT * FROM {_MULTI}")
def multitask_expand(spark, sf_dir):
    rows = direction_explode(spark, sf_dir)
    return bitext.multitask(rows.withColumn("pos_kek", F.concat(F.lit("POS "), F.length("src_text"))).withColumn("semantic_kek", F.when(F.col("turn") % 4 == 0, "").otherwise(F.concat(F.lit("SEM "), F.col("turn")))))


@query(f"SELECT task, count(*) AS n FROM {_MULTI} GROUP BY task")
def multitask_counts(spark, sf_dir):
    return multitask_expand(spark, sf_dir).groupBy("task").agg(F.count("*").alias("n"))


# Splits

_SPLIT = f"""(WITH k AS (SELECT DISTINCT lang, text FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {_HASH.format("'split|' || text")}, text) AS r, count(*) OVER (PARTITION BY lang) AS n FROM k)
SELECT d.doc_id, d.lang, CASE WHEN r.r <= floor(r.n * 0.9) THEN 'train' ELSE 'val' END AS side FROM documents d JOIN r USING (lang, text))"""


@query(f"SELECT * FROM {_SPLIT}")
def stratified_split(spark, sf_dir):
    return sampling.split(_read(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "lang", ["text"], "split").select("doc_id", "lang", "side")


@query(f"SELECT lang, side, count(*) AS n FROM {_SPLIT} GROUP BY ALL")
def split_sizes(spark, sf_dir):
    return stratified_split(spark, sf_dir).groupBy("lang", "side").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id FROM {_SPLIT} WHERE side = 'val' ORDER BY doc_id LIMIT 50")
def split_mini(spark, sf_dir):
    return stratified_split(spark, sf_dir).filter("side = 'val'").select("doc_id").orderBy("doc_id").limit(50)


@query(f"SELECT doc_id, CASE WHEN {_HASH.format(chr(39) + 'split|' + chr(39) + ' || text')} % 100 < 90 THEN 'train' ELSE 'val' END AS side FROM documents")
def split_by_hash(spark, sf_dir):
    return sampling.split_hashed(_read(spark, sf_dir, "documents"), ["text"], "split").select("doc_id", "side")


@query("SELECT n_chars // 500 AS bucket, count(*) AS n FROM documents GROUP BY ALL")
def length_buckets(spark, sf_dir):
    return sampling.length_buckets(_read(spark, sf_dir, "documents"), F.col("n_chars"), 500).groupBy("bucket").agg(F.count("*").alias("n"))


# Duplicates and history

@query("SELECT min(doc_id) AS doc_id, text, lang, source FROM documents GROUP BY text, lang, source")
def dedup_triple(spark, sf_dir):
    return corpus.dedup(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["text", "lang", "source"], "doc_id")


_NEW = "(SELECT * FROM (SELECT doc_id, doc_id // 100 AS batch, text, min(doc_id // 100) OVER (PARTITION BY text) AS first FROM documents) WHERE batch = first)"


@query(f"SELECT doc_id, batch FROM {_NEW}")
def dedup_history(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 100).alias("batch"))
    return corpus.new_by_batch(docs, "batch", "text").select("doc_id", "batch")


@query("SELECT doc_id FROM documents WHERE doc_id >= 500 AND text NOT IN (SELECT text FROM documents WHERE doc_id < 500)")
def history_anti_join(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.not_in_history(docs.filter("doc_id >= 500"), docs.filter("doc_id < 500"), "text").select("doc_id")


@query(f"""WITH raw AS (SELECT doc_id // 100 AS batch, count(*) AS raw FROM documents GROUP BY ALL), kept AS (SELECT batch, count(*) AS final, count(DISTINCT text) AS new FROM {_NEW} GROUP BY batch)
SELECT batch, raw, coalesce(final, 0) AS final, round((raw - coalesce(final, 0)) / raw, 6) AS rate, CAST(sum(coalesce(new, 0)) OVER (ORDER BY batch) AS BIGINT) AS seen FROM raw LEFT JOIN kept USING (batch)""")
def dedup_rate(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 100).alias("batch"))
    return corpus.rejection(docs, "batch", "text")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 3 = 0)")
def validator_semijoin(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return corpus.validated(docs, docs.filter("doc_id % 3 = 0"), "text").select("doc_id")


# Allocation and picks

_PARTS = "(SELECT p_partkey, p_size FROM part WHERE p_partkey <= 150)"
_ALLOC = f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_size END AS w FROM {_PARTS}), k AS (SELECT count(*) FILTER (WHERE w > 0) AS k, sum(w) AS s FROM p),
x AS (SELECT p.*, CASE WHEN w > 0 THEN w * (500 - k) / s ELSE 0.0 END AS share, k FROM p, k), b AS (SELECT *, floor(share) AS base, 500 - k - sum(floor(share)) OVER () AS rest FROM x),
t AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN w > 0 THEN 0 ELSE 1 END, share - base DESC, p_partkey) AS turn FROM b)
SELECT p_partkey, CAST(CASE WHEN w > 0 THEN 1 + base + CASE WHEN turn <= rest THEN 1 ELSE 0 END ELSE 0 END AS BIGINT) AS n FROM t"""


@query(_ALLOC)
def template_allocation(spark, sf_dir):
    parts = _read(spark, sf_dir, "part").filter("p_partkey <= 150").select("p_partkey", F.when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size")).alias("w"))
    return sampling.allocate(parts, "w", 500, "p_partkey").select("p_partkey", "n")


@query(f"""WITH c AS (SELECT p_partkey, CAST(sum(p_size) OVER (ORDER BY p_partkey) AS BIGINT) AS high, p_size, CAST(sum(p_size) OVER () AS BIGINT) AS total FROM {_PARTS}), d AS (SELECT range AS draw, {_HASH.format("'pick|' || range")} AS h FROM range(0, 300))
SELECT draw, p_partkey FROM d JOIN c ON h % total >= high - p_size AND h % total < high""")
def weighted_pick(spark, sf_dir):
    return sampling.weighted_pick(spark.range(300).withColumnRenamed("id", "draw"), _read(spark, sf_dir, "part").filter("p_partkey <= 150"), "p_size", "p_partkey", "pick")


@query(f"SELECT p_type, arg_min(p_partkey, ({_HASH.format(chr(39) + 'uni|' + chr(39) + ' || p_partkey')}, p_partkey)) AS p_partkey FROM part GROUP BY p_type")
def uniform_pick(spark, sf_dir):
    return sampling.uniform_pick(_read(spark, sf_dir, "part"), ["p_type"], "p_partkey", "uni")


@query(f"SELECT p_partkey, ['1sg', '2sg', '3sg', '1pl', '2pl', '3pl'][1 + (row_number() OVER (ORDER BY p_partkey) - 1) % 6] AS person FROM {_PARTS}")
def round_robin(spark, sf_dir):
    return sampling.round_robin(_read(spark, sf_dir, "part").filter("p_partkey <= 150").select("p_partkey"), "p_partkey", list(english.PERSONS), "person")


# Frequencies

_ZIPF = f"(WITH w AS (SELECT lang, unnest({_TOKENS}) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL) SELECT lang, word, round(log10(n * 1e9 / sum(n) OVER (PARTITION BY lang)), 6) AS zipf FROM c)"


@query(f"SELECT * FROM {_ZIPF}")
def zipf_weights(spark, sf_dir):
    return corpus.zipf(_read(spark, sf_dir, "documents"), "text", "lang")


_GLOSSES = [("the of",), ("And (rare) thing",), ("tion / x",), ("",), ("zzqx",), ("of thly the",), (None,), ("THE",)]


@query(f"""WITH g AS (SELECT * FROM (VALUES {', '.join('(NULL)' if g is None else "('" + g + "')" for (g,) in _GLOSSES)}) AS t(gloss)), c AS (SELECT gloss, trim(lower(string_split(string_split(coalesce(gloss, ''), '(')[1], '/')[1])) AS cut FROM g),
w AS (SELECT gloss, cut, unnest(string_split(cut, ' ')) AS word FROM c), z AS (SELECT word, zipf FROM {_ZIPF} WHERE lang = 'en'),
m AS (SELECT gloss, max(coalesce(zipf, 1.5)) AS z FROM w LEFT JOIN z USING (word) WHERE word NOT IN ('the', 'of', 'and', '') GROUP BY gloss)
SELECT c.gloss, CASE WHEN cut = '' THEN 0.0 ELSE coalesce(z, 5.0) END AS zipf FROM c LEFT JOIN m ON c.gloss IS NOT DISTINCT FROM m.gloss""")
def smart_frequency(spark, sf_dir):
    freq = zipf_weights(spark, sf_dir).filter("lang = 'en'").select("word", "zipf")
    return corpus.smart_frequency(spark.createDataFrame(_GLOSSES, "gloss string"), "gloss", freq, ["the", "of", "and"])


@query("WITH w AS (SELECT p_partkey, pow(10, greatest(p_size % 7, p_size % 5) / 1.5) AS w FROM part) SELECT p_partkey, round(w, 6) AS p_weight, round(w / sum(w) OVER () * 100, 6) AS p_debug_percent FROM w")
def weight_normalisation(spark, sf_dir):
    out = corpus.weights(_read(spark, sf_dir, "part"), F.col("p_size") % 7, F.col("p_size") % 5)
    return out.select("p_partkey", F.round("p_weight", 6).alias("p_weight"), F.round("p_debug_percent", 6).alias("p_debug_percent"))


# Constraints

_LIST = "list_filter(list_transform(string_split_regex(coalesce({0}, ''), '[;,/| ]+'), lambda x: lower(trim(x))), lambda x: x <> '')"
_COUNT = "CASE WHEN lower(trim({0})) IN ('count', 'countable', 'c') THEN 'countable' WHEN lower(trim({0})) IN ('mass', 'uncountable', 'unc', 'noncount', 'non-count') THEN 'uncountable' WHEN lower(trim({0})) IN ('plural', 'plural-only', 'plurale tantum', 'plurale-tantum', 'pl-only') THEN 'plural-only' ELSE lower(trim({0})) END"
_RICH = f"""(SELECT id, cls AS class, CASE WHEN cls IN ('kinship', 'body_part') THEN 'obligatory' WHEN cls IN ({', '.join(repr(x) for x in constraints.NOT_OWNED)}) THEN 'non-possessable' ELSE 'optional' END AS possessability,
CASE WHEN cls IN ('human', 'kinship', 'occupation') THEN '1' WHEN coalesce(is_human, '') = '' THEN '0' ELSE is_human END AS is_human, CASE WHEN cls IN ('artifact', 'building', 'clothing', 'food', 'tool', 'vehicle') THEN '1' WHEN coalesce(has_color, '') = '' THEN '0' ELSE has_color END AS has_color,
CASE WHEN loan IN ('1', 'true', 'yes') THEN '1' ELSE '0' END AS loan, {_COUNT.format('countability_en')} AS countability_en, {_COUNT.format('countability_es')} AS countability_es FROM (SELECT *, lower(trim(class)) AS cls FROM {lexicon.values('NOUN')}))"""


@query(f"SELECT * FROM {_RICH}")
def noun_enrichment(spark, sf_dir):
    rich = constraints.enrich_nouns(lexicon.table(spark, "NOUN"))
    return rich.select("id", "class", "possessability", "is_human", "has_color", "loan", "countability_en", "countability_es")


@query(f"SELECT unnest(list_distinct(list_filter(string_split_regex(transitivity, '[;,/| ]+'), lambda x: x IN ('tr', 'intr', 'ditr')))) AS pool, id FROM {lexicon.values('VERB')}")
def transitivity_pools(spark, sf_dir):
    return lexicon.table(spark, "VERB").select(F.explode(constraints.transitivity(F.col("transitivity"))).alias("pool"), "id")


_PERMITS = "(len({0}) = 0 OR list_contains({0}, {2})) AND NOT list_contains({1}, {2})"


@query(f"""WITH v AS (SELECT id, {_LIST.format('agent_class_any_of')} AS allow, {_LIST.format('agent_class_none_of')} AS ban, 'agent' AS role FROM {lexicon.values('VERB')} UNION ALL SELECT id, {_LIST.format('theme_class_any_of')}, {_LIST.format('theme_class_none_of')}, 'theme' FROM {lexicon.values('VERB')}
UNION ALL SELECT id, {_LIST.format('goal_class_any_of')}, {_LIST.format('goal_none_of')}, 'goal' FROM {lexicon.values('VERB')})
SELECT v.id AS verb, role, n.id AS noun FROM v JOIN {_RICH} n ON {_PERMITS.format('allow', 'ban', 'n.class')}""")
def verb_noun_args(spark, sf_dir):
    verbs = constraints.verb_constraints(lexicon.table(spark, "VERB"))
    nouns = constraints.enrich_nouns(lexicon.table(spark, "NOUN")).select(F.col("id").alias("noun"), "class")
    out = None
    for role in ("agent", "theme", "goal"):
        rows = verbs.select(F.col("id").alias("verb"), F.lit(role).alias("role"), F.col(f"{role}_allow").alias("allow"), F.col(f"{role}_ban").alias("ban"))
        one = constraints.join_by_class(rows, nouns, "allow", "ban", "class").select("verb", "role", "noun")
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH a AS (SELECT *, {_LIST.format('class_any_of')} AS allow, {_LIST.format('class_none_of')} AS ban FROM {lexicon.values('ADJECTIVE')})
SELECT a.id AS adjective, n.id AS noun FROM a JOIN {_RICH} n ON {_PERMITS.format('allow', 'ban', 'n.class')} AND (lower(adj_type) <> 'color' OR n.has_color IN ('1', 'true', 'yes'))""")
def adj_noun_compat(spark, sf_dir):
    nouns = constraints.enrich_nouns(lexicon.table(spark, "NOUN"))
    return lexicon.table(spark, "ADJECTIVE").alias("a").join(F.broadcast(nouns.alias("n")), constraints.adjective_fits()).select(F.col("a.id").alias("adjective"), F.col("n.id").alias("noun"))


_CODE = "list_transform({0}, lambda x: CASE x WHEN 'present' THEN 'prs' WHEN 'past' THEN 'pst' WHEN 'future' THEN 'fut' WHEN 'progressive' THEN 'prg' WHEN 'continuous' THEN 'prg' WHEN 'perfect' THEN 'prf' ELSE x END)"


@query(f"""WITH d AS (SELECT id, {_CODE.format(_LIST.format('tense_compat'))} AS tenses, {_LIST.format('class_any_of')} AS allow, {_LIST.format('class_none_of')} AS ban FROM {lexicon.values('ADVERB')}), v AS (SELECT id, {_LIST.format('category')} AS cats FROM {lexicon.values('VERB')}), t AS (SELECT unnest(['prs', 'pst', 'fut', 'prg']) AS tense)
SELECT d.id AS adverb, v.id AS verb, tense FROM d, v, t WHERE (len(tenses) = 0 OR list_contains(tenses, tense)) AND (len(allow) = 0 OR len(cats) = 0 OR list_has_any(allow, cats)) AND NOT list_has_any(ban, cats)""")
def adverb_verb_compat(spark, sf_dir):
    adverbs = lexicon.table(spark, "ADVERB").select(F.col("id").alias("adverb"), F.transform(text.split_set(F.col("tense_compat")), constraints.tense_code).alias("tenses"), text.split_set(F.col("class_any_of")).alias("allow"), text.split_set(F.col("class_none_of")).alias("ban"))
    verbs = lexicon.table(spark, "VERB").select(F.col("id").alias("verb"), text.split_set(F.col("category")).alias("cats"))
    tenses = spark.createDataFrame([(t,) for t in ("prs", "pst", "fut", "prg")], "tense string")
    return adverbs.crossJoin(verbs).crossJoin(tenses).filter(constraints.adverb_fits(F.col("tenses"), F.array("tense"), F.col("allow"), F.col("ban"), F.col("cats"))).select("adverb", "verb", "tense")


_SLOTS = f"(SELECT id, person, regexp_extract_all(kek || ' ' || en || ' ' || es, '\\{{[A-Z0-9_]+\\}}') AS s FROM {lexicon.values('TEMPLATE')})"


@query(f"SELECT DISTINCT id, unnest(s) AS slot FROM {_SLOTS}")
def slot_extract(spark, sf_dir):
    return lexicon.table(spark, "TEMPLATE").select("id", F.explode(text.slots(F.concat_ws(" ", "kek", "en", "es"))).alias("slot"))


@query(f"""WITH f AS (SELECT id, list_filter(['pst', 'fut', 'prg', 'prf'], lambda t: len(list_filter(s, lambda x: contains(x, CASE t WHEN 'pst' THEN '_PST_' WHEN 'fut' THEN '_FUT_' WHEN 'prg' THEN '_PROG_' ELSE '_PP_' END))) > 0) AS f, s, person FROM {_SLOTS})
SELECT id, CASE WHEN len(f) = 0 THEN 'prs' ELSE array_to_string(f, ',') END AS tenses, len(list_filter(s, lambda x: x = '{{THEME_NP}}' OR starts_with(x, '{{THEME_NP_'))) > 0 AS theme, person LIKE '%pl' AS plural_subject FROM f""")
def tense_flags(spark, sf_dir):
    t = lexicon.table(spark, "TEMPLATE").withColumn("s", text.slots(F.concat_ws(" ", "kek", "en", "es")))
    return t.select("id", F.array_join(constraints.tense_flags(F.col("s")), ",").alias("tenses"), constraints.has_slot(F.col("s"), "THEME_NP").alias("theme"), constraints.plural_subject(F.col("s"), F.col("person")).alias("plural_subject"))


@query(f"""WITH v AS (SELECT id, list_contains(string_split_regex(transitivity, '[;,/| ]+'), 'tr') AS tr, list_contains(string_split_regex(transitivity, '[;,/| ]+'), 'ditr') AS ditr, {_LIST.format('agent_class_any_of')} AS aa, {_LIST.format('agent_class_none_of')} AS ab, {_LIST.format('theme_class_any_of')} AS ta, {_LIST.format('theme_class_none_of')} AS tb, {_LIST.format('goal_class_any_of')} AS ga, {_LIST.format('goal_none_of')} AS gb FROM {lexicon.values('VERB')}),
x AS (SELECT v.*, a.id AS agent, a.class AS ac, t.id AS theme, t.class AS tc, g.id AS goal, g.class AS gc FROM v, {_RICH} a, {_RICH} t LEFT JOIN {_RICH} g ON g.id <> 'n1')
SELECT id AS verb, count(*) AS valid FROM x WHERE theme IS DISTINCT FROM goal AND NOT (ditr AND goal IS NULL) AND {_PERMITS.format('aa', 'ab', 'ac')} AND {_PERMITS.format('ta', 'tb', 'tc')} AND (gc IS NULL OR ({_PERMITS.format('ga', 'gb', 'gc')})) GROUP BY id""")
def semantic_validation(spark, sf_dir):
    verbs = constraints.verb_constraints(lexicon.table(spark, "VERB")).withColumn("_tr", constraints.transitivity(F.col("transitivity")))
    nouns = constraints.enrich_nouns(lexicon.table(spark, "NOUN")).select("id", "class")
    a, t, g = (nouns.select(F.col("id").alias(f"{r}_id"), F.col("class").alias(f"{r}_c")) for r in "atg")
    rows = F.broadcast(verbs).crossJoin(a).crossJoin(t.join(g, F.col("g_id") != "n1", "left"))
    ok = constraints.valid_roles(F.col("t_id"), F.col("g_id"), F.array_contains("_tr", "tr"), F.array_contains("_tr", "ditr"), F.lit(True), F.lit(True), [(F.col(f"{r}_c"), F.col(f"{n}_allow"), F.col(f"{n}_ban")) for r, n in zip("atg", ("agent", "theme", "goal"))])
    return rows.filter(ok).groupBy(F.col("id").alias("verb")).agg(F.count("*").alias("valid"))


# Surfaces

def _list_sql(rows: list[tuple]) -> str:
    def lit(x: object) -> str:
        return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


def goldens(inputs: list[tuple], columns: str, outputs: str, form: Callable[..., list]) -> Callable:
    """Register a query of fixed inputs whose outputs are stated by hand: each row has the inputs, then the outputs."""
    names, outs = columns.split(), outputs.split()
    sql = f"SELECT * FROM (VALUES {_list_sql(inputs)}) AS t({', '.join(names + outs)})"

    def take(name: str) -> None:
        def run(spark, sf_dir):
            df = spark.createDataFrame([r[: len(names)] for r in inputs], ", ".join(f"{n} string" for n in names))
            return df.select(*names, *[c.alias(o) for c, o in zip(form(*map(F.col, names)), outs)])

        run.__name__ = name
        query(sql)(run)

    return take


goldens([("hello world",  "Hello world"), ("¿dónde estás?", "¿Dónde estás?"), ("3 gatos corren.", "3 gatos corren."), ("...", "..."), ("  «él viene» ", "«Él viene»"), ("", "")],
        "surface", "cased", lambda s: [text.sentence_case(s)])("sentence_case")
goldens([("hola. cómo? bien! sí.", "Hola. Cómo? Bien! Sí."), ("a.b. c", "A.b. C"), ("x", "X"), ("", "")], "surface", "cased", lambda s: [text.capitalize_sentences(s)])("capitalize_sentences")
goldens([("winq-in  ok", "winqin ok"), ("x- y--z", "x- y-z"), ("xril ib' rib’ li winq", "xril rib’ li winq"), ("xril 'ib aawib’", "xril aawib’")], "surface", "cleaned", lambda s: [text.clean_kek(s)])("surface_cleanup_kek")
goldens([("the the man is is here", "the man is here"), ("a  {X_EN} dog", "a dog"), ("These these will will go", "These will go")], "surface", "cleaned", lambda s: [text.clean_english(s)])("surface_cleanup_en")
goldens([("va a el mercado de el pueblo", "va al mercado del pueblo"), ("se se lava la la cara", "se lava la cara"), ("de él", "de él")], "surface", "cleaned", lambda s: [text.clean_spanish(s)])("surface_cleanup_es")
goldens([("laj Juan, wan li punit.", "laj|Juan|,|wan|li|punit|."), ("k'a'ru?!", "k'a'ru|?|!"), ("a.b c", "a.b|c"), ("", "")], "surface", "tokens", lambda s: [F.array_join(text.annotation_tokens(s), "|")])("annotation_tokens")
goldens([("see", "sees", "seed", "seeing"), ("watch", "watches", "watched", "watching"), ("carry", "carries", "carried", "carrying"), ("stop", "stops", "stopped", "stopping"), ("die", "dies", "died", "dying"), ("panic", "panics", "panicked", "panicking"), ("go", "goes", "goed", "going"), ("make", "makes", "maked", "making"), ("play", "plays", "played", "playing")],
        "base", "third past ing", lambda b: [english.present_3sg(b), english.past(b), english.ing(b)])("verb_forms_en")
goldens([("child", "happy", None, "children", "a", "happier"), ("box", "big", "", "boxes", "a", "bigger"), ("city", "good", "better", "cities", "a", "better"), ("axe", "beautiful", "", "axes", "an", "more beautiful"), ("son-in-law", "red", "more", "sons-in-law", "a", "more red")],
        "noun adjective flag", "many determiner comparative", lambda n, a, f: [english.plural(n), english.article(n), english.comparative(a, f)])("noun_adjective_en")
goldens([("go", "2sg", "go", "don't go"), ("go", "1pl", "let's go", "let's not go"), ("go", "3pl", "should go", "shouldn't go"), ("go", "2pl", "go", "don't go")],
        "base person", "yes no", lambda b, p: [english.directive(b, p)["affirmative"], english.directive(b, p)["negative"]])("directive_en")
goldens([("hablar", "1sg", "hablo", "hablé", "voy a hablar", "estoy hablando", "hablado"), ("comer", "3pl", "comen", "comieron", "van a comer", "están comiendo", "comido"), ("buscar", "1sg", "busco", "busqué", "voy a buscar", "estoy buscando", "buscado"), ("conocer", "1sg", "conozco", "conocí", "voy a conocer", "estoy conociendo", "conocido"),
         ("lavarse", "2pl", "os lavan", "os lavaron", "van a lavaros", "os están lavando", "lavado"), ("ir", "1pl", "vamos", "fuimos", "vamos a ir", "estamos yendo", "ido"), ("proteger", "1sg", "protejo", "protegí", "voy a proteger", "estoy protegiendo", "protegido"), ("decir", "3sg", "dice", "dijo", "va a decir", "está deciendo", "dicho"), ("ver", "2sg", "ves", "viste", "vas a ver", "estás viendo", "visto")],
        "infinitive person", "present preterite future progressive participle", lambda i, p: [spanish.present(i, p), spanish.preterite(i, p), spanish.future(i, p), spanish.progressive(i, p), spanish.participle(i)])("verb_forms_es")
goldens([("hablar", "tu", "habla", "no hables"), ("comer", "usted", "coma", "no coma"), ("vivir", "ustedes", "vivan", "no vivan"), ("lavarse", "tú", "lavate", "no te laves"), ("tener", "2sg", "ten", "no tengas"), ("ser", "nosotros", "seamos", "no seamos"), ("dirigir", "3sg", "dirija", "no dirija")],
        "infinitive person", "affirmative negative", lambda i, p: [spanish.imperative(i, p), spanish.imperative(i, p, True)])("imperative_es")
goldens([("estar", "building", "no estoy", "estar"), ("either", "event", "no soy", "ser"), (None, None, "no soy", "estar")], "rule class", "negative place", lambda r, c: [spanish.copula_negative(r, F.lit("1sg")), spanish.location_copula(c)])("copula_es")
goldens([("il", "tr", "1sg", "wil", "tinwil"), ("tzaka", "tr", "3pl", "e'xtzakaeb’", "te'xtzaka"), ("wark", "intr", "1pl", "nakowark", "toowarq"), ("xik", "intr", "3sg", "naxik", "taaxik"), ("loq'", "ditr", "2sg", "aaloq'", "taaloq'")],
        "base kind person", "present future", lambda b, k, p: [qeqchi.conjugate(b, k, p, F.lit(None).cast("string")), qeqchi.future(b, k, p)])("verb_forms_kek")
goldens([("wark", "intr", "2sg", "chatwark", "matwark"), ("atink", "intr", "3sg", "chatink", "ma'atink"), ("ilok", "tr", "2sg", "chaawilok", "maawilok"), ("tzakank", "tr", "2pl", "cheeb’tzakank", "meetzakank"), ("", "intr", "2sg", None, None)],
        "infinitive kind person", "order_form ban_form", lambda i, k, p: [qeqchi.imperative(i, k, p), qeqchi.imperative(i, k, p, True)])("imperative_kek")
goldens([("li inpunit wan", "linpunit wan"), ("li aak'aa", "laak'aa"), ("Li eerochoch", "Leerochoch"), ("li ixim", "li ixim")], "surface", "fused", lambda s: [qeqchi.fuse_possessives(s)])("possessive_fusion_kek")
goldens([("winq in wan", "winqin wan"), ("yo o.", "yoo."), ("o'laju winq", "o'laju winq"), ("moko xwil li winq ta.", "moko xwil ta li winq.")], "surface", "fused", lambda s: [qeqchi.move_ta(qeqchi.fuse_affixes(s))])("affix_fusion_kek")


@query(f"""SELECT id, CASE WHEN id = 'n2' THEN 'na''bej' WHEN id = 'n8' THEN 'ub''ej' ELSE lemma_kek END AS free, CASE WHEN regexp_matches(lemma_kek, '^[aeiou]') THEN 'w' ELSE 'in' END || lemma_kek AS mine FROM {lexicon.values('NOUN')}""")
def np_kek(spark, sf_dir):
    return lexicon.table(spark, "NOUN").select("id", qeqchi.free_noun(F.col("lemma_kek"), F.col("class")).alias("free"), qeqchi.possessed_noun(F.col("lemma_kek"), F.lit("1sg"), F.lit(False)).alias("mine"))


_PLURAL = "CASE WHEN {0} = 'man' THEN 'men' WHEN {0} = 'house' THEN 'houses' WHEN regexp_matches({0}, '(s|sh|ch|x|z)$') THEN {0} || 'es' WHEN regexp_matches({0}, '[^aeiou]y$') THEN left({0}, -1) || 'ies' ELSE {0} || 's' END"


@query(f"""SELECT id, 'the ' || gloss_en AS definite, CASE WHEN countability_en = 'mass' OR countability_en = 'plural' THEN 'my ' || gloss_en ELSE 'my ' || {_PLURAL.format('gloss_en')} END AS mine_many, CASE WHEN countability_en = 'mass' THEN 'some ' || gloss_en WHEN countability_en = 'plural' THEN 'two ' || gloss_en ELSE 'two ' || {_PLURAL.format('gloss_en')} END AS two FROM {lexicon.values('NOUN')}""")
def np_en(spark, sf_dir):
    n = constraints.enrich_nouns(lexicon.table(spark, "NOUN"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
    return n.select("id", english.noun_phrase(F.col("gloss_en"), F.col("gloss_en_f"), F.col("countability_en"), no, yes, none, none).alias("definite"),
                    english.noun_phrase(F.col("gloss_en"), F.col("gloss_en_f"), F.col("countability_en"), yes, no, F.lit("1sg"), none).alias("mine_many"), english.numeral_phrase(F.lit("two"), F.col("gloss_en"), F.col("countability_en")).alias("two"))


_PLURAL_ES = "CASE WHEN regexp_matches({0}, '[aeiouáéíóú]$') THEN {0} || 's' WHEN {0} LIKE '%z' THEN left({0}, -1) || 'ces' ELSE {0} || 'es' END"


@query(f"""SELECT id, CASE WHEN gender_es = 'f' THEN 'la ' ELSE 'el ' END || gloss_es AS definite, CASE WHEN countability_es = 'count' THEN CASE WHEN gender_es = 'f' THEN 'unas ' ELSE 'unos ' END || {_PLURAL_ES.format('gloss_es')} ELSE gloss_es END AS many,
CASE WHEN gender_es = 'f' THEN 'nuestra ' ELSE 'nuestro ' END || gloss_es AS ours, CASE WHEN countability_es = 'mass' THEN 'algo de ' || gloss_es WHEN countability_es = 'count' THEN 'dos ' || {_PLURAL_ES.format('gloss_es')} ELSE 'dos ' || gloss_es END AS two FROM {lexicon.values('NOUN')}""")
def np_es(spark, sf_dir):
    n = constraints.enrich_nouns(lexicon.table(spark, "NOUN"))
    yes, no, none = F.lit(True), F.lit(False), F.lit(None).cast("string")

    def phrase(many, definite, possessor):
        return spanish.noun_phrase(F.col("gloss_es"), F.col("gloss_es_f"), F.col("gender_es"), F.col("countability_es"), many, definite, possessor, none)

    return n.select("id", phrase(no, yes, none).alias("definite"), phrase(yes, no, none).alias("many"), phrase(no, yes, F.lit("1pl")).alias("ours"), spanish.numeral_phrase(F.lit("dos"), F.col("gloss_es"), F.col("gender_es"), F.col("countability_es")).alias("two"))


@query("SELECT doc_id, lang || ' on ' || source || '.' AS filled FROM documents")
def template_fill(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.fill(F.lit("{A} on {B}{C}."), F.create_map(F.lit("A"), F.col("lang"), F.lit("B"), F.col("source"))).alias("filled"))


# Rendering: rows follow hashes of lexicon rows through maps, which tests check by their properties

@query()
def render_triples(spark, sf_dir):
    return render.demo(spark, 200).select("template_id", "draw", "kek", "en", "es")


@query()
def render_annotated(spark, sf_dir):
    return render.annotate(render.demo(spark, 200))


@query()
def render_many(spark, sf_dir):
    return render.render_many(lambda n: render.demo(spark, n).drop("values", "template", "classes"), 60)


# Metrics

_W = "regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+|[^\\s\\p{{L}}\\p{{N}}]')"


def _bleu_sql(key: str) -> str:
    return f"""WITH b AS (SELECT conv_id * 1000 + turn AS id, {key} AS k, {_W.format('src_text')} AS h, {_W.format('tgt_text')} AS r FROM {_BITEXT}), o AS (SELECT unnest([1, 2, 3, 4]) AS n),
h AS (SELECT id, k, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM b, o WHERE len(h) >= n), r AS (SELECT id, k, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM b, o WHERE len(r) >= n),
hc AS (SELECT id, k, n, g, count(*) AS c FROM h GROUP BY ALL), rc AS (SELECT id, k, n, g, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT hc.k, hc.n, sum(hc.c) AS hyp, sum(least(hc.c, coalesce(rc.c, 0))) AS match FROM hc LEFT JOIN rc USING (id, k, n, g) GROUP BY ALL),
z AS (SELECT m.*, sum(CASE WHEN match = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY n) AS z FROM m), l AS (SELECT k, sum(len(h)) AS hyp_len, sum(len(r)) AS ref_len FROM b GROUP BY k),
s AS (SELECT k, sum(ln(CASE WHEN match > 0 THEN match / hyp ELSE 1 / (pow(2, z) * hyp) END)) / 4 AS s, min(CASE WHEN n = 1 THEN match END) AS m1 FROM z GROUP BY k)
SELECT k, round(CASE WHEN m1 = 0 THEN 0 ELSE 100 * CASE WHEN hyp_len < ref_len THEN exp(1 - ref_len / hyp_len) ELSE 1 END * exp(s) END, 4) AS bleu, CAST(hyp_len AS BIGINT) AS hyp_len, CAST(ref_len AS BIGINT) AS ref_len FROM l JOIN s USING (k)"""


def _scored(spark, sf_dir):
    return bitext.turn_pairs(_read(spark, sf_dir, "conversations")).withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))


@query(f"SELECT bleu, hyp_len, ref_len FROM ({_bleu_sql('1')})")
def bleu_corpus(spark, sf_dir):
    return metrics.bleu(_scored(spark, sf_dir), "src_text", "tgt_text", "id")


@query(f"SELECT k AS tgt_lang, bleu, hyp_len, ref_len FROM ({_bleu_sql('tgt_lang')})")
def bleu_by_group(spark, sf_dir):
    return metrics.bleu(_scored(spark, sf_dir), "src_text", "tgt_text", "id", ["tgt_lang"])


@query(f"""WITH b AS (SELECT conv_id * 1000 + turn AS id, string_split(regexp_replace(src_text, '\\s+', '', 'g'), '') AS h, string_split(regexp_replace(tgt_text, '\\s+', '', 'g'), '') AS r FROM {_BITEXT}), o AS (SELECT unnest([1, 2, 3, 4, 5, 6]) AS n),
h AS (SELECT id, n, unnest(list_transform(range(1, len(h) - n + 2), lambda i: array_to_string(h[i:i + n - 1], ' '))) AS g FROM b, o WHERE len(h) >= n), r AS (SELECT id, n, unnest(list_transform(range(1, len(r) - n + 2), lambda i: array_to_string(r[i:i + n - 1], ' '))) AS g FROM b, o WHERE len(r) >= n),
hc AS (SELECT id, n, g, count(*) AS c FROM h GROUP BY ALL), rc AS (SELECT id, n, g, count(*) AS c FROM r GROUP BY ALL), m AS (SELECT n, sum(least(hc.c, rc.c)) AS match FROM hc JOIN rc USING (id, n, g) GROUP BY n),
t AS (SELECT n, coalesce(match, 0) / hyp AS p, coalesce(match, 0) / ref AS r FROM (SELECT n, sum(c) AS hyp FROM hc GROUP BY n) JOIN (SELECT n, sum(c) AS ref FROM rc GROUP BY n) USING (n) LEFT JOIN m USING (n))
SELECT round(100 * 5 * avg(p) * avg(r) / (4 * avg(p) + avg(r)), 4) AS chrf FROM t""")
def chrf_corpus(spark, sf_dir):
    return metrics.chrf(_scored(spark, sf_dir), "src_text", "tgt_text", "id")


@query()
def ter_corpus(spark, sf_dir):
    return metrics.ter(_scored(spark, sf_dir), "src_text", "tgt_text", ["tgt_lang"])


@query(f"SELECT tgt_lang, count(*) FILTER (WHERE src_text = tgt_text) AS exact, count(*) AS n FROM {_BITEXT} GROUP BY tgt_lang")
def exact_match(spark, sf_dir):
    return _scored(spark, sf_dir).groupBy("tgt_lang").agg(F.count_if(F.col("src_text") == F.col("tgt_text")).alias("exact"), F.count("*").alias("n"))


_FOCAL = "pow(1 - exp(-l_tax * 20), 2.0) * l_tax * 20"


@query(f"""WITH e AS (SELECT l_orderkey, sum(CASE WHEN l_discount = 0 THEN 0 ELSE {_FOCAL} END) / greatest(count(*) FILTER (WHERE l_discount <> 0), 1) * max(CASE WHEN l_orderkey % 3 = 0 THEN 1.0 WHEN l_orderkey % 3 = 1 THEN 0.4 ELSE 0.8 END) AS x FROM lineitem GROUP BY l_orderkey) SELECT round(avg(x), 6) AS loss FROM e""")
def focal_loss_weighted(spark, sf_dir):
    k = F.col("l_orderkey") % 3
    return metrics.focal_per_example(_read(spark, sf_dir, "lineitem"), "l_orderkey", F.col("l_tax") * 20, F.col("l_discount") == 0, F.when(k == 0, 1.0).when(k == 1, 0.4).otherwise(0.8))


@query(f"SELECT round(avg(CASE WHEN l_discount = 0 THEN 0 ELSE {_FOCAL} END), 6) AS loss_all, round(sum(CASE WHEN l_discount = 0 THEN 0 ELSE {_FOCAL} END) / greatest(count(*) FILTER (WHERE l_discount <> 0), 1), 6) AS loss_counted FROM lineitem")
def focal_loss(spark, sf_dir):
    return metrics.focal_flat(_read(spark, sf_dir, "lineitem"), F.col("l_tax") * 20, F.col("l_discount") == 0)


# Logs and checkpoints

def _log(spark, sf_dir):
    five = F.concat_ws(",", F.round("value", 3).cast("string"), "user_id", F.lit("0.001"), F.lit("1"), "event_id")
    nine = F.concat_ws(",", F.lit("1.5"), F.lit("2"), F.lit("3"), F.lit("4"), F.lit("5"), F.lit("6"), F.lit("7"), F.lit("1"), "event_id")
    line = F.when(F.col("event_id") % 10 == 0, nine).when(F.col("event_id") % 10 == 1, "# comment").when(F.col("event_id") % 10 == 2, "").when(F.col("event_id") % 10 == 3, "1,2,x,4,5").otherwise(five)
    return _read(spark, sf_dir, "events").select(line.alias("value"))


@query("SELECT 'train' AS kind, event_id::DOUBLE AS step FROM events WHERE event_id % 10 > 3 UNION ALL SELECT 'eval', event_id FROM events WHERE event_id % 10 = 0")
def log_split(spark, sf_dir):
    train, evals = readers.training_log(_log(spark, sf_dir))
    return train.select(F.lit("train").alias("kind"), "step").unionByName(evals.select(F.lit("eval").alias("kind"), "step"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS smooth FROM events")
def rolling_smooth(spark, sf_dir):
    return metrics.smoothed(_read(spark, sf_dir, "events"), ["ts", "event_id"], "value", 10, ["user_id"]).select("event_id", "smooth")


@query("SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type")
def median_norm(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.median("value"), 6).alias("median"))


@query("SELECT 'checkpoint-' || user_id AS name, round(avg(value), 4) AS bleu FROM events GROUP BY user_id ORDER BY bleu DESC, name LIMIT 5")
def checkpoint_topk(spark, sf_dir):
    scored = _read(spark, sf_dir, "events").groupBy("user_id").agg(F.round(F.avg("value"), 4).alias("bleu"))
    return metrics.top_checkpoints(scored.select(F.concat(F.lit("checkpoint-"), F.col("user_id")).alias("name"), "bleu"), "bleu", "name")


@query("SELECT DISTINCT 'runs/' || CASE WHEN user_id % 5 = 0 THEN 'other-' ELSE 'checkpoint-' END || user_id AS path, user_id AS step FROM events WHERE user_id >= 20 AND user_id % 5 <> 0")
def checkpoint_filter(spark, sf_dir):
    paths = _read(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("runs/"), F.when(F.col("user_id") % 5 == 0, "other-").otherwise("checkpoint-"), F.col("user_id")).alias("path"))
    return readers.checkpoints(paths, "path", 20)


@query("SELECT text, min(doc_id // 100) AS batch FROM documents GROUP BY text")
def stream_dedup_batches(spark, sf_dir):
    """A file stream of documents, in whatever order its files come, passes on a text where no earlier file had it in as early a batch of ids; its batch is its first."""
    import tempfile
    import uuid

    from telar.streaming.dedup import append_new

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    root = f"{folder or tempfile.mkdtemp(prefix='telar-')}/stream-{uuid.uuid4().hex}"
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs.write.mode("overwrite").parquet(f"{root}/in")
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    append_new(stream.select("text", F.expr("doc_id div 100").alias("first")), "text", f"{root}/out", f"{root}/history", f"{root}/state", stop_after_empty=1 << 30, order="first")
    return spark.read.parquet(f"{root}/out").groupBy("text").agg(F.min("first").alias("batch"))


from telar.plans import goldens  # noqa: E402, F401  (registers its queries)
