"""A small lexicon and templates of our own, for queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOUNS = [
    ("n1", "winq", "man", None, "hombre", None, "m", " Human ", "count", "count", "count", None, None, "0", 5),
    ("n2", "na'", "mother", None, "madre", None, "f", "kinship", "count", "count", "count", "", "", "0", 4),
    ("n3", "ixim", "corn", None, "maíz", None, "m", "corn", "mass", "mass", "mass", "0", "1", "no", 6),
    ("n4", "tz'i'", "dog", None, "perro", "perra", "m", "animal_domesticated", "c", "countable", "count", "", "", "0", 3),
    ("n5", "punit", "hat", None, "sombrero", None, "m", "clothing", "count", "count", "count", "", "", "1", 2),
    ("n6", "hix", "jaguar", None, "jaguar", None, "m", "animal_wild", "count", "count", "count", "", "", "", 1),
    ("n7", "ochoch", "house", None, "casa", None, "f", "building", "count", "count", "count", "", "", "0", 3),
    ("n8", "u", "face", None, "cara", None, "f", "body_part", "count", "count", "count", "", "", "0", 1),
    ("n9", "kutank", "day", None, "día", None, "m", "time", "count", "count", "count", "", "", "yes", 2),
    ("n10", "hu", "scissors", None, "tijeras", None, "f", "tool", "plural", "plural", "plural-only", "", "", "true", 1),
    ("n11", "aj k'ay", "actor", "actress", "actor", "actriz", "m", "occupation", "count", "count", "count", "", "", "0", 2),
]
NOUN_SCHEMA = "id string, lemma_kek string, gloss_en string, gloss_en_f string, gloss_es string, gloss_es_f string, gender_es string, class string, countability_kek string, countability_en string, countability_es string, is_human string, has_color string, loan string, p_weight int"
VERBS = [
    ("v1", "il", "ilok", "see", "saw", "seen", "ver", "v_perception", "tr", "human; kinship", "", "", "body_part", "", "", 4),
    ("v2", "tzaka", "tzakank", "eat", "ate", "eaten", "comer", "v_action | v_food", "tr", "human, animal_domesticated", "building", "corn; fruit", "", "", "", 5),
    ("v3", "wark", "wark", "sleep", "slept", "slept", "dormir", "v_state ", "intr", "human/kinship/animal_domesticated", "", "", "", "", "", 3),
    ("v4", "xik", "xik", "go", "went", "gone", "ir", "v_motion", "intr", "", "building", "", "", "", "", 2),
    ("v5", "k'e", "k'ehok", "give", "gave", "given", "dar", "v_transfer", "ditr", "human", "", "clothing|tool", "", "human;kinship", "animal_wild", 2),
    ("v6", "loq'", "loq'ok", "buy", "bought", "bought", "comprar", "v_commerce", "tr ditr", "human occupation", "", "", "human kinship", "", "", 3),
    ("v7", "ch'aj", "ch'ajok ib’", "wash", "", "", "lavarse", "v_action", "intr", "human", "", "", "", "", "", 1),
    ("v8", "b'eresi", "b'eresink", "carry", "", "", "conducir", "v_motion", "tr;bad", "", "celestial", "", "", "", "", 0),
]
VERB_SCHEMA = "id string, lemma_kek string, gloss_kek string, gloss_en string, gloss_en_past string, gloss_en_pp string, gloss_es string, category string, transitivity string, agent_class_any_of string, agent_class_none_of string, theme_class_any_of string, theme_class_none_of string, goal_class_any_of string, goal_none_of string, p_weight int"
ADJECTIVES = [
    ("a1", "kaq", "red", "", "rojo", "ser", "color", "", "", 3), ("a2", "nim", "big", "er", "grande", "ser", "size", "", "time", 4),
    ("a3", "chaab'il", "good", "better", "bueno", "either", "quality", "", "", 5), ("a4", "tiq", "hot", "", "caliente", "estar", "temperature", "corn; body_part", "", 2),
    ("a5", "ruuk", "happy", "", "feliz", " Estar ", "emotion", "human;kinship", "", 1), ("a6", "ch'ina'us", "beautiful", "", "hermoso", "", "quality", "", "animal_wild", 2),
]
ADJECTIVE_SCHEMA = "id string, lemma_kek string, gloss_en string, comp_en string, gloss_es string, copula_es string, adj_type string, class_any_of string, class_none_of string, p_weight int"
ADVERBS = [
    ("d1", "hulaj", "tomorrow", "mañana", "time", "", "", "fut", 2), ("d2", "anaqwan", "now", "ahora", "time", "", "v_state", "prs | fut", 3),
    ("d3", "ewer", "yesterday", "ayer", "time", "", "", "past", 2), ("d4", "timil", "slowly", "despacio", "manner", "v_motion; v_action", "", "", 1),
    ("d5", "junelik", "always", "siempre", "frequency", "v_food|v_state", "", "present, progressive", 2),
]
ADVERB_SCHEMA = "id string, lemma_kek string, gloss_en string, gloss_es string, category string, class_any_of string, class_none_of string, tense_compat string, p_weight int"
NUMERALS = [("jun", "one", "uno", 1), ("wiib'", "two", "dos", 2), ("oxib'", "three", "tres", 3), ("o'laju", "fifteen", "quince", 15)]
NUMERAL_SCHEMA = "lemma_kek string, gloss_en string, gloss_es string, value int"
TEMPLATES = [
    (1, "{V_TR} {THEME_NP} {NP}", "{NP_EN} {V_TR_EN} {THEME_NP_EN}.", "{NP_ES} {V_TR_ES} {THEME_NP_ES}.", "3sg", 40),
    (2, "{V_INTR_PST} {NP}", "{NP_EN} {V_INTR_PST_EN}.", "{NP_ES} {V_INTR_PST_ES}.", "3sg", 25),
    (3, "{NEG_PRE} {V_TR_FUT} {NEG_SUF} {THEME_NP} {SUBJ_PRONOUN}", "{SUBJ_PRONOUN_EN} {WILL_NEG_EN} {V_TR_BASE_EN} {THEME_NP_EN}.", "{SUBJ_PRONOUN_ES} no {V_TR_FUT_ES} {THEME_NP_ES}.", "1pl", 20),
    (4, "{V_TR_PROG_FUT} {THEME_NP_PL}", "{SUBJ_PRONOUN_EN} {BE_FUT_EN} {V_TR_PROG_EN} {THEME_NP_EN_PL}", "{SUBJ_PRONOUN_ES} {V_TR_FUT_PROG_ES} {THEME_NP_ES_PL}", "2sg", 10),
    (5, "{ADJ} {NP} {UNKNOWN}", "{NP_EN} {BE_EN} {ADJ_EN}.", "{NP_ES} {COP_ES} {ADJ_ES}.", "3sg", 5),
    (6, "{V_TR} {NUM_THEME_NP} {SUBJ_PRONOUN}", "{SUBJ_PRONOUN_EN} {V_TR_EN} {NUM_THEME_NP_EN}.", "{SUBJ_PRONOUN_ES} {V_TR_ES} {NUM_THEME_NP_ES}.", "3pl", 0),
]
TEMPLATE_SCHEMA = "id int, kek string, en string, es string, person string, weight int"


def table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(globals()[f"{name}S"], globals()[f"{name}_SCHEMA"])


def values(name: str) -> str:
    """The rows as an SQL subquery with the table's columns."""
    def lit(x: object) -> str:
        return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)

    columns = ", ".join(c.split()[0] for c in globals()[f"{name}_SCHEMA"].split(", "))
    rows = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in globals()[f"{name}S"])
    return f"(SELECT * FROM (VALUES {rows}) AS t({columns}))"
