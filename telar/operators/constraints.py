"""Semantic constraints of lexicon rows: classes, tenses, categories, and the theta joins that they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telar.functions.text import blank, split_list, split_set, strip

_NAMES = {"present": "prs", "past": "pst", "future": "fut", "progressive": "prg", "continuous": "prg", "perfect": "prf"}
HUMAN = ("human", "kinship", "occupation")
COLOURED = ("artifact", "building", "clothing", "food", "tool", "vehicle")
NOT_OWNED = tuple("abstract animal_wild celestial disease event human insect language mass measurement occupation phenomenon quantity season time weather".split())


def tense_code(c: Column) -> Column:
    low = F.lower(strip(c))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in _NAMES.items() for x in kv]), low), low)


def countability(c: Column) -> Column:
    v = F.lower(strip(blank(c)))
    return (F.when(v.isin("count", "countable", "c"), "countable").when(v.isin("mass", "uncountable", "unc", "noncount", "non-count"), "uncountable")
            .when(v.isin("plural", "plural-only", "plurale tantum", "plurale-tantum", "pl-only"), "plural-only").otherwise(v))


def possessability(noun_class: Column, not_owned: tuple[str, ...] = NOT_OWNED) -> Column:
    return F.when(noun_class.isin("kinship", "body_part"), "obligatory").when(noun_class.isin(*not_owned), "non-possessable").otherwise("optional")


def enrich_nouns(nouns: DataFrame) -> DataFrame:
    """Nouns with a normalised class, possessability, is_human, has_color, countability and loan."""
    cls = F.lower(strip(blank(F.col("class"))))
    out = nouns.withColumn("class", cls).withColumns({
        "possessability": possessability(F.col("class")),
        "is_human": F.when(F.col("class").isin(*HUMAN), "1").otherwise(F.when(blank(F.col("is_human")) == "", "0").otherwise(F.col("is_human"))),
        "has_color": F.when(F.col("class").isin(*COLOURED), "1").otherwise(F.when(blank(F.col("has_color")) == "", "0").otherwise(F.col("has_color"))),
        "loan": F.when(blank(F.col("loan")).isin("1", "true", "yes"), "1").otherwise("0")})
    return out.withColumns({c: countability(F.col(c)) for c in ("countability_kek", "countability_en", "countability_es") if c in nouns.columns})


def transitivity(c: Column) -> Column:
    return F.array_intersect(F.array_distinct(F.split(blank(c), r"[;,/| ]+")), F.array(*map(F.lit, ("intr", "tr", "ditr"))))


def verb_constraints(verbs: DataFrame) -> DataFrame:
    """Verbs with allow and ban sets of their agent, theme and goal; the goal's ban is read from either name of its column."""
    def of(*names: str) -> Column:
        there = [F.when(blank(F.col(n)) != "", F.col(n)) for n in names if n in verbs.columns]
        return split_set(F.coalesce(*there)) if there else F.array().cast("array<string>")

    return verbs.withColumns({f"{r}_{k}": of(*n) for r, k, *n in (
        ("agent", "allow", "agent_class_any_of"), ("agent", "ban", "agent_class_none_of"), ("theme", "allow", "theme_class_any_of"), ("theme", "ban", "theme_class_none_of"),
        ("goal", "allow", "goal_class_any_of"), ("goal", "ban", "goal_class_none_of", "goal_none_any_of", "goal_none_of"))})


def permits(allow: Column, ban: Column, value: Column) -> Column:
    return ((F.size(allow) == 0) | F.array_contains(allow, value)) & ~F.array_contains(ban, value)


def adjective_fits(adj: str = "a", noun: str = "n") -> Column:
    """Adjective and noun agree by class, and a colour goes with what has one."""
    a, n = (lambda c: F.col(f"{adj}.{c}")), (lambda c: F.col(f"{noun}.{c}"))
    lower = lambda xs: F.transform(xs, F.lower)
    colour = (F.lower(blank(a("adj_type"))) != "color") | F.lower(blank(n("has_color"))).isin("1", "true", "yes")
    return permits(lower(split_list(a("class_any_of"))), lower(split_list(a("class_none_of"))), F.lower(strip(n("class")))) & colour


def join_by_class(rows: DataFrame, dim: DataFrame, allow: str, ban: str, cls: str) -> DataFrame:
    """rows with each row of dim whose class its sets permit.

    Rows with an allow set meet dim by an equi-join on the class, rows without one by a product, which no join can narrow; bans filter both.
    """
    named = rows.filter(F.size(allow) > 0).withColumn("_allow", F.explode(F.array_distinct(allow))).join(dim, F.col("_allow") == F.col(cls)).drop("_allow")
    free = rows.filter(F.size(allow) == 0).crossJoin(dim)
    return named.unionByName(free).filter(~F.array_contains(ban, F.col(cls)))


def adverb_fits(tenses: Column, flags: Column, any_of: Column, none_of: Column, categories: Column) -> Column:
    """An adverb's tenses meet the active ones, and its category sets the verb's categories."""
    tense = (F.size(tenses) == 0) | F.arrays_overlap(tenses, flags)
    return tense & ((F.size(any_of) == 0) | (F.size(categories) == 0) | F.arrays_overlap(any_of, categories)) & ~F.coalesce(F.arrays_overlap(none_of, categories), F.lit(False))


def tense_flags(tokens: Column) -> Column:
    """Active tenses of a template's slots; the present where none is marked."""
    def has(mark: str) -> Column:
        return F.exists(tokens, lambda t: t.contains(mark))

    marked = F.array_compact(F.array(*[F.when(has(m), c) for m, c in (("_PST_", "pst"), ("_FUT_", "fut"), ("_PROG_", "prg"), ("_PP_", "prf"))]))
    return F.when(F.size(marked) == 0, F.array(F.lit("prs"))).otherwise(marked)


def has_slot(tokens: Column, name: str) -> Column:
    return F.exists(tokens, lambda t: (t == f"{{{name}}}") | t.startswith(f"{{{name}_"))


PLURAL_SUBJECTS = tuple(f"{{{n}_PL{s}}}" for n in ("NP", "POSS_NP", "AGENT_NP", "PRED_NP") for s in ("", "_EN", "_ES"))


def plural_subject(tokens: Column, person: Column) -> Column:
    return F.coalesce(F.lower(person).endswith("pl"), F.lit(False)) | F.arrays_overlap(tokens, F.array(*map(F.lit, PLURAL_SUBJECTS)))


def valid_roles(theme_id: Column, goal_id: Column, transitive: Column, ditransitive: Column, needs_theme: Column, needs_goal: Column, roles: list[tuple[Column, Column, Column]]) -> Column:
    """Whether a rendered sentence keeps its verb's frame: theme and goal differ, slots are filled, classes are permitted.

    roles: (class, allow, ban) of agent, theme and goal; an unfilled role has a NULL class and is not judged.
    """
    ok = ~F.coalesce(theme_id == goal_id, F.lit(False)) & ~(ditransitive & needs_goal & goal_id.isNull()) & ~(transitive & needs_theme & theme_id.isNull())
    for cls, allow, ban in roles:
        ok = ok & (cls.isNull() | permits(allow, ban, cls))
    return ok
