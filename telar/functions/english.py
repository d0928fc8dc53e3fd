"""English morphology as column expressions over literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telar.functions.text import blank, strip

PERSONS = ("1sg", "2sg", "3sg", "1pl", "2pl", "3pl")


def by_person(person: Column, forms: str, default: int = 2) -> Column:
    """The form of a person from six forms divided by bars; an unknown person is the third singular."""
    parts = [x.strip() for x in forms.split("|")]
    table = F.str_to_map(F.lit(";".join(f"{p}={f}" for p, f in zip(PERSONS, parts))), F.lit(";"), F.lit("="))
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(person))), F.lit(parts[default]))


def _rules(word: Column, *rules: tuple[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for pattern, form in reversed(rules):
        out = F.when(F.lower(word).rlike(pattern), form).otherwise(out)
    return out


def _less(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _with(word: Column, *ends: str | Column) -> Column:
    return F.concat(word, *[F.lit(e) if isinstance(e, str) else e for e in ends])


_CVC = "^[^aeiou]*[aeiou][^aeiouwxy]$"
_LAST = -1


def _last(word: Column) -> Column:
    return F.substring(word, _LAST, 1)


def present_3sg(base: Column) -> Column:
    w = strip(base)
    return F.when(w == "", w).otherwise(_rules(
        w, ("^be$", F.lit("is")), ("^have$", F.lit("has")), ("^do$", F.lit("does")), ("^go$", F.lit("goes")),
        ("(s|sh|ch|x|z|o)$", _with(w, "es")), ("[^aeiou]y$", _with(_less(w, 1), "ies")), otherwise=_with(w, "s")))


def past(base: Column) -> Column:
    """Regular past and participle."""
    w = strip(base)
    return F.when(w == "", w).otherwise(_rules(
        w, ("e$", _with(w, "d")), ("[^aeiou]y$", _with(_less(w, 1), "ied")), ("[aeiou]c$", _with(w, "ked")), (_CVC, _with(w, _last(w), "ed")), otherwise=_with(w, "ed")))


def ing(base: Column) -> Column:
    w = strip(base)
    return F.when(w == "", w).otherwise(_rules(
        w, ("ie$", _with(_less(w, 2), "ying")), ("(^|[^aeoy])e$", _with(_less(w, 1), "ing")), ("[aeiou]c$", _with(w, "king")), (_CVC, _with(w, _last(w), "ing")), otherwise=_with(w, "ing")))


#: Irregular plurals, singular and plural by turns.
_PLURALS = """deer=deer; goose=geese; mouse=mice; ox=oxen; sheep=sheep; tooth=teeth; foot=feet; ear of corn=ears of corn; man=men; woman=women;
child=children; person=people; young man=young men; lonely person=lonely people; short person=short people; brother-in-law=brothers-in-law;
sister-in-law=sisters-in-law; son-in-law=sons-in-law; daughter-in-law=daughters-in-law; wife=wives; countryman=countrymen; cactus=cacti"""
IRREGULAR_PLURALS = dict(tuple(p.strip() for p in x.split("=")) for x in _PLURALS.split(";"))


def plural(noun: Column) -> Column:
    w = strip(noun)
    table = F.create_map(*[F.lit(x) for kv in IRREGULAR_PLURALS.items() for x in kv])
    regular = _rules(w, ("(s|sh|ch|x|z)$", _with(w, "es")), ("[^aeiou]y$", _with(_less(w, 1), "ies")), otherwise=_with(w, "s"))
    return F.when(w == "", w).otherwise(F.coalesce(F.try_element_at(table, F.lower(w)), regular))


def article(base: Column) -> Column:
    return F.when(base.rlike("^[aeiouAEIOU]"), "an").otherwise("a")


def subject_pronoun(person: Column, gender: Column) -> Column:
    third = F.lower(F.trim(person)) == "3sg"
    return F.when(third & (F.lower(F.trim(gender)) == "f"), "she").otherwise(by_person(person, "I|you|he|we|you|they"))


def agent_by(person: Column, gender: Column) -> Column:
    third = F.lower(F.trim(person)) == "3sg"
    return F.when(third & (F.lower(F.trim(gender)) == "f"), "by her").otherwise(by_person(person, "by me|by you|by him|by us|by you|by them"))


def noun_phrase(gloss: Column, gloss_f: Column, countability: Column, is_plural: Column, definite: Column, possessor: Column, gender: Column) -> Column:
    """Possessed, definite, bare plural, bare mass or a(n) noun phrase; a feminine gloss where asked for and known."""
    m, f = strip(blank(gloss)), strip(blank(gloss_f))
    base = F.when(((F.lower(gender) == "f") & (f != "")) | (m == ""), f).otherwise(m)
    kind = F.lower(strip(blank(countability)))
    form = F.when(is_plural & (kind == "countable"), plural(base)).otherwise(base)
    return (F.when(base == "", "")
            .when(possessor.isNotNull() & (possessor != ""), F.concat_ws(" ", by_person(possessor, "my|your|his|our|your|their", 0), form))
            .when(definite, F.concat(F.lit("the "), form)).when(is_plural, form).when(kind.isin("uncountable", "plural-only"), form)
            .otherwise(F.concat_ws(" ", article(form), form)))


def numeral_phrase(numeral: Column, gloss: Column, countability: Column) -> Column:
    n, base, kind = strip(blank(numeral)), strip(blank(gloss)), F.lower(strip(blank(countability)))
    return (F.when((n == "") | (base == ""), F.trim(F.concat_ws(" ", n, base))).when(F.lower(n).isin("1", "one"), F.concat_ws(" ", n, base))
            .when(kind == "uncountable", F.concat(F.lit("some "), base)).when(kind == "plural-only", F.concat_ws(" ", n, base)).otherwise(F.concat_ws(" ", n, plural(base))))


def comparative(gloss: Column, flag: Column) -> Column:
    base, how = F.lower(strip(blank(gloss))), F.lower(strip(blank(flag)))
    er = _rules(base, ("[^aeo]y$|^y$", _with(_less(base, 1), "ier")), ("^[^aeiou]*[aeiou][bcdfghjklmnpqrstvwxyz]$", _with(base, _last(base), "er")), otherwise=_with(base, "er"))
    more = F.concat(F.lit("more "), base)
    return (F.when(base == "", "").when(~how.isin("", "er", "more"), how).when(how == "more", more).when(how == "er", er)
            .when((F.length(base) <= 5) & ~base.contains(" "), er).otherwise(more))


def imperative(base: Column, person: Column) -> Column:
    w = strip(base)
    return F.when(w == "", w).when(F.lower(F.trim(person)) == "1pl", F.concat(F.lit("let's "), w)).otherwise(w)


def directive(base: Column, person: Column) -> Column:
    """Struct of the affirmative and the negative directive."""
    w, p = strip(base), F.lower(F.trim(person))
    should = p.isin("1sg", "3sg", "3pl")
    yes = F.when(w == "", "").when(should, F.concat(F.lit("should "), w)).otherwise(imperative(w, p))
    no = F.when(w == "", "").when(should, F.concat(F.lit("shouldn't "), w)).when(p == "1pl", F.concat(F.lit("let's not "), w)).otherwise(F.concat(F.lit("don't "), w))
    return F.struct(yes.alias("affirmative"), no.alias("negative"))


#: Auxiliary slots, six persons each.
AUXILIARIES = {
    "BE_EN": "am|are|is|are|are|are", "BE_PST_EN": "was|were|was|were|were|were", "BE_FUT_EN": "|".join(["will be"] * 6),
    "BE_NEG_EN": "am not|are not|is not|are not|are not|are not", "BE_NEG_CT_EN": "am not|aren’t|isn’t|aren’t|aren’t|aren’t",
    "HAVE_EN": "have|have|has|have|have|have", "HAVE_PST_EN": "|".join(["had"] * 6), "HAVE_FUT_EN": "|".join(["will have"] * 6),
    "HAVE_NEG_EN": "haven’t|haven’t|hasn’t|haven’t|haven’t|haven’t", "DO_AFF_EN": "do|do|does|do|do|do", "DO_NEG_EN": "don’t|don’t|doesn’t|don’t|don’t|don’t",
    "DO_PST_EN": "|".join(["did"] * 6), "DO_NEG_PST_EN": "|".join(["didn’t"] * 6), "WILL_EN": "|".join(["will"] * 6), "WILL_NEG_EN": "|".join(["will not"] * 6),
}


def slot_map(forms: dict[str, Column], wanted: set[str] | None) -> Column:
    """Map of the forms, or of those that are wanted."""
    kept = [(k, v) for k, v in forms.items() if wanted is None or k in wanted]
    return F.create_map(*[x for k, v in kept for x in (F.lit(k), v)]) if kept else F.create_map().cast("map<string,string>")


def verb_bundle(prefix: str, gloss: Column, gloss_past: Column, gloss_pp: Column, person: Column, imperative_person: Column, wanted: set[str] | None = None) -> Column:
    """Map of the slots that a verb fills: its own forms and the auxiliaries."""
    base = strip(blank(gloss))
    own, own_pp = strip(blank(gloss_past)), strip(blank(gloss_pp))
    forms = {
        "EN": F.when(F.lower(F.trim(person)) == "3sg", present_3sg(base)).otherwise(base), "BASE_EN": base,
        "PST_EN": F.when(own != "", own).otherwise(past(base)), "PP_EN": F.when(own_pp != "", own_pp).otherwise(past(base)),
        "PROG_EN": ing(base), "IMP_EN": imperative(base, imperative_person),
    }
    items = [(f"{prefix}_{k}", v) for k, v in forms.items()] + [(k, by_person(person, v)) for k, v in AUXILIARIES.items()]
    return slot_map(dict(items), wanted)


def place_adjective(phrase: Column, adjective: Column) -> Column:
    """The adjective after a leading determiner, or in front."""
    determiner = r"^(?i)(the|an?|this|that|these|those|my|your|our|their|his|her|its)\s+"
    return F.when(phrase.rlike(determiner), F.regexp_replace(phrase, r"^(\S+)\s+(.*)$", F.concat(F.lit("$1 "), adjective, F.lit(" $2")))).otherwise(F.concat_ws(" ", adjective, phrase))
