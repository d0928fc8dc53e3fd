"""Q'eqchi' morphology as column expressions over literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telar.functions.english import by_person, slot_map
from telar.functions.text import blank, is_vowel_initial, strip

#: Forms of six persons divided by bars: singular 1 to 3, plural 1 to 3.
SUBJECTS = "laa'in|laa'at|a'an|laa'o|laa'ex|heb'a'an"
AFFIXES = "in|at||o|ex|eeb'"
REFLEXIVES = "wib’|aawib’|rib’|qib’|eerib’|rib’eb"
SET_A = {False: "in|aa|x|qa|ee|e'x", True: "w|aa|r|q|eer|e'r"}
SET_B = "in|at||oo|ex|e'"
PRESENT = "nakin|nakat|na|nako|nakex|nake'"
FUTURE_A = {False: "tin|taa|tix|taqa|tee|te'x", True: "tinw|taaw|tar|taaqa|teer|te'r"}
FUTURE_B = "tin|tat|taa|too|tex|te'"
IMPERATIVE = {
    ("intr", True): "chin|chat|ch|cho’|chee’|che’", ("intr", False): "chin|chat|chi|cho|chee|che’",
    ("tr", True): "chiw|chaaw|chir|chiq|cheer|che’r", ("tr", False): "chin|chaa|chix|chiqa|cheeb’|che’x",
}
FORBID_INTR = "min|mat|ma|mako’|mex|make’"
FORBID_TR = {False: "min|maa|mix|miqa|mee|make’x", True: "miw|maaw|mir|miq|meer|me’r"}
PROGRESSIVE = "yookin|yookat|yoo|yooko|yookex|yookeb’"
PROGRESSIVE_FUTURE = "yooqin|yooqat|yoo|yooqo|yooqex|yooqeb’"
WITH = "wik'in|aawik'in|rik'in|qik'in|eerik'in|rik'ineb'"
BY = "inb'aan|aa'baan|x'baan|qa'baan|eeb'aan|xb'aaneb"
PERFECTIVE = "x"
#: Nouns whose free form is irregular.
FREE_FORMS = "na'=na'bej tat=tatej chi'=chi'bej q'ab'=q'ab' wi'=wi'b'ej kok=kokb'ej xkool=xkoolb'ej b'och=b'och'b'ej b'aq=b'aqb'ej tzo'm=tzo'mb'ej xpe'=xpe'b'ej"
PLACEHOLDERS = "NEG_PRE=Moko;NEG_SUF=ta;YN_Q_MARKER=Ma;WH=K'a'ut;WH_LOC=B'ar;WH_TIME=Jo’q'e;EXIST=Wan;EXIST_PL=Wankeb';COMP=chi ru;BENEF_REL=;GOAL_REL="


def placeholders() -> Column:
    return F.create_map(*[F.lit(x) for kv in PLACEHOLDERS.split(";") for x in kv.split("=")])


def join(root: Column, suffix: str) -> Column:
    """Root and suffix, with one apostrophe where both bring one."""
    if not suffix.startswith("'"):
        return F.concat(root, F.lit(suffix))
    return F.when(root.rlike("['’]$"), F.concat(root, F.lit(suffix[1:]))).otherwise(F.concat(root, F.lit(suffix)))


def name_surface(text: Column, gender: Column) -> Column:
    return F.when(gender == "m", F.concat(F.lit("laj "), text)).when(gender == "f", F.concat(F.lit("li x"), text)).otherwise(text)


def free_noun(lemma: Column, noun_class: Column) -> Column:
    """A noun without possessor; kinship and body-part nouns take a suffix."""
    w = strip(lemma)
    table = F.create_map(*[F.lit(x) for kv in FREE_FORMS.split() for x in kv.split("=", 1)])
    suffixed = F.when(is_vowel_initial(w), join(w, "b'ej")).otherwise(join(w, "'ej"))
    return F.when(w == "", w).otherwise(F.coalesce(F.try_element_at(table, w), F.when(strip(blank(noun_class)).isin("kinship", "body_part"), suffixed).otherwise(w)))


def _set_a(person: Column, vowel: Column) -> Column:
    return F.when(vowel, by_person(person, SET_A[True])).otherwise(by_person(person, SET_A[False]))


def possessed_noun(lemma: Column, person: Column, definite: Column) -> Column:
    """The possessed noun, with the article where definite; a third plural possessor adds no prefix here, but eb' elsewhere."""
    w = strip(lemma)
    prefix = F.when(F.lower(person) == "3pl", "").otherwise(_set_a(person, is_vowel_initial(w)))
    return F.when(w == "", w).when(definite, F.concat(F.lit("li "), prefix, w)).otherwise(F.concat(prefix, w))


def fuse_possessives(sentence: Column) -> Column:
    """The article li and a prefix that begins with a vowel, written as one word."""
    s = F.regexp_replace(sentence, r"(?<!\S)(L|l)i in(?=\p{L})", "$1in")
    s = F.regexp_replace(s, r"(?<!\S)(L|l)i aa(?=\p{L})", "$1aa")
    return F.regexp_replace(s, r"(?<!\S)(L|l)i ee(?=r?\p{L})", "$1ee")


def fuse_affixes(sentence: Column) -> Column:
    """Affix pronouns that stand alone, written onto the word before; longer words that begin alike stay."""
    return F.regexp_replace(sentence, r"(\S)\s+(in|at|ex|eeb'|eb'|o)(?=[\s.,!?;:]|$)", "$1$2")


def move_ta(sentence: Column) -> Column:
    """The particle ta directly after the first word that follows moko; closing marks stay at the end."""
    return F.regexp_replace(sentence, r"(?i)\b(moko) ([^\s.,!?;:]+)((?: [^\s.,!?;:]+)+?) ta(?=[\s.,!?;:]|$)", "$1 $2 ta$3")


def plural_phrase(phrase: Column, before: Column) -> Column:
    """A phrase with the plural particle before or after."""
    return F.when(before, F.concat(F.lit("eb' "), phrase)).otherwise(F.concat(phrase, F.lit(" eb'")))


def noun_phrase(lemma: Column, noun_class: Column, definite: Column, is_plural: Column, before: Column, possessor: Column) -> Column:
    owned = possessor.isNotNull() & (possessor != "")
    base = F.when(owned, possessed_noun(lemma, possessor, definite)).when(definite, F.concat(F.lit("li "), free_noun(lemma, noun_class))).otherwise(free_noun(lemma, noun_class))
    return F.when(strip(lemma) == "", "").when(is_plural, plural_phrase(base, before)).otherwise(base)


def numeral_phrase(numeral: Column, lemma: Column, noun_class: Column) -> Column:
    return F.trim(F.concat_ws(" ", strip(blank(numeral)), free_noun(lemma, noun_class)))


def is_reflexive(infinitive: Column) -> Column:
    return strip(blank(infinitive)).rlike("ib['’]$")


def without_reflexive(infinitive: Column) -> Column:
    return F.regexp_replace(strip(blank(infinitive)), r"\s*(?:ib['’]|['’]ib)$", "")


def reflexive(form: Column, person: Column, really: Column) -> Column:
    return F.when(really & (form != ""), F.concat_ws(" ", form, by_person(person, REFLEXIVES))).otherwise(form)


def intransitive(stem: Column, person: Column, tam: str = "") -> Column:
    s = strip(stem)
    return F.when(s == "", "").otherwise(F.concat(by_person(person, PRESENT), s) if not tam else F.concat(F.lit(tam), by_person(person, SET_B), s))


def conjugate(base: Column, transitivity: Column, person: Column, object_person: Column, tam: str = "") -> Column:
    """Aspect, subject and object prefixes and the stem; transitive third plural adds a suffix."""
    s = strip(base)
    suffix = F.when(F.lower(person) == "3pl", "eb’").otherwise("")
    obj = F.when(object_person.isNull() | (object_person == ""), "").otherwise(by_person(object_person, SET_B))
    transitive = F.concat(F.lit(tam), _set_a(person, is_vowel_initial(s)), obj, s, suffix)
    return F.when(s == "", s).when(F.lower(transitivity).isin("tr", "ditr"), transitive).otherwise(intransitive(s, person, tam))


def future(stem: Column, transitivity: Column, person: Column) -> Column:
    """Future prefixes; a final k becomes q, but in xik."""
    s = F.when(strip(stem) == "xik", "xik").otherwise(F.regexp_replace(strip(stem), "k$", "q"))
    vowel = s.rlike("^[aeiouáéíóúAEIOU']")
    prefix = F.when(F.lower(transitivity) == "intr", by_person(person, FUTURE_B)).when(vowel, by_person(person, FUTURE_A[True])).otherwise(by_person(person, FUTURE_A[False]))
    return F.when(s == "", "").otherwise(F.concat(prefix, s))


def imperative(infinitive: Column, transitivity: Column, person: Column, negative: bool = False) -> Column:
    """Order or ban from the infinitive; NULL where there is none."""
    s = strip(infinitive)
    vowel, intr = is_vowel_initial(s), F.lower(transitivity) == "intr"
    if negative:
        pick = F.when(intr, by_person(person, FORBID_INTR, 1)).when(vowel, by_person(person, FORBID_TR[True], 1)).otherwise(by_person(person, FORBID_TR[False], 1))
        pick = F.when(intr & (pick == "ma") & s.rlike("^['’]*[aA]"), "ma'").otherwise(pick)
    else:
        def table(kind: str) -> Column:
            return F.when(vowel, by_person(person, IMPERATIVE[kind, True], 1)).otherwise(by_person(person, IMPERATIVE[kind, False], 1))

        pick = F.when(intr, table("intr")).otherwise(table("tr"))
    return F.when(s != "", F.concat(pick, s))


def progressive(infinitive: Column, person: Column, future_: bool = False) -> Column:
    return F.concat_ws(" ", by_person(person, PROGRESSIVE_FUTURE if future_ else PROGRESSIVE), F.lit("chi"), F.when(is_reflexive(infinitive), without_reflexive(infinitive)).otherwise(strip(infinitive)))


def with_pronoun(person: Column) -> Column:
    return by_person(person, WITH)


def agent_by(person: Column) -> Column:
    return by_person(person, BY)


def verb_bundle(prefix: str, lemma: Column, infinitive: Column, transitivity: Column, person: Column, object_person: Column, imperative_person: Column, wanted: set[str] | None = None) -> Column:
    """Map of the slots that a verb fills; transitive verbs build on the stem, intransitive ones on the infinitive."""
    really = is_reflexive(infinitive)
    bare = F.when(really, without_reflexive(infinitive)).otherwise(strip(infinitive))
    base = F.when(F.lower(transitivity) == "intr", bare).otherwise(strip(lemma))

    def own(form: Column, who: Column = person) -> Column:
        return reflexive(F.coalesce(form, F.lit("")), who, really)

    forms = {
        "": own(conjugate(base, transitivity, person, object_person, "" )), "_PST": own(conjugate(base, transitivity, person, object_person, PERFECTIVE)),
        "_FUT": own(future(base, transitivity, person)), "_PROG": own(progressive(infinitive, person)), "_FUT_PROG": own(progressive(infinitive, person, True)),
        "_PROG_FUT": own(progressive(infinitive, person, True)), "_IMP": own(imperative(bare, transitivity, imperative_person), imperative_person),
        "_IMP_NEG": own(imperative(bare, transitivity, imperative_person, True), imperative_person),
        "_PASS": F.concat(F.lit("na"), strip(lemma), F.lit("man")), "_PST_PASS": F.concat(F.lit("x"), strip(lemma), F.lit("man")), "_FUT_PASS": F.concat(F.lit("taa"), strip(lemma), F.lit("maq")),
    }
    return slot_map({prefix + k: v for k, v in forms.items()}, wanted)
