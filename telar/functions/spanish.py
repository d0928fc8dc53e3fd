"""Spanish morphology as column expressions over literal tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from telar.functions.english import PERSONS, by_person, slot_map
from telar.functions.text import blank, strip

#: Irregular presents, one verb a line: infinitive and six forms.
PRESENT = """
caber quepo cabes cabe cabemos cabéis caben
caer caigo caes cae caemos caéis caen
conducir conduzco conduces conduce conducimos conducís conducen
conocer conozco conoces conoce conocemos conocéis conocen
dar doy das da damos dais dan
decir digo dices dice decimos decís dicen
dormir duermo duermes duerme dormimos dormís duermen
estar estoy estás está estamos estáis están
hacer hago haces hace hacemos hacéis hacen
haber he has ha hemos habéis han
ir voy vas va vamos vais van
jugar juego juegas juega jugamos jugáis juegan
oír oigo oyes oye oímos oís oyen
pedir pido pides pide pedimos pedís piden
pensar pienso piensas piensa pensamos pensáis piensan
poder puedo puedes puede podemos podéis pueden
poner pongo pones pone ponemos ponéis ponen
querer quiero quieres quiere queremos queréis quieren
salir salgo sales sale salimos salís salen
saber sé sabes sabe sabemos sabéis saben
ser soy eres es somos sois son
tener tengo tienes tiene tenemos tenéis tienen
traer traigo traes trae traemos traéis traen
valer valgo vales vale valemos valéis valen
venir vengo vienes viene venimos venís vienen
ver veo ves ve vemos veis ven"""
#: Strong preterites by stem; those in j lose the i of the third plural.
_STRONG = "andar=anduv caber=cup decir=dij haber=hub poner=pus poder=pud querer=quis saber=sup tener=tuv traer=traj venir=vin conducir=conduj introducir=introduj producir=produj reducir=reduj traducir=traduj"
PRETERITE = "\n".join(
    " ".join([v, *(s + e for e in ("e", "iste", "o", "imos", "isteis", "eron" if s.endswith("j") else "ieron"))]) for v, s in (x.split("=") for x in _STRONG.split())
) + """
dar di diste dio dimos disteis dieron
hacer hice hiciste hizo hicimos hicisteis hicieron
ir fui fuiste fue fuimos fuisteis fueron
ser fui fuiste fue fuimos fuisteis fueron
ver vi viste vio vimos visteis vieron
vestir vestí vestiste vistió vestimos vestisteis vistieron"""
SUBJUNCTIVE = """
ser sea seas sea seamos seáis sean
ir vaya vayas vaya vayamos vayáis vayan
estar esté estés esté estemos estéis estén
haber haya hayas haya hayamos hayáis hayan
saber sepa sepas sepa sepamos sepáis sepan
dar dé des dé demos deis den"""
_GERUNDS = "ir=yendo poder=pudiendo leer=leyendo"
_PARTICIPLES = "abrir=abierto cubrir=cubierto decir=dicho escribir=escrito hacer=hecho morir=muerto poner=puesto romper=roto ver=visto volver=vuelto"
_COMMANDS = "venir=ven hacer=haz decir=di poner=pon salir=sal tener=ten ir=ve ser=sé"
_ENDS = {
    "present": {"ar": "o|as|a|amos|áis|an", "er": "o|es|e|emos|éis|en", "ir": "o|es|e|imos|ís|en"},
    "preterite": {"ar": "é|aste|ó|amos|asteis|aron", "er": "í|iste|ió|imos|isteis|ieron", "ir": "í|iste|ió|imos|isteis|ieron"},
    "subjunctive": {"ar": "e|es|e|emos|éis|en", "er": "a|as|a|amos|áis|an", "ir": "a|as|a|amos|áis|an"},
}
CLITICS = "me|te|se|nos|os|se"


def _table(text: str) -> Column:
    """Map of 'infinitive person' to a form."""
    rows = [line.split() for line in text.strip().splitlines()]
    return F.str_to_map(F.lit(";".join(f"{v} {p}={f}" for v, *forms in rows for p, f in zip(PERSONS, forms))), F.lit(";"), F.lit("="))


def _pairs(text: str) -> Column:
    return F.str_to_map(F.lit(text), F.lit(" "), F.lit("="))


def _let(value: Column, fn) -> Column:
    """fn of a value that is computed once, however often fn uses it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def person_code(label: Column) -> Column:
    """Code of a person or of a Spanish pronoun; the third singular where unknown."""
    p = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    names = "yo=1sg tú=2sg tu=2sg nosotros=1pl vosotros=2pl ustedes=3pl " + " ".join(f"{x}={x}" for x in PERSONS)
    return F.coalesce(F.try_element_at(_pairs(names), p), F.lit("3sg"))


def _finite(person: Column) -> Column:
    """The person of verb endings: the second plural is addressed as ustedes."""
    return F.when(person == "2pl", "3pl").otherwise(person)


def split_reflexive(infinitive: Column) -> tuple[Column, Column]:
    low = F.lower(strip(blank(infinitive)))
    really = low.rlike("...se$")
    return F.when(really, F.regexp_replace(low, "se$", "")).otherwise(low), really


def _endings(kind: str, base: Column, person: Column) -> Column:
    out = F.lit(None).cast("string")
    for end, forms in _ENDS[kind].items():
        out = F.when(base.endswith(end), by_person(person, forms)).otherwise(out)
    return out


def _root(base: Column) -> Column:
    return F.regexp_replace(base, "(ar|er|ir)$", "")


def _yo(base: Column) -> Column:
    """First singular present: -zco after c, -jo after g."""
    regular = F.concat(_root(base), F.lit("o"))
    return F.when(base.rlike(".c[ei]r$"), F.regexp_replace(base, "c[ei]r$", "zco")).when(base.rlike(".g[ei]r$"), F.regexp_replace(base, "g[ei]r$", "jo")).otherwise(regular)


def _plain(kind: str, base: Column, person: Column) -> Column:
    p = F.when(person == "2pl", "3pl").otherwise(person)
    regular = F.coalesce(F.concat(_root(base), _endings(kind, base, p)), base)
    if kind == "present":
        regular = F.when((p == "1sg") & base.rlike("(ar|er|ir)$"), _yo(base)).otherwise(regular)
        irregular = PRESENT
    else:
        e = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, "car$", "qué"), "gar$", "gué"), "zar$", "cé")
        regular = F.when((p == "1sg") & base.rlike("(c|g|z)ar$"), e).otherwise(regular)
        irregular = PRETERITE
    return F.coalesce(F.try_element_at(_table(irregular), F.concat_ws(" ", base, p)), regular)


def _clitic(person: Column, really: Column, form: Column) -> Column:
    return F.concat_ws(" ", F.when(really, by_person(person, CLITICS)), form)


def _parts(infinitive: Column, person: Column, fn) -> Column:
    """fn(base, is_reflexive, person), each computed once."""
    base, really = split_reflexive(infinitive)
    return _let(F.struct(base.alias("b"), really.alias("r"), person_code(person).alias("p")), lambda x: fn(x["b"], x["r"], x["p"]))


def present(infinitive: Column, person: Column) -> Column:
    return _parts(infinitive, person, lambda b, r, p: _clitic(p, r, _plain("present", b, p)))


def preterite(infinitive: Column, person: Column) -> Column:
    return _parts(infinitive, person, lambda b, r, p: _clitic(p, r, _plain("preterite", b, p)))


def _nonfinite(infinitive: Column, irregular: str, a: str, e: str) -> Column:
    base, _ = split_reflexive(infinitive)
    return _let(base, lambda b: F.coalesce(F.try_element_at(_pairs(irregular), b), F.when(b.endswith("ar"), F.concat(_root(b), F.lit(a))).when(b.rlike("[ei]r$"), F.concat(_root(b), F.lit(e))), b))


def gerund(infinitive: Column) -> Column:
    return _nonfinite(infinitive, _GERUNDS, "ando", "iendo")


def participle(infinitive: Column) -> Column:
    return _nonfinite(infinitive, _PARTICIPLES, "ado", "ido")


def _ir(p: Column) -> Column:
    return by_person(_finite(p), "voy|vas|va|vamos|vais|van")


def _estar(p: Column) -> Column:
    return by_person(_finite(p), "estoy|estás|está|estamos|estáis|están")


def future(infinitive: Column, person: Column) -> Column:
    return _parts(infinitive, person, lambda b, r, p: F.concat_ws(" ", _ir(p), F.lit("a"), F.when(r, F.concat(b, by_person(p, CLITICS))).otherwise(b)))


def progressive(infinitive: Column, person: Column) -> Column:
    return _parts(infinitive, person, lambda b, r, p: _clitic(p, r, F.concat_ws(" ", _estar(p), gerund(b))))


def future_progressive(infinitive: Column, person: Column) -> Column:
    return _parts(infinitive, person, lambda b, r, p: _clitic(p, r, F.concat_ws(" ", _ir(p), F.lit("a"), _estar(p), gerund(b))))


def subjunctive(infinitive: Column, person: Column) -> Column:
    def stem(base: Column, yo: Column) -> Column:
        return F.when(yo.rlike(".o$"), F.regexp_replace(yo, "o$", "")).otherwise(_root(base))

    low = F.regexp_replace(F.lower(strip(blank(infinitive))), "se$", "")
    return _let(F.struct(low.alias("b"), person_code(person).alias("p")), lambda x: _let(
        F.coalesce(F.try_element_at(_table(PRESENT), F.concat(x["b"], F.lit(" 1sg"))), _yo(x["b"])),
        lambda yo: F.coalesce(F.try_element_at(_table(SUBJUNCTIVE), F.concat_ws(" ", x["b"], x["p"])), F.concat(stem(x["b"], yo), _endings("subjunctive", x["b"], x["p"])), x["b"])))


def imperative(infinitive: Column, person: Column, negative: bool = False) -> Column:
    low = F.lower(strip(blank(infinitive)))

    def form(b: Column, r: Column, p: Column) -> Column:
        clitic, mood = by_person(p, CLITICS), subjunctive(b, p)
        if negative:
            return F.concat_ws(" ", F.lit("no"), F.when(r, clitic), mood)
        tu = F.coalesce(F.try_element_at(_pairs(_COMMANDS), b), F.when(b.endswith("ar"), F.concat(_root(b), F.lit("a"))).when(b.rlike("[ei]r$"), F.concat(_root(b), F.lit("e"))), b)
        return F.concat(F.when(p == "2sg", tu).otherwise(mood), F.when(r, clitic).otherwise(""))

    parts = F.struct(F.regexp_replace(low, "se$", "").alias("b"), low.endswith("se").alias("r"), person_code(person).alias("p"))
    return _let(parts, lambda x: form(x["b"], x["r"], x["p"]))


def plural(noun: Column) -> Column:
    w = strip(noun)
    return F.when(w == "", w).when(F.lower(w).rlike("[aeiouáéíóú]$"), F.concat(w, F.lit("s"))).when(F.lower(w).endswith("z"), F.concat(F.substring(w, F.lit(1), F.length(w) - 1), F.lit("ces"))).otherwise(F.concat(w, F.lit("es")))


def article(definite: Column, is_plural: Column, gender: Column) -> Column:
    f = F.lower(gender) == "f"
    return (F.when(definite & is_plural, F.when(f, "las").otherwise("los")).when(definite, F.when(f, "la").otherwise("el"))
            .when(is_plural, F.when(f, "unas").otherwise("unos")).otherwise(F.when(f, "una").otherwise("un")))


def possessive(person: Column, is_plural: Column, gender: Column) -> Column:
    base = by_person(person, "mi|tu|su|nuestr|su|su", 0)
    ours = F.when(F.lower(gender) == "f", "nuestra").otherwise("nuestro")
    return F.concat(F.when(base == "nuestr", ours).otherwise(base), F.when(is_plural, "s").otherwise(""))


def subject_pronoun(person: Column, gender: Column) -> Column:
    p, f = F.lower(F.trim(person)), F.lower(F.trim(gender)) == "f"
    return F.when((p == "3sg") & f, "ella").when((p == "3pl") & f, "ellas").otherwise(by_person(p, "yo|tú|él|nosotros|ustedes|ellos"))


def agent_by(person: Column, gender: Column) -> Column:
    p, f = F.lower(F.trim(person)), F.lower(F.trim(gender)) == "f"
    return F.when((p == "3sg") & f, "por ella").when((p == "3pl") & f, "por ellas").otherwise(by_person(p, "por mí|por ti|por él|por nosotros|por ustedes|por ellos"))


def noun_phrase(gloss: Column, gloss_f: Column, gender_es: Column, countability: Column, is_plural: Column, definite: Column, possessor: Column, gender: Column) -> Column:
    base = F.when((F.lower(gender) == "f") & (blank(gloss_f) != ""), gloss_f).otherwise(blank(gloss))
    g = F.lower(F.coalesce(F.when(blank(gender) != "", gender), F.when(blank(gender_es) != "", gender_es), F.lit("m")))
    kind = F.lower(blank(countability))
    many = is_plural & (kind == "countable")
    form = F.when(many, plural(base)).otherwise(base)
    return (F.when(possessor.isNotNull() & (possessor != ""), F.concat_ws(" ", possessive(possessor, is_plural, g), form))
            .when(~definite & kind.isin("uncountable", "plural-only"), form).otherwise(F.concat_ws(" ", article(definite, many, g), form)))


def numeral_phrase(numeral: Column, gloss: Column, gender_es: Column, countability: Column) -> Column:
    n = strip(blank(numeral))
    one = F.lower(n).isin("1", "uno", "un", "una")
    word = F.when(F.lower(n).isin("1", "uno"), F.when(F.lower(gender_es) == "f", "una").otherwise("un")).otherwise(n)
    kind = F.lower(blank(countability))
    return F.when(~one & (kind == "uncountable"), F.concat(F.lit("algo de "), gloss)).otherwise(F.concat_ws(" ", word, F.when(~one & (kind == "countable"), plural(gloss)).otherwise(gloss)))


def copula(rule: Column) -> Column:
    return F.when(F.lower(strip(blank(rule))) == "estar", "estar").otherwise("ser")


def copula_negative(rule: Column, person: Column) -> Column:
    return F.concat(F.lit("no "), F.when(copula(rule) == "estar", present(F.lit("estar"), person)).otherwise(present(F.lit("ser"), person)))


def location_copula(noun_class: Column) -> Column:
    return F.when(F.lower(strip(blank(noun_class))) == "event", "ser").otherwise("estar")


def adjective(base: Column, feminine: Column, invariable: Column, gender: Column, is_plural: Column) -> Column:
    b = strip(blank(base))
    f = F.when(F.lower(gender) == "f", F.when(blank(feminine) != "", feminine).otherwise(F.regexp_replace(b, "o$", "a"))).otherwise(b)
    return F.when((b == "") | F.lower(strip(blank(invariable))).isin("1", "true", "yes"), b).otherwise(F.when(is_plural, plural(f)).otherwise(f))


def place_adjective(phrase: Column, adjective_: Column) -> Column:
    return F.concat_ws(" ", phrase, adjective_)


def verb_bundle(prefix: str, infinitive: Column, person: Column, imperative_person: Column, wanted: set[str] | None = None) -> Column:
    """Map of the slots that a verb fills."""
    who = F.lower(F.trim(F.coalesce(imperative_person, F.lit(""))))
    address = F.when(who.isin("3sg", "usted"), "3sg").when(who.isin("3pl", "2pl", "ustedes"), "3pl").when(who.isin("1pl", "nosotros"), "1pl").otherwise("2sg")
    base = strip(blank(infinitive))
    forms = {"ES": present(base, person), "PST_ES": preterite(base, person), "PROG_ES": progressive(base, person), "PP_ES": participle(base), "FUT_ES": future(base, person), "FUT_PROG_ES": future_progressive(base, person), "BASE_ES": base}
    for label, code in (("TU", "2sg"), ("USTED", "3sg"), ("USTEDES", "3pl")):
        forms |= {f"IMP_{label}_ES": imperative(base, F.lit(code)), f"IMP_{label}_NEG_ES": imperative(base, F.lit(code), True)}
    forms |= {"IMP_ES": imperative(base, address), "IMP_NEG_ES": imperative(base, address, True)}
    return slot_map({f"{prefix}_{k}": v for k, v in forms.items()}, wanted)
