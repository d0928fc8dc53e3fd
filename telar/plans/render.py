"""Rendering of templates into sentence triples, all draws at once, and their annotation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.functions import english, qeqchi, spanish
from telar.functions.text import annotation_tokens, clean_english, clean_kek, clean_spanish, fill, sentence_case, slots, tidy_marks
from telar.operators.constraints import adjective_fits, enrich_nouns, has_slot, join_by_class, transitivity, valid_roles, verb_constraints
from telar.operators.corpus import dedup, not_in_history
from telar.operators.sampling import allocate, hashed


def _choose(pool: Column, seed: str, *by: Column) -> Column:
    """An element of an array by hash; NULL for an empty or missing one."""
    return F.when(F.size(pool) > 0, F.element_at(pool, (F.pmod(hashed(seed, *by), F.size(pool)) + 1).cast("int")))


def _pool(df: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, *[c for c in rest if c != order]))).alias(name))


#: Slots without a surface yet.
UNRENDERED = r"^\{(NUM_)?(AGENT_NP|PRED_NP|POSS_NP|POSSESSUM_NP|OCCUPATION|NAME|PLACE|ADV|ADJ_COMP)(_[A-Z0-9_]+)?\}$"


def render(templates: DataFrame, nouns: DataFrame, verbs: DataFrame, adjectives: DataFrame, numerals: DataFrame, total: int, seed: str = "render") -> DataFrame:
    """(template_id, draw, kek, en, es, values, template) of `total` draws: templates by weight, rows of the lexicons by hash.

    Compatible rows are worked out once for each verb or noun, in tables as small as the lexicons, and draws only look theirs up, so the
    number of draws meets no shuffle. A draw that finds no compatible row is left out, and so are templates with slots of UNRENDERED.
    """
    # only what the templates name is worked out; they are a dimension
    wanted = {r[0][1:-1] for r in templates.select(F.explode(slots(F.concat_ws(" ", "kek", "en", "es")))).distinct().collect()}
    nouns = enrich_nouns(nouns)
    slim = ["id", "lemma_kek", "gloss_en", "gloss_en_f", "gloss_es", "gloss_es_f", "gender_es", "class", "countability_en", "countability_es", "has_color"]
    nouns = nouns.select(*slim)
    limits = verb_constraints(verbs).select(*verbs.columns, "agent_allow", "agent_ban", "theme_allow", "theme_ban", "goal_allow", "goal_ban").withColumn("_tr", transitivity(F.col("transitivity")))
    prefixed = {r: nouns.select(*[F.col(c).alias(f"{r}_{c}") for c in slim]) for r in ("agent", "theme", "goal")}
    pools = {r: _pool(join_by_class(limits.select(F.col("id").alias("vid"), f"{r}_allow", f"{r}_ban"), prefixed[r], f"{r}_allow", f"{r}_ban", f"{r}_class").drop(f"{r}_allow", f"{r}_ban"), ["vid"], f"{r}_id", f"{r}s") for r in prefixed}
    ready = limits.join(pools["agent"].withColumnRenamed("vid", "id"), "id").join(pools["theme"].withColumnRenamed("vid", "id"), "id").join(pools["goal"].withColumnRenamed("vid", "id"), "id", "left")
    kinds = ready.withColumn("_kind", F.explode("_tr")).drop("_tr")
    verb_pool = _pool(kinds, ["_kind"], "id", "verbs")
    fits = adjectives.alias("a").join(nouns.alias("n"), adjective_fits()).select(F.col("n.id").alias("nid"), *[F.col(f"a.{c}").alias(f"adj_{c}") for c in ("id", "lemma_kek", "gloss_en", "gloss_es", "copula_es")])
    adj_pool = _pool(fits, ["nid"], "adj_id", "adjs")
    num_pool = numerals.agg(F.array_sort(F.collect_list(F.struct("value", "lemma_kek", "gloss_en", "gloss_es"))).alias("numerals"))

    def forms(k: str, prefix: str) -> DataFrame:
        # every verb's forms for every person of the templates: a table of some hundred rows
        each = kinds.filter(F.col("_kind") == k).select(F.col("id").alias("vid"), "lemma_kek", "gloss_kek", "gloss_en", "gloss_en_past", "gloss_en_pp", "gloss_es").crossJoin(templates.select("person").distinct())
        nobody = F.lit(None).cast("string")
        return each.select(F.lit(k).alias("_kind"), "vid", "person", F.map_concat(
            qeqchi.verb_bundle(prefix, F.col("lemma_kek"), F.col("gloss_kek"), F.lit(k), F.col("person"), nobody, F.lit("2sg"), wanted),
            english.verb_bundle(prefix, F.col("gloss_en"), F.col("gloss_en_past"), F.col("gloss_en_pp"), F.col("person"), F.lit("2sg"), {w for w in wanted if w.startswith(prefix)}),
            spanish.verb_bundle(prefix, F.col("gloss_es"), F.col("person"), F.lit("2sg"), wanted)).alias("forms"))

    bundles = forms("tr", "V_TR").unionByName(forms("intr", "V_INTR")).unionByName(forms("ditr", "V_DITR"))
    marked = templates.withColumn("_tokens", slots(F.concat_ws(" ", "kek", "en", "es"))).filter(~F.exists("_tokens", lambda t: t.rlike(UNRENDERED)))
    kind = F.when(F.exists("_tokens", lambda t: t.startswith("{V_DITR")), "ditr").when(F.exists("_tokens", lambda t: t.startswith("{V_INTR")), "intr").otherwise("tr")
    counted = allocate(marked.withColumn("_kind", kind), "weight", total, "id").filter("n > 0")
    draws = counted.withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    by = (F.col("id"), F.col("draw"))
    at = draws.join(verb_pool, "_kind").crossJoin(num_pool).withColumn("v", _choose(F.col("verbs"), f"{seed}-verb", *by)).drop("verbs")
    at = at.withColumn("a", _choose(F.col("v.agents"), f"{seed}-agent", *by)).withColumn("t", _choose(F.col("v.themes"), f"{seed}-theme", *by))
    needs_theme, needs_goal = (has_slot(F.col("_tokens"), x) | has_slot(F.col("_tokens"), f"NUM_{x}") | has_slot(F.col("_tokens"), f"{x}_EN") for x in ("THEME_NP", "GOAL_NP"))
    at = at.withColumn("g", F.when(needs_goal, _choose(F.filter("v.goals", lambda x: ~needs_theme | (x["goal_id"] != F.col("t.theme_id"))), f"{seed}-goal", *by)))
    at = at.withColumn("num", _choose(F.col("numerals"), f"{seed}-num", *by)).drop("numerals")
    at = at.join(adj_pool, F.col("a.agent_id") == F.col("nid"), "left").withColumn("adj", _choose(F.col("adjs"), f"{seed}-adj", *by)).drop("adjs", "nid")
    needs_adj = has_slot(F.col("_tokens"), "ADJ")
    at = at.filter(F.col("a").isNotNull() & F.col("t").isNotNull() & (~needs_adj | F.col("adj").isNotNull()) & ~F.coalesce((F.col("a.agent_id") == F.col("t.theme_id")) & has_slot(F.col("_tokens"), "THEME_NP"), F.lit(False)))
    roles = [(F.col(f"{x}.{role}_class"), F.col(f"v.{role}_allow"), F.col(f"v.{role}_ban")) for x, role in (("a", "agent"), ("t", "theme"), ("g", "goal"))]
    at = at.filter((~needs_goal | F.col("g").isNotNull()) & valid_roles(F.when(needs_theme, F.col("t.theme_id")), F.col("g.goal_id"), F.col("_kind") != "intr", F.col("_kind") == "ditr", needs_theme, needs_goal, roles))
    at = at.withColumn("vid", F.col("v.id")).join(F.broadcast(bundles), ["_kind", "vid", "person"])
    p, none, no, yes = F.col("person"), F.lit(None).cast("string"), F.lit(False), F.lit(True)

    def phrases(slot: str, role: str) -> dict[str, Column]:
        c = lambda x: F.col(f"{role[0]}.{role}_{x}")
        out = {
            f"NUM_{slot}": qeqchi.numeral_phrase(F.col("num.lemma_kek"), c("lemma_kek"), c("class")),
            f"NUM_{slot}_EN": english.numeral_phrase(F.col("num.gloss_en"), c("gloss_en"), c("countability_en")),
            f"NUM_{slot}_ES": spanish.numeral_phrase(F.col("num.gloss_es"), c("gloss_es"), c("gender_es"), c("countability_es"))}
        for suffix, many in (("", no), ("_PL", yes)):
            for mark, definite in (("", yes), ("_INDEF", no)):
                out |= {
                    f"{slot}{suffix}{mark}": qeqchi.noun_phrase(c("lemma_kek"), c("class"), definite, many, no, none),
                    f"{slot}_EN{suffix}{mark}": english.noun_phrase(c("gloss_en"), c("gloss_en_f"), c("countability_en"), many, definite, none, none),
                    f"{slot}_ES{suffix}{mark}": spanish.noun_phrase(c("gloss_es"), c("gloss_es_f"), c("gender_es"), c("countability_es"), many, definite, none, none)}
        return out

    single = {
        "SUBJ_PRONOUN": english.by_person(p, qeqchi.SUBJECTS), "AFFIX_PRONOUN": english.by_person(p, qeqchi.AFFIXES), "AGENT_BY": qeqchi.agent_by(p), "WITH_PRON": qeqchi.with_pronoun(p),
        "SUBJ_PRONOUN_EN": english.subject_pronoun(p, none), "SUBJ_PRONOUN_ES": spanish.subject_pronoun(p, none), "AGENT_BY_EN": english.agent_by(p, none), "AGENT_BY_ES": spanish.agent_by(p, none),
        "ADJ": F.col("adj.adj_lemma_kek"), "ADJ_EN": F.col("adj.adj_gloss_en"),
        "ADJ_ES": spanish.adjective(F.col("adj.adj_gloss_es"), none, none, F.col("a.agent_gender_es"), p.endswith("pl")),
        "COP_ES": F.when(spanish.copula(F.col("adj.adj_copula_es")) == "estar", spanish.present(F.lit("estar"), p)).otherwise(spanish.present(F.lit("ser"), p)),
        "NUM": F.col("num.lemma_kek"), "NUM_EN": F.col("num.gloss_en"), "NUM_ES": F.col("num.gloss_es"), **{k: english.by_person(p, v) for k, v in english.AUXILIARIES.items()},
    }
    surfaces = {k: F.coalesce(v, F.lit("")) for k, v in {**phrases("NP", "agent"), **phrases("THEME_NP", "theme"), **phrases("GOAL_NP", "goal"), **single}.items()}
    env = F.map_concat(qeqchi.placeholders(), english.slot_map(surfaces, wanted), F.col("forms"))
    full = at.withColumn("values", env)
    kek = sentence_case(tidy_marks(clean_kek(qeqchi.move_ta(qeqchi.fuse_affixes(qeqchi.fuse_possessives(tidy_marks(fill(F.col("kek"), F.col("values")))))))))
    return full.select(
        F.col("id").alias("template_id"), "draw", kek.alias("kek"), sentence_case(tidy_marks(clean_english(fill(F.col("en"), F.col("values"))))).alias("en"),
        sentence_case(tidy_marks(clean_spanish(fill(F.col("es"), F.col("values"))))).alias("es"), "values", F.col("kek").alias("template"),
        F.struct(F.col("a.agent_class").alias("NP"), F.col("t.theme_class").alias("THEME_NP"), F.col("g.goal_class").alias("GOAL_NP")).alias("classes"))


def render_many(render_total, total: int, history: DataFrame | None = None, factor: int = 3, most: int = 100) -> DataFrame:
    """`total` distinct triples: more draws than needed, the new ones by English text, each triple once, in order of their draws.

    render_total gives the draws for a number of them. Where too few are new, four times as many are drawn, up to `most` for each
    triple wanted; only then fewer come back.
    """
    while True:
        drawn = render_total(total * factor).withColumn("_order", F.struct("draw", "template_id"))
        fresh = not_in_history(drawn, history, "en") if history is not None else drawn
        out = dedup(fresh, ["kek", "en", "es"], "_order").orderBy("_order").limit(total).drop("_order")
        if factor >= most or out.count() >= total:
            return out
        factor = min(most, 4 * factor)


LABELS = "human kinship occupation animal_domesticated animal_wild insect plant fruit corn food beverage clothing container tool artifact building furniture vehicle body_part substance language emotion wood".split()
FUNCTION_WORDS = {"li": "DET", "moko": "PART", "ta": "PART", "ma": "PART", "chi": "ADP", "eb'": "PART", "k'a'ut": "ADV", "b'ar": "ADV"}


def label(noun_class: Column) -> Column:
    """BIO label of a noun class; O where it has none."""
    c = F.regexp_replace(F.lower(F.trim(noun_class)), "^body part$", "body_part")
    return F.when(c == "place", "B-LOCATION").when(c.isin(*LABELS), F.concat(F.lit("B-"), F.upper(F.translate(c, "_", "-")))).otherwise("O")


def slot_tag(slot: Column, classes: Column) -> Column:
    """struct(upos, sem) of a slot's words; NULL for slots of other languages or without surface."""
    noun = F.regexp_extract(slot, r"^\{(?:NUM_)?(NP|THEME_NP|GOAL_NP|AGENT_NP|POSS_NP|PRED_NP|POSSESSUM_NP)(?:_PL|_INDEF|_DEF|_PRE|_POST)*\}$", 1)

    def tag(upos: str, sem: Column | str = "O") -> Column:
        return F.struct(F.lit(upos).alias("upos"), (F.lit(sem) if isinstance(sem, str) else sem).alias("sem"))

    cls = F.when(noun == "THEME_NP", classes["THEME_NP"]).when(noun == "GOAL_NP", classes["GOAL_NP"]).otherwise(classes["NP"])
    return (F.when(slot.rlike(r"_E[NS](_|\})"), None).when(noun != "", tag("NOUN", label(cls))).when(slot.rlike(r"^\{V_(INTR|TR|DITR)(_(PST|FUT|PROG|FUT_PROG|PROG_FUT|IMP|IMP_NEG|PASS|PST_PASS|FUT_PASS))?(_PL)?\}$"), tag("VERB"))
            .when(slot.rlike(r"^\{ADJ"), tag("ADJ")).when(slot.rlike(r"^\{ADV"), tag("ADV")).when(slot == "{NUM}", tag("NUM")).when(slot == "{NAME}", tag("PROPN")).when(slot == "{PLACE}", tag("PROPN", "B-LOCATION"))
            .when(slot.rlike(r"^\{(SUBJ|AFFIX)_PRONOUN\}$"), tag("PRON")).when(slot.rlike(r"^\{(NEG_|YN_Q)"), tag("PART")).when(slot.rlike(r"^\{(WH|COMP|EXIST)"), tag("X")))


def tagged_tokens(template: Column, values: Column, classes: Column) -> Column:
    """Array of struct(surface, upos, sem): a template's words in order, tags by slot; literals by function word, else X."""
    words = F.create_map(*[F.lit(x) for kv in FUNCTION_WORDS.items() for x in kv])
    pieces = F.regexp_extract_all(template, F.lit(r"\{[A-Z0-9_]+\}|[^{]+"), F.lit(0))

    def of(piece: Column) -> Column:
        is_slot = piece.startswith("{")
        text = F.when(is_slot, F.coalesce(F.try_element_at(values, F.substring(piece, F.lit(2), F.length(piece) - 2)), F.lit(""))).otherwise(piece)
        tag = F.when(is_slot, slot_tag(piece, classes))
        found = F.transform(annotation_tokens(text), lambda w: F.struct(
            w.alias("surface"),
            F.when(w.rlike(r"^[.,!?;:]$"), "PUNCT").otherwise(F.coalesce(F.when(F.lower(w) == "li", "DET"), tag["upos"], F.try_element_at(words, F.lower(w)), F.lit("X"))).alias("upos"),
            F.when(w.rlike(r"^[.,!?;:]$") | (F.lower(w) == "li"), "O").otherwise(F.coalesce(tag["sem"], F.lit("O"))).alias("sem")))
        return F.when(is_slot & tag.isNull(), F.slice(found, 1, 0)).otherwise(found)

    return F.flatten(F.transform(pieces, of))


def fuse_tags(tokens: Column) -> Column:
    """The tagged list after the sentence's fusions: li joins a word that begins with in, aa or ee and takes that word's tag."""
    start = F.slice(tokens, 1, 0)
    return F.aggregate(tokens, start, lambda acc, t: F.when(
        (F.size(acc) > 0) & (F.lower(F.element_at(acc, -1)["surface"]) == "li") & t["surface"].rlike(r"^(in|aa|ee)\p{L}"),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(F.regexp_replace(F.element_at(acc, -1)["surface"], "i$", ""), t["surface"]).alias("surface"), t["upos"].alias("upos"), t["sem"].alias("sem")))),
    ).otherwise(F.concat(acc, F.array(t))))


def align(sentence: Column, tokens: Column) -> tuple[Column, Column]:
    """('Word (UPOS) …', 'Word (SEM) …'): the sentence's own words where there are as many as tags, else the tags' words."""
    own = annotation_tokens(sentence)
    surfaces = F.when(F.size(own) == F.size(tokens), own).otherwise(F.transform(tokens, lambda t: t["surface"]))

    def line(field: str) -> Column:
        return F.array_join(F.zip_with(surfaces, tokens, lambda w, t: F.concat(w, F.lit(" ("), t[field], F.lit(")"))), " ")

    return line("upos"), line("sem")


def annotate(rendered: DataFrame) -> DataFrame:
    """Rendered triples with pos_kek and semantic_kek."""
    tokens = fuse_tags(tagged_tokens(F.col("template"), F.col("values"), F.col("classes")))
    pos, sem = align(F.col("kek"), F.col("_t"))
    return rendered.withColumn("_t", tokens).select("*", pos.alias("pos_kek"), sem.alias("semantic_kek")).drop("_t", "values", "template", "classes")


def demo(spark: SparkSession, total: int) -> DataFrame:
    from telar.plans.lexicon import table

    return render(table(spark, "TEMPLATE"), table(spark, "NOUN"), table(spark, "VERB"), table(spark, "ADJECTIVE"), table(spark, "NUMERAL"), total)
