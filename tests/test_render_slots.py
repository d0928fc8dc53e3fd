from telar.plans import render
from telar.plans.lexicon import TEMPLATE_SCHEMA, table


def test_goals_and_missing_slots(spark):
    templates = spark.createDataFrame([
        (7, "{V_DITR} {THEME_NP} {GOAL_NP} {NP}", "{NP_EN} | {V_DITR_EN} {THEME_NP_EN} | {GOAL_NP_EN}", "{NP_ES} | {V_DITR_ES} {THEME_NP_ES} | {GOAL_NP_ES}", "3sg", 5),
        (8, "{V_INTR} {NAME}", "{NAME} {V_INTR_EN}.", "{NAME} {V_INTR_ES}.", "3sg", 5)], TEMPLATE_SCHEMA)
    verbs = table(spark, "VERB").filter("id = 'v5'")
    out = render.render(templates, table(spark, "NOUN"), verbs, table(spark, "ADJECTIVE"), table(spark, "NUMERAL"), 20).collect()
    assert out and {r["template_id"] for r in out} == {7}
    for r in out:
        agent, _, goal = (x.strip(" .") for x in r["en"].split("|"))
        assert agent and goal in ("the man", "the mother")  # v5's goals are human or kinship
        assert all(x.strip(" .") for x in r["es"].split("|")) and r["classes"]["GOAL_NP"].strip().lower() in ("human", "kinship")
