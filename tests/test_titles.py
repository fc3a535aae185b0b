"""Title rules on fixed titles; word ends and letters beyond ASCII count."""

from pyspark.sql import functions as F

from dailies.functions import rules

CASES = {
    None: (["empty"], []),
    "": (["empty"], []),
    " \u00a0\t": (["empty"], []),
    "Co si\u0119": (["short"], ["curiosity"]),
    "Naj\u0142atwiejszy wyjazd": (["short"], ["superlative"]),
    "naj": (["short", "no_formula"], []),
    "Od \u0141odzi do Krakowa": (["short"], ["transformation"]),
    "W 3 dni": (["short"], ["number", "transformation"]),
    "dzie\u0144 \u0663": (["short"], ["number"]),
    "Coverage everywhere, mostly": (["short", "no_formula"], []),
    "Naprawd\u0119": (["short"], ["curiosity"]),
    "\u017c\u00f3\u0142ty \u017c\u00f3\u0142ty": (["short", "no_formula", "repeated_keyword"], []),
    "bardzo bardzo": (["short", "no_formula"], []),
    "a " * 27 + "a": (["no_formula"], []),
    "  " + "a " * 27 + "   ": (["short", "no_formula"], []),
    "why " + "b" * 66: ([], ["curiosity"]),
    "why " + "b" * 67: (["long"], ["curiosity"]),
    "why " + "b" * 96: (["long"], ["curiosity"]),
    "why " + "b" * 97: (["over_hard_max"], ["curiosity"]),
}


def test_titles(spark):
    rows = spark.createDataFrame(list(enumerate(CASES)), "i int, title string")
    got = rows.select("i", rules.title_issues(F.col("title")).alias("issues"), rules.title_tags(F.coalesce("title", F.lit(""))).alias("tags")).collect()
    assert {t: (got[i].issues, got[i].tags) for i, t in enumerate(CASES)} == CASES
