"""Text and value rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dailies.functions.arith import idiv

# Phrase patterns and limits the checks are defined by.
INSTRUCTION_PATTERNS = {
    "pl": ["^to\\s+wstaw", "^to\\s+na\\b", "^u[żz]yj", "^wytnij", "^to\\s+wytnij", "^to\\s+wykorzystaj", "^to\\s+jako\\b"],
    "en": ["^insert\\s+this", "^use\\s+this\\s+(?:as|for)", "^cut\\s+this", "^discard\\s+this"],
}
ENDING_GUARD = "(?iu)dzięki\\s+za\\s+ogl[ąa]danie|dzieki\\s+za\\s+ogl[ąa]danie|do\\s+zobaczenia|na\\s+tym\\s+koń?cz[yę]m[ye]|do\\s+usłyszenia"
PLAN_ENDING_GUARD = (
    "(?iu)dzi[eę]k(?:i|uj[eę])\\s+za\\s+ogl[aą]danie|do\\s+zobaczenia|na\\s+tym\\s+ko[nń]czymy|do\\s+nast[eę]pnego"
    "|trzymajcie\\s+si[eę]|thanks?\\s+for\\s+watching|see\\s+you\\s+(?:next|soon)"
)
AROLL_ROLE = "(?i)a-?roll|narration|talking|piece-to-camera|ptc"
TITLE_FORMULAS = {
    "number": "(?U)\\d",
    "curiosity": "(?iU)\\bdlaczego\\b|\\bjak\\s|\\bco\\s+si[eę]\\b|\\bnikt\\b|\\bsekret\\w*|\\bnie\\s+uwierzysz\\b|\\bnaprawd[eę]\\b|\\bczego\\b"
    "|\\bokazuje\\s+si[eę]\\b|\\bnie\\s+spodziewa\\w*|\\bwhy\\b|\\bhow\\b|\\bwhat\\s+happen\\w*|\\bnobody\\b|\\bsecret\\b|\\?",
    "superlative": "(?iU)\\bnaj\\w+|\\bjedyn\\w+|\\bszalon\\w+|\\bekstremaln\\w+|\\bnigdy\\b|\\bbest\\b|\\bworst\\b|\\bmost\\b|\\bcheapest\\b|\\bonly\\b|\\bever\\b",
    "transformation": "(?iU)\\bod\\s+\\w+\\s+do\\s+\\w+|\\bz\\s+\\w+\\s+do\\s+\\w+|\\bzmieni\\w*|\\bprzemian\\w*|\\bw\\s+\\d+\\s*(?:godzin\\w*|dni|dzie[nń]|minut\\w*)"
    "|\\bfrom\\s+\\w+\\s+to\\s+\\w+|\\bturned\\s+into\\b|\\btransform\\w*",
}
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "your", "you", "jest", "sie", "się", "nie", "tak", "jak", "ale", "oraz", "przez", "dla", "czy", "juz",
    "już", "tym", "tego", "ktore", "które", "moze", "może", "byl", "był", "była", "byla", "jego", "jej", "ich", "sam", "tylko", "bardzo",
)
TITLE_MIN, TITLE_MAX, TITLE_HARD_MAX = 55, 70, 100


def is_instruction(text: Column, lang: Column) -> Column:
    """Spoken editor instruction, by the language's openings (Polish ones for other languages)."""
    t = F.lower(F.trim(text))
    hit = {k: t.rlike("|".join(v)) for k, v in INSTRUCTION_PATTERNS.items()}
    return F.when(lang == "en", hit["en"]).otherwise(hit["pl"])


def title_tags(title: Column) -> Column:
    return F.filter(F.array(*[F.when(title.rlike(p), F.lit(n)) for n, p in TITLE_FORMULAS.items()]), lambda x: x.isNotNull())


def repeated_keywords(title: Column) -> Column:
    words = F.sort_array(F.filter(F.regexp_extract_all(F.lower(title), F.lit("((?U)\\w{4,})"), 1), lambda w: ~w.isin(*STOPWORDS)))
    ahead = F.slice(words, 2, F.greatest(F.size(words), F.lit(1)))
    pairs = F.filter(F.arrays_zip(words.alias("a"), ahead.alias("b")), lambda p: p["a"] == p["b"])
    return F.array_distinct(F.transform(pairs, lambda p: p["a"]))


def title_issues(title: Column) -> Column:
    """Issues of a title without the blanks around it: length, none of the formulas, repeated keywords; one without text is only empty."""
    t = F.regexp_replace(F.coalesce(title, F.lit("")), "(?U)^\\s+|\\s+$", "")
    n = F.length(t)
    size = F.when(n < TITLE_MIN, "short").when(n > TITLE_HARD_MAX, "over_hard_max").when(n > TITLE_MAX, "long")
    plain = F.when(F.size(title_tags(t)) == 0, "no_formula")
    again = F.when(F.size(repeated_keywords(t)) > 0, "repeated_keyword")
    return F.when(t == "", F.array(F.lit("empty"))).otherwise(F.filter(F.array(size, plain, again), lambda x: x.isNotNull()))


def thumbnail_issues(text: Column) -> Column:
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "^\\s+|\\s+$", "")
    words = F.filter(F.split(t, "\\s+"), lambda w: w != "")
    found = F.array(
        F.when(F.size(words) > 5, "too_many_words"), F.when(F.length(t) > 30, "too_long"),
        F.when(F.exists(words, lambda w: F.length(w) > 14), "long_word"), F.when(t.rlike("[^\\p{L}\\p{N}\\s!?.,:'\\-–—&%€$]"), "illegal_characters"),
    )
    return F.when(t == "", F.array(F.lit("empty"))).otherwise(F.filter(found, lambda x: x.isNotNull()))


def crop_origin(pct: Column, src_width: Column, crop_width: Column) -> Column:
    """Even left edge of a crop centred on a subject at ``pct`` percent (kept within 5..95)."""
    p = F.greatest(F.least(pct, F.lit(95)), F.lit(5))
    x = idiv(F.greatest(src_width * p * 2 - crop_width * 100, F.lit(0)), 200)
    x = F.least(x, F.greatest(src_width - crop_width, F.lit(0)))
    return x - x % 2


def wrap_caption(text: Column, max_chars: int = 34, max_lines: int = 2) -> Column:
    """Greedy wrap; the last allowed line takes whatever is left."""
    words = F.filter(F.split(text, "\\s+"), lambda w: w != "")
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))

    def add(acc, w):
        grown = F.when(acc["cur"] == "", w).otherwise(F.concat_ws(" ", acc["cur"], w))
        full = (acc["cur"] != "") & (F.length(grown) > max_chars) & (F.size(acc["lines"]) + 1 < max_lines)
        return F.struct(
            F.when(full, F.concat(acc["lines"], F.array(acc["cur"]))).otherwise(acc["lines"]).alias("lines"),
            F.when(full, w).otherwise(grown).alias("cur"),
        )

    return F.aggregate(words, empty, add, lambda a: F.array_join(F.when(a["cur"] != "", F.concat(a["lines"], F.array(a["cur"]))).otherwise(a["lines"]), "\n"))


def fit_rule(width: Column, height: Column, default_fit: str = "blur-fill") -> Column:
    return F.when(height > width, default_fit).otherwise("cover")


def transition_rule(kind: Column, length_us: Column) -> tuple[Column, Column]:
    known = kind.isin("cut", "fade", "xfade")
    name = F.when(known, kind).otherwise("cut")
    return name, F.when(name == "cut", 0).otherwise(F.greatest(length_us, F.lit(0))).cast("bigint")


def even_sample(n: Column, k: int) -> Column:
    """Up to ``k`` evenly spaced distinct indexes of ``n`` items, both ends included (halves to even)."""
    last = F.greatest(n - 1, F.lit(0))
    if k == 1:
        picked = F.array(idiv(n, 2))
    else:
        picked = F.array(*[F.bround(last * F.lit(i) / F.lit(k - 1)).cast("bigint") for i in range(k)])
    whole = F.sequence(F.lit(0).cast("bigint"), last.cast("bigint"))
    return F.when(n <= 0, F.array().cast("array<bigint>")).when(n <= k, whole).otherwise(F.array_distinct(picked.cast("array<bigint>")))
