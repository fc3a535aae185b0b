"""Column expressions over words and sentences."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sentence-closing marks, small numbers, language codes.
END_MARKS = ".?!…"
CLOSING_PATTERN = "[.!?…]+[\"'”»)\\]]*$"
NUMBER_WORDS = {
    "zero": "0", "jeden": "1", "jedna": "1", "jedno": "1", "dwa": "2", "dwie": "2", "trzy": "3", "cztery": "4",
    "piec": "5", "szesc": "6", "siedem": "7", "osiem": "8", "dziewiec": "9", "dziesiec": "10", "sto": "100",
    "tysiac": "1000", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "ten": "10", "hundred": "100", "thousand": "1000",
}
LANGUAGES = {
    "pl": "pol", "en": "eng", "de": "deu", "fr": "fra", "es": "spa", "it": "ita", "pt": "por", "nl": "nld",
    "cs": "ces", "sk": "slk", "uk": "ukr", "ru": "rus", "sv": "swe", "no": "nor", "da": "dan", "fi": "fin",
    "tr": "tur", "el": "ell", "hu": "hun", "ro": "ron", "hr": "hrv", "sr": "srp", "bg": "bul", "lt": "lit",
    "lv": "lav", "et": "est", "ja": "jpn", "ko": "kor", "zh": "zho", "ar": "ara",
}


def _fold_table() -> tuple[str, str, dict[str, str]]:
    """Letters and signs whose compatibility decomposition has ASCII letters or digits, from Unicode data: those that become one, and the others."""
    src, dst, many = [], [], {}
    for code in range(0xA0, 0x20000):
        if not unicodedata.decomposition(chr(code)):
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)).lower() if c.isascii() and c.isalnum())
        if len(bare) == 1:
            src.append(chr(code))
            dst.append(bare)
        elif bare:
            many[chr(code)] = bare
    return "".join(src), "".join(dst), many


FOLD_FROM, FOLD_TO, FOLD_MANY = _fold_table()


def literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.try_element_at(literal_map(values), key)


def ascii_fold(text: Column) -> Column:
    """Lower case with letters and signs in their plain ASCII form; rare ones that become several letters take a map, pure ASCII takes none."""
    spread = F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(lookup(FOLD_MANY, c), c)), "")
    several = text.rlike("[" + "".join(FOLD_MANY) + "]")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.when(several, spread).otherwise(F.lower(text)), FOLD_FROM, FOLD_TO))


def fold_token(text: Column) -> Column:
    """Lower case, no marks, only ``[0-9a-z]``, number words as digits."""
    return number_digits(bare_token(text))


def one_to_one(text: Column) -> Column:
    """Whether no sign of the text becomes several letters in :func:`ascii_fold`; looked up sign by sign, so that long texts may be asked."""
    return (F.octet_length(text) == F.char_length(text)) | (F.char_length(F.translate(text, "".join(FOLD_MANY), "")) == F.char_length(text))


def bare_token(text: Column, joint: str = "") -> Column:
    """Folded letters and digits only; ``joint``, a control sign, stays too, so that joined words can be folded as one text."""
    folded = ascii_fold(text) if not joint else F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.lower(text), FOLD_FROM, FOLD_TO))
    return F.regexp_replace(folded, f"[^0-9a-z{joint}]+", "")


def number_digits(bare: Column) -> Column:
    return F.when(bare.isin(*NUMBER_WORDS), lookup(NUMBER_WORDS, bare)).otherwise(bare)


def word_set(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("((?U)\\w+)"), 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def ends_sentence(text: Column) -> Column:
    last = F.right(F.trim(text), F.lit(1))
    return last.isin(*END_MARKS)


def closes_sentence(text: Column) -> Column:
    return F.trim(text).rlike(CLOSING_PATTERN)


def _code(lang: Column) -> Column:
    return F.nullif(F.split_part(F.regexp_replace(F.lower(F.trim(lang)), "_", "-"), F.lit("-"), F.lit(1)), F.lit(""))


def to_iso3(lang: Column) -> Column:
    code = _code(lang)
    return F.when(F.length(code) == 3, code).otherwise(F.coalesce(lookup(LANGUAGES, code), code))


def to_iso1(lang: Column) -> Column:
    code = _code(lang)
    back = {v: k for k, v in LANGUAGES.items()}
    return F.when(F.length(code) == 2, code).otherwise(F.coalesce(lookup(back, code), code))


def language_mismatch(detected: Column, project: Column, prob: Column, n_words: Column) -> Column:
    """A confident detection (over 0.6, three words or more) of another language."""
    sure = detected.isNotNull() & prob.isNotNull() & (F.coalesce(n_words, F.lit(3)) >= 3) & (prob > 0.6)
    return F.coalesce(sure & ~to_iso1(detected).eqNullSafe(to_iso1(project)), F.lit(False))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_fold(text), "[^0-9a-z]+", "-"), F.lit("-"))


def srt_time(us: Column) -> Column:
    ms = F.greatest(F.call_function("div", us + 500, F.lit(1000)), F.lit(0))
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    return F.format_string(
        "%02d:%02d:%02d,%03d", div(ms, 3_600_000), div(ms % 3_600_000, 60_000), div(ms % 60_000, 1000), ms % 1000
    )
