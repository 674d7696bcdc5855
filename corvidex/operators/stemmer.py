"""The full suffix-stripping stemmer, as column expressions.

Each step is a projection of its own, so that what it needs twice (the word's
consonants and vowels, the suffix found) is computed once. ``full_stem`` is the
same for single words on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.query import shape, stem
from corvidex.functions.text import vowel_shape, with_stem

# The published suffix tables, (suffix, instead), for stems of measure above 0.
_LONG = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
_MIDDLE = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
# Suffixes dropped from stems of measure above 1.
_LAST = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _measure(word: str) -> int:
    return shape(word).count("vc")


def _replace(word: str, table: list[tuple[str, str]]) -> str:
    for suffix, instead in sorted(table, key=lambda t: -len(t[0])):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            return rest + instead if _measure(rest) > 0 else word
    return word


def full_stem(word: str) -> str:
    """All steps; words of one or two letters stay."""
    if len(word) < 3:
        return word
    word = stem(word)
    if word.endswith("y") and "v" in shape(word[:-1]):
        word = word[:-1] + "i"
    word = _replace(_replace(word, _LONG), _MIDDLE)
    for suffix in sorted(_LAST, key=lambda s: -len(s)):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            if _measure(rest) > 1 and (suffix != "ion" or rest.endswith(("s", "t"))):
                word = rest
            break
    if word.endswith("e"):
        rest, form = word[:-1], shape(word[:-1])
        m = form.count("vc")
        if m > 1 or (m == 1 and not (form.endswith("cvc") and rest[-1] not in "wxy")):
            word = rest
    if word.endswith("ll") and _measure(word[:-1]) > 1:
        word = word[:-1]
    return word


def _measured(form: Column) -> Column:
    """How often a vowel is followed by a consonant."""
    return (F.length(form) - F.length(F.replace(form, F.lit("vc"), F.lit("")))) / 2


def _longest(word: Column, suffixes: list[str]) -> Column:
    """The longest of ``suffixes`` that the word ends with, or null."""
    out = F.lit(None).cast("string")
    for s in sorted(suffixes, key=len):
        out = F.when(word.endswith(s), s).otherwise(out)
    return out


def _without(word: Column, suffix: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - F.length(suffix))


def _barrier(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that later expressions refer to and don't repeat."""
    return df.withColumn("next_", value).drop(name).withColumn(name, F.explode(F.array("next_"))).drop("next_")


def with_full_stem(words: DataFrame, word: str = "word", into: str = "stem") -> DataFrame:
    """``words`` with column ``into``: all steps of the stemmer; words of one or two letters stay, null stays null."""
    kept = words.columns
    df = with_stem(words, word, "w_")
    w, suffix, rest, form = (F.col(c) for c in ("w_", "suffix_", "rest_", "form_"))
    df = df.withColumn("rest_", F.when(w.endswith("y"), _without(w, F.lit("y")))).withColumn("form_", vowel_shape(rest))
    df = _barrier(df, "w_", F.when(F.contains(form, F.lit("v")), F.concat(rest, F.lit("i"))).otherwise(w))
    for table in (_LONG, _MIDDLE):
        instead = F.lit(None).cast("string")
        for a, b in table:
            instead = F.when(suffix == a, b).otherwise(instead)
        df = df.withColumn("suffix_", _longest(w, [a for a, _ in table])).withColumn("rest_", _without(w, suffix)).withColumn("form_", vowel_shape(rest))
        df = _barrier(df, "w_", F.when(_measured(form) > 0, F.concat(rest, instead)).otherwise(w))
    df = df.withColumn("suffix_", _longest(w, _LAST)).withColumn("rest_", _without(w, suffix)).withColumn("form_", vowel_shape(rest))
    df = _barrier(df, "w_", F.when((_measured(form) > 1) & ((suffix != "ion") | rest.endswith("s") | rest.endswith("t")), rest).otherwise(w))
    df = df.withColumn("rest_", F.when(w.endswith("e"), _without(w, F.lit("e")))).withColumn("form_", vowel_shape(rest))
    short = form.endswith("cvc") & ~F.right(rest, F.lit(1)).isin("w", "x", "y")
    df = _barrier(df, "w_", F.when((_measured(form) > 1) | ((_measured(form) == 1) & ~short), rest).otherwise(w))
    df = df.withColumn("rest_", F.when(w.endswith("ll"), _without(w, F.lit("l")))).withColumn("form_", vowel_shape(rest))
    df = _barrier(df, "w_", F.when(_measured(form) > 1, rest).otherwise(w))
    return df.select(*kept, F.when(F.length(word) < 3, F.col(word)).otherwise(w).alias(into))
