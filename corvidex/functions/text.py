"""Words of a text as column expressions: split, strip, stem, and the text of HTML.

All of it runs inside whole-stage code generation; nothing needs Python on the
executors but the full suffix-stripping stemmer, which is applied to distinct
words.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.words import PUNCTUATION

#: White space that separates words. ASCII only, so that SQL engines agree.
SPACE = r"[ \t\n\x0B\f\r]+"


def strip_punctuation(word: Column) -> Column:
    """The word without the characters of PUNCTUATION, wherever they stand."""
    return F.translate(word, PUNCTUATION, "")


def strip_quotes(word: Column) -> Column:
    """The word without double quotes; other punctuation stays."""
    return F.translate(word, '"', "")


def raw_tokens(text: Column, lower: bool = True) -> Column:
    """The words of a text as an array: lower-cased, split at white space, links (http...) dropped. Null gives null."""
    words = F.split(F.lower(text) if lower else text, SPACE)
    return F.filter(words, lambda w: (w != "") & ~F.startswith(w, F.lit("http")))


def plain_tokens(text: Column) -> Column:
    """The words of a text as they stand, split at white space (no lower case, no stem)."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def vowel_shape(stem: Column) -> Column:
    """The stem as v and c: vowels aeiou are v; y is v after a consonant, c after a vowel or at the start."""
    shape = F.translate(F.regexp_replace(stem, "[^aeiouy]", "c"), "aeiou", "vvvvv")
    shape = F.regexp_replace(shape, "^y", "c")
    for _ in range(3):
        shape = F.replace(F.replace(shape, F.lit("vy"), F.lit("vc")), F.lit("cy"), F.lit("cv"))
    return shape


def _drop(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def stem_plural(word: Column) -> Column:
    """Plurals off: sses to ss, ies to i, a single final s dropped."""
    return (
        F.when(F.length(word) < 3, word)
        .when(word.endswith("sses"), _drop(word, 2))
        .when(word.endswith("ies"), _drop(word, 2))
        .when(word.endswith("s") & ~word.endswith("ss"), _drop(word, 1))
        .otherwise(word)
    )


def restore_e(stem: Column, shape: Column) -> Column:
    """What follows the removal of -ed and -ing: at, bl, iz get an e, double consonants go, short stems get an e."""
    last = F.right(stem, F.lit(1))
    doubled = (F.length(stem) > 1) & (last == F.substring(stem, F.length(stem) - 1, F.lit(1))) & shape.endswith("c")
    short = (F.length(shape) - F.length(F.replace(shape, F.lit("vc"), F.lit(""))) == 2) & shape.endswith("cvc") & ~last.isin("w", "x", "y")
    return (
        F.when(stem.endswith("at") | stem.endswith("bl") | stem.endswith("iz") | short & ~doubled, F.concat(stem, F.lit("e")))
        .when(doubled & ~last.isin("l", "s", "z"), _drop(stem, 1))
        .otherwise(stem)
    )


def with_stem(df: DataFrame, word: str, into: str) -> DataFrame:
    """``df`` with column ``into``: the stem of column ``word`` (step 1 of the suffix stripper).

    Words of one or two characters stay. Null stays null, empty empty. Each
    intermediate is a column of its own, used several times but computed once.
    The generator at the end keeps filters on the stem above it: pushed below,
    they would repeat the whole expression, beyond what can be compiled.
    """
    w, x, st, cv = (F.col(c) for c in (word, "x_", "st_", "cv_"))
    out = df.withColumn("x_", stem_plural(w))
    bare = F.when(x.endswith("ed"), _drop(x, 2)).when(x.endswith("ing"), _drop(x, 3))
    out = out.withColumn("st_", F.when((F.length(w) < 3) | x.endswith("eed"), None).otherwise(bare)).withColumn("cv_", vowel_shape(st))
    stem = (
        F.when(F.length(w) < 3, w)
        .when(x.endswith("eed"), F.when(vowel_shape(_drop(x, 3)).contains("vc"), _drop(x, 1)).otherwise(x))
        .when(cv.contains("v"), restore_e(st, cv))
        .otherwise(x)
    )
    return out.withColumn(into, F.explode(F.array(stem))).drop("x_", "st_", "cv_")


def positions(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term, pos): a row per kept word, positions from 0.

    Links are dropped before numbering; words of punctuation only become the
    empty term and keep their position. Null and empty texts give no rows.
    """
    words = docs.select(F.col(doc).alias("doc_id"), F.posexplode(raw_tokens(F.col(text))).alias("pos", "raw"))
    words = words.select("doc_id", "pos", strip_punctuation(F.col("raw")).alias("word"))
    return with_stem(words, "word", "term").select("doc_id", "term", "pos")


def html_text(html: Column) -> Column:
    """The text of HTML: comments, scripts and styles out, tags to blanks, entities read, blanks squeezed."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?is)<script[^>]*>.*?</script>", " ")
    out = F.regexp_replace(out, r"(?is)<style[^>]*>.*?</style>", " ")
    out = F.regexp_replace(out, r"(?s)</?[A-Za-z][^>]*>", " ")
    return F.btrim(F.regexp_replace(entities(out), SPACE, " "))


#: What an entity looks like after its ampersand.
ENTITY = r"^(#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"


def named_entities() -> dict[str, str]:
    """The named characters of HTML, by the table of the standard library; the no-break space is a blank."""
    return {k[:-1]: v for k, v in html5.items() if k.endswith(";")} | {"nbsp": " "}


def entities(text: Column) -> Column:
    """The text with its entities read, once each: numbers in both bases and all names. What is no entity stays."""
    table = F.from_json(F.lit(json.dumps(named_entities())), "map<string,string>")  # folded to a literal

    def read(part: Column) -> Column:
        name = F.regexp_extract(part, ENTITY, 1)
        digits = F.when(F.lower(F.substring(name, 1, 2)) == "#x", F.substring(name, F.lit(3), F.length(name))).when(name.startswith("#"), F.conv(F.substring(name, F.lit(2), F.length(name)), 10, 16))
        code = F.conv(digits, 16, 10).cast("bigint")
        valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.when(name.startswith("#"), F.when(valid, F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))).otherwise(F.try_element_at(table, name))
        return F.coalesce(F.concat(char, F.substring(part, F.length(name) + 2, F.length(part))), F.concat(F.lit("&"), part))

    parts = F.split(text, "&")
    return F.when(F.contains(text, F.lit("&")), F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), read), ""))).otherwise(text)


def html_title(html: Column) -> Column:
    """The content of the title element; empty without one."""
    return F.btrim(F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), SPACE, " "))


def lead_snippet(text: Column, size: int = 250) -> Column:
    """The first characters of a text and three dots."""
    return F.concat(F.substring(text, 1, size), F.lit("..."))


def query_snippet(text: Column, tokens: list[str], size: int = 250) -> Column:
    """A piece of the text at each token, found one after the other; the lead if none is found.

    Each token gets ``size`` / number of tokens characters. A search starts where
    the last piece ended, and at the beginning again after a miss.
    """
    if not tokens:
        return lead_snippet(text, size)
    body, each = F.lower(text), size // len(tokens)
    start: Column = F.lit(1)
    out: Column = F.lit("...")
    for token in tokens:
        at = F.call_function("locate", F.lit(token), body, start)
        out = F.when(at > 0, F.concat(out, F.substring(body, at, F.lit(each)), F.lit("..."))).otherwise(out)
        start = F.when(at > 0, at + each).otherwise(F.lit(1))
    return F.when(F.length(out) < 10, lead_snippet(text, size)).otherwise(out)


def edits1(word: Column, backwards: bool = False) -> Column:
    """All strings one deletion, transposition, replacement or insertion (a to z) away, as an array with repeats.

    ``backwards``: the strings that the word is one edit away from, as far as
    they have no letters but a to z where the edit was: only letters a to z can
    have come in, so no others are taken out.
    """
    n = F.length(word)
    letters = F.array(*(F.lit(chr(c)) for c in range(97, 123)))
    head = lambda i: F.substring(word, F.lit(1), i)
    tail = lambda i: F.substring(word, i + 1, n)  # noqa: E731  what follows the first i characters
    places = F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    if backwards:
        places = F.filter(places, lambda i: F.substring(word, i + 1, F.lit(1)).between("a", "z"))
    deletes = F.transform(places, lambda i: F.concat(head(i), tail(i + 1)))
    swaps = F.transform(F.filter(F.sequence(F.lit(0), n), lambda i: i < n - 1), lambda i: F.concat(head(i), F.substring(word, i + 2, F.lit(1)), F.substring(word, i + 1, F.lit(1)), tail(i + 2)))
    replaces = F.flatten(F.transform(places, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i + 1)))))
    inserts = F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i)))))
    return F.concat(deletes, swaps, replaces, inserts)
