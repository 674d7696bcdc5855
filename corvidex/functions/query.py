"""Queries: parsing on the driver, and batches of queries as a table."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from corvidex.functions.words import PUNCTUATION, QUERY_STOP_WORDS

_STRIP = str.maketrans("", "", PUNCTUATION)


def shape(stem: str) -> str:
    """v for vowels, c for consonants; y counts as a vowel after a consonant."""
    out = ""
    for ch in stem:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def stem(word: str, shape: Callable[[str], str] = shape) -> str:
    """Plurals, -eed, -ed and -ing off; the same rule as ``functions.text.with_stem``."""
    if len(word) < 3:
        return word
    if word.endswith(("sses", "ies")):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        return word[:-1] if "vc" in shape(word[:-3]) else word
    for suffix in ("ed", "ing"):
        if word.endswith(suffix):
            rest = word[: -len(suffix)]
            form = shape(rest)
            if "v" not in form:
                continue
            if rest.endswith(("at", "bl", "iz")):
                return rest + "e"
            if len(rest) > 1 and rest[-1] == rest[-2] and form.endswith("c"):
                return rest if rest[-1] in "lsz" else rest[:-1]
            if form.count("vc") == 1 and form.endswith("cvc") and rest[-1] not in "wxy":
                return rest + "e"
            return rest
    return word


def _vowel_shape(stem: str) -> str:
    """``functions.text.vowel_shape``, which leaves some of a long run of y as they are."""
    out = re.sub("^y", "c", re.sub("[aeiou]", "v", re.sub("[^aeiouy]", "c", stem)))
    for _ in range(3):
        out = out.replace("vy", "vc").replace("cy", "cv")
    return out


def document_term(word: str) -> str:
    """The term of a lower-cased word of a document, as ``functions.text.positions`` gives it."""
    return stem(word.translate(_STRIP), _vowel_shape)


def normalise(word: str) -> str:
    return stem(word.lower().translate(_STRIP))


@dataclass(frozen=True)
class Query:
    """``tokens`` in order; a token with a blank is a phrase."""

    raw: str
    tokens: tuple[str, ...] = field(default=())

    @property
    def terms(self) -> list[str]:
        """All words, those of phrases included, with repeats."""
        return [w for t in self.tokens for w in t.split(" ")]

    @property
    def phrases(self) -> list[list[str]]:
        return [t.split(" ") for t in self.tokens if " " in t]

    def counts(self) -> dict[str, int]:
        return dict(Counter(self.terms))

    def unique(self) -> list[str]:
        return sorted(set(self.terms))

    def __str__(self) -> str:
        return " ".join(self.tokens)


def parse_query(raw: str | None, stop_words: frozenset[str] = QUERY_STOP_WORDS) -> Query:
    """Terms and quoted phrases of a query.

    A quote opens at the start or after a blank or quote and closes at the end or
    before one. Plain words are lower-cased, stripped, stemmed and dropped if
    stop words; words of a phrase are not dropped; a single quoted word stays as
    it is. What follows a quote that never closes is plain words. Null is empty.
    """
    text = raw or ""
    tokens: list[str] = []

    def plain(part: str) -> None:
        for w in part.split():
            term = normalise(w)
            if term not in stop_words and w.strip('"'):
                tokens.append(term)

    def quoted(part: str) -> None:
        part = part.strip()
        words = part.split()
        if len(words) == 1:
            tokens.append(part)
        elif words:
            tokens.append(" ".join(normalise(w.strip('"')) for w in words))

    at, n = 0, len(text)
    while at < n:
        start = next((i for i in range(at, n) if text[i] == '"' and (i == 0 or text[i - 1] in ' "')), None)
        if start is None:
            break
        depth, end = 1, None
        for i in range(start + 1, n):
            if text[i] != '"':
                continue
            inside = text[start + 1 : i].strip(' "')
            if inside and (i == n - 1 or text[i + 1] in ' "'):
                depth -= 1
            elif text[i - 1] in ' "':
                depth += 1
            if depth == 0:
                end = i
                break
        plain(text[at:start])
        if end is None:
            plain(text[start + 1 :])
            return Query(text, tuple(tokens))
        quoted(text[start + 1 : end])
        at = end + 1
    plain(text[at:])
    return Query(text, tuple(tokens))


def original_terms(raw: str | None) -> list[str]:
    """The words of a query for spelling: lower-cased and stripped, not stemmed, stop words kept."""
    return [w for w in re.split(r" +", (raw or "").lower().translate(_STRIP).strip()) if w]


def whitespace_terms(raw: str | None) -> list[str]:
    """The plainest reading of a query: words at white space, as they stand."""
    return (raw or "").split()
