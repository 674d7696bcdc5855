"""The main body of a page among menus, notices, sidebars and footers.

A page is a tree: the page, its blocks (runs of lines of one shape, such as
link rows, labels, sentences or program text), the lines of a block, and the
segments of a line (sentences, links in a row, what stands in parentheses).
Each node is body or frame. Evidence comes from the segments alone: a linear
classifier over their hashed n-grams and their length. What surrounds a segment
speaks through the potentials between parent and child, which are counted on
labelled pages: how segments go with their line, a line with a block of its
shape, and a block of a kind (its shape, its neighbours' shapes and its size)
with its page. Messages are passed up from the segments and down again
(sum-product, exact on a tree), which gives each line's marginal probability of
being body.

Nobody has labelled the pages by hand, and no phrases of page frames are listed
here. Labels are taken from evidence that the features don't hold: how often
lines, sentences, headings and openings of lines recur over all pages of the
table, and the titles that other pages have (see ``labels``). Counts are taken
over the whole table, for the lines of a bounded sample of pages.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.llm.features import Softmax, hash_sample, train_softmax
from corvidex.llm.tokens import text_slices
from corvidex.session import ship

BODY, FRAME = 0, 1
#: Pages the model is fitted on, about; a smaller table gives all pages.
TRAIN_PAGES = 3500
#: Pages from which on a line recurs: so many, or this share of all pages.
RECURS, RECURS_SHARE = 5, 5e-5
#: Openings of frame lines stand within a paragraph at most this often, as a share.
ASTRAY = 0.02
#: Words of a closing remark at most.
REMARK = 5
#: Pages that a task remembers to have counted.
SEEN = 100_000
#: How far a repeated segment can count, and the weight of a title.
MOST_WEIGHT, TITLE_WEIGHT = 20.0, 0.5
#: Observations that the table of a block's shape weighs against those of its kind.
BACKOFF = 4.0

_TAG, _ANCHORS = re.compile(r"</?[A-Za-z!][^<>\n]*>"), re.compile(r"(?i)</a>\s*<a\b")
_LINKS = re.compile(r"\s[|·»/]\s|\s-\s|\s;\s| {2,}")
_SEPARATORS = (" | ", " · ", " / ", " » ", " - ", " ; ", "  ")
_BULLET = re.compile(r"(?i)^(?:\.\.\.)?\s*(?:[*+#-]+ ?|\d+[.)] |\\item\b|(?:<|&lt;)(?:li|[ou]l)\b|=+ ?)")
_CODE = re.compile(r"[;{}]\s*$|^\s*[}{<$~`]|^\s*(?:return|def|SELECT|FROM|WHERE|GROUP BY)\b.*[\w)\]:;]$|\w\s=\s|\w\(\w*\)$")
_SIGNS, _PROSE = re.compile(r"[\\^_={}$]").search, re.compile(r"[^\W\d_]{3,} [^\W\d_]{3,}").search
_SENTENCE = re.compile(r"[.!?…]\W*$")
_SENTENCES = re.compile(r"(?<=[.!?])\s+(?=[^\s(])").split
_SEGMENTS = re.compile(r"(?<=[.?!…:;])\s+|\s+[|·»/;-]\s+| {2,}|\s+(?=\()").split
_WORD_STARTS = re.compile(r"\b(?=\w)")
_DIGITS = re.compile(r"\d+").sub
_WORDS = re.compile(r"[^\W_]+").findall
_FIRST_TWO = re.compile(r"[\s_]*([^\W_]+|[^\w\s])(?:[\s_]*([^\W_]+|[^\w\s]))?").match
_HEADING = re.compile(r"(?i)^(?:=+|(?:<|&lt;)h[1-6]\b)").match
_SITE = re.compile(r"(?:corpus|stack)/+([^/]+)/", re.I)
SHAPES = ("blank", "links", "label", "sentence", "item", "code", "long")
BLANK, LINKS, LABEL, SENTENCE, ITEM, CODE, LONG = range(7)
#: Kinds of blocks: shape, shapes of the neighbours (7: none), and size.
KINDS = 7 * 8 * 8 * 3
#: Dense features of a segment.
DENSE = 6


def site_of(path: str | None) -> str:
    """The site in a file path, lower-cased; empty where there is none."""
    found = _SITE.search(path or "")
    return found[1].lower() if found else ""


def plain(line: str) -> str:
    """A line without tags, and without the dots that a cut text begins and ends with; links in a row stay apart."""
    if "&" in line:
        line = html.unescape(line)
    if "<" in line:
        line = _TAG.sub("", _ANCHORS.sub("</a> | <a", line))
    return line.replace("\xa0", " ").strip().removeprefix("...").removesuffix("...").strip()


def shape_of(line: str, text: str) -> int:
    """Index into SHAPES of a line and its plain text."""
    if not text:
        return CODE if line.strip() else BLANK
    if _BULLET.match(line):
        return ITEM
    if any(x in text for x in _SEPARATORS) and len(_LINKS.findall(text)) >= 2:
        return LINKS
    if _SENTENCE.search(text) and (_PROSE(text) or not _SIGNS(text)):
        return LONG if len(text) > 160 else SENTENCE
    if _CODE.search(text) or (_SIGNS(text) and not _PROSE(text)):  # program text, formulas
        return CODE
    return LABEL if len(text) < 60 else LONG


class LineReader:
    """(plain text, shape, segments) of lines; short ones are remembered, up to a bound."""

    CHARS, LINES = 90, 200_000

    def __init__(self) -> None:
        self._known: dict[str, tuple] = {}

    def __call__(self, line: str, site: str, pattern: re.Pattern | None) -> tuple[str, int, list[str]]:
        if site and site in line.lower():
            return self._read(line, pattern)
        if len(line) > self.CHARS:
            return self._read(line, None)
        found = self._known.get(line)
        if found is None:
            if len(self._known) >= self.LINES:
                self._known.clear()
            found = self._known[line] = self._read(line, None)
        return found

    @staticmethod
    def _read(line: str, pattern: re.Pattern | None) -> tuple[str, int, list[str]]:
        text = plain(line)
        shape = shape_of(line, text)
        if pattern:
            text = pattern.sub("thissite", text)
        if shape == ITEM:  # words of list items are kept apart from those of other lines
            return text, shape, [_WORD_STARTS.sub("zq", text or line)]
        parts = [x for x in _SEGMENTS(text) if x and not x.isspace()] if shape != CODE else []
        return text, shape, parts or [text or line]


_READ = LineReader()
_PATTERNS: dict[str, re.Pattern] = {}


def pattern_of(site: str) -> re.Pattern | None:
    """How the name of a site is found in its pages."""
    if site and site not in _PATTERNS:
        if len(_PATTERNS) > 10_000:
            _PATTERNS.clear()
        _PATTERNS[site] = re.compile(rf"(?i)\b{re.escape(site)}\b")
    return _PATTERNS.get(site)


class Pages:
    """The non-blank lines of a batch of pages, their segments and blocks, as arrays."""

    def __init__(self, rows: list[tuple[str | None, str | None]]):
        self.lines, self.texts, self.numbers, self.segments = [], [], [], []
        counts, shapes, sizes = [], [], []
        for snippet, path in rows:
            site, before = site_of(path), len(shapes)
            pattern = pattern_of(site)
            for i, line in enumerate((snippet or "").split("\n")):
                if not line or line.isspace():
                    continue
                text, shape, parts = _READ(line, site, pattern)
                self.lines.append(line)
                self.texts.append(text)
                self.numbers.append(i)
                self.segments += parts
                sizes.append(len(parts))
                shapes.append(shape)
            counts.append(len(shapes) - before)
        self.counts, self.shapes, self.sizes = np.array(counts, np.int64), np.array(shapes, np.int64), np.array(sizes, np.int64)
        self.owner = np.repeat(np.arange(len(shapes)), self.sizes)  # the line of a segment
        self.starts = np.cumsum(self.sizes) - self.sizes
        n = len(self.segments)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[self.starts], last[self.starts + self.sizes - 1] = True, True
        self.first, self.last = first, last
        self.dense = np.zeros((n, DENSE), np.float32)
        if n:
            self.dense[:, 0] = np.log1p(np.fromiter(map(len, self.segments), np.float32, n)) / 4
            self.dense[:, 1], self.dense[:, 2], self.dense[:, 3] = first & last, first & ~last, last & ~first
            self.dense[:, 4] = [x[0] == "(" for x in self.segments]
            self.dense[:, 5] = [x[-1] == ":" for x in self.segments]
        self._blocks()

    def _blocks(self) -> None:
        """Runs of lines of one shape within a page: the block of each line, the kind and page of each block."""
        begins = (np.cumsum(self.counts) - self.counts)[self.counts > 0]
        new = np.ones(len(self.shapes), bool)
        new[1:] = self.shapes[1:] != self.shapes[:-1]
        new[begins] = True
        self.block_starts = np.flatnonzero(new)
        self.blocks = np.cumsum(new) - 1
        self.pages = np.repeat(np.arange(len(self.counts)), self.counts)[self.block_starts]
        shape = self.shapes[self.block_starts]
        size = np.diff(np.append(self.block_starts, len(self.shapes)))
        opens = np.isin(self.block_starts, begins)
        before = np.where(opens, 7, np.append(7, shape[:-1]))
        after = np.where(np.append(opens[1:], True), 7, np.append(shape[1:], 7))[: len(shape)]
        self.kinds = (((shape * 8 + before) * 8 + after) * 3 + np.digitize(size, [2, 4])).astype(np.int64)


@dataclass
class BodyModel:
    """Tables are P(child | parent), indexed by group, state of the parent, state of the child."""

    softmax: Softmax
    prior: np.ndarray  # of the classes among the segments fitted on
    segment_given_line: np.ndarray  # by the number of segments: 0, 1, 2, more
    line_given_block: np.ndarray  # by shape
    block_given_page: np.ndarray  # by kind
    page: np.ndarray
    report: dict = field(default_factory=dict)


def _counted(group: np.ndarray, parent: np.ndarray, child: np.ndarray, groups: int, base: np.ndarray | float = 1.0) -> np.ndarray:
    """P(child | parent) by group from counts, ``base`` added to each."""
    t = np.bincount((group * 2 + parent) * 2 + child, minlength=groups * 4).reshape(groups, 2, 2) + base
    return t / t.sum(axis=2, keepdims=True)


def _up(child: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A child's message: a row per child, a column per state of its parent; ``table`` is the child's own, in logs."""
    return np.logaddexp(table[:, :, 0] + child[:, :1], table[:, :, 1] + child[:, 1:])


def _down(parent: np.ndarray, table: np.ndarray) -> np.ndarray:
    """What a parent says to each child: a row per child, a column per state of the child."""
    return np.logaddexp(parent[:, :1] + table[:, 0], parent[:, 1:] + table[:, 1])


def marginals(evidence: np.ndarray, p: Pages, model: BodyModel, messages: bool = True) -> np.ndarray:
    """P(body) of each line by sum-product on the trees of all pages at once.

    ``evidence`` (segments x 2) in logs. Without ``messages`` between lines,
    blocks and pages a line is judged by its own segments.
    """
    if not len(p.shapes):
        return np.zeros(0)
    seg = np.log(model.segment_given_line)[np.minimum(p.sizes, 3)][p.owner]
    line = np.log(model.line_given_block)[p.shapes]
    block = np.log(model.block_given_page)[p.kinds]
    own = np.add.reduceat(_up(evidence, seg), p.starts, axis=0)
    if not messages:
        belief = own + np.log(model.prior)
    else:
        line_up = _up(own, line)
        block_in = np.add.reduceat(line_up, p.block_starts, axis=0)
        block_up = _up(block_in, block)
        page_starts = np.flatnonzero(np.diff(p.pages, prepend=-1))  # pages without lines have no tree
        page_in = np.add.reduceat(block_up, page_starts, axis=0) + np.log(model.page)
        at_page = np.cumsum(np.diff(p.pages, prepend=p.pages[0]) != 0)
        # downward: what a node's parent knows without the node itself
        block_prior = _down(page_in[at_page] - block_up, block)
        belief = _down((block_prior + block_in)[p.blocks] - line_up, line) + own
    return 1 / (1 + np.exp(np.clip(belief[:, 1] - belief[:, 0], -50, 50)))


def body_probability(p: Pages, model: BodyModel, messages: bool = True) -> np.ndarray:
    z = model.softmax.logits(p.segments, p.dense)
    return marginals(z - np.logaddexp(z[:, :1], z[:, 1:]) - np.log(model.prior) if len(z) else z, p, model, messages)


# What is counted over all pages: (where, what) pairs of a line.
WHOLE, PART, HEADED, HEADING_FORM, FIRST, WITHIN, LAST = "wphfaiz"


def _key(text: str) -> str:
    return _DIGITS("0", text.lower()).strip("= ")


def _opening(piece: str) -> str:
    """The first two words or marks."""
    found = _FIRST_TWO(piece)
    return f"{found[1]} {found[2]}" if found else ""


def _form(key: str) -> str:
    words = _WORDS(key)
    return f"{words[0] if words else ''} {len(words)}"


def _closing(piece: str) -> str:
    """A closing remark up to what it names in parentheses; empty where a piece is none."""
    cut = piece.rfind(" (") if piece.endswith(")") else -1
    remark = piece[:cut] if cut > 0 else "" if piece[-1:] in ".!?:…" else piece
    return remark if remark[:1].isalpha() and "<" not in remark and len(remark.split()) <= REMARK else ""


def _line_keys(key: str) -> list[str]:
    """What a line adds to the counts: itself, its sentences, its openings and closing remark, each behind a letter."""
    out = [WHOLE + key]
    if key.endswith(")") or ". " in key or "? " in key or "! " in key:
        pieces = _SENTENCES(key)
        out.append(LAST + "(" + _closing(pieces[-1]))
        last = len(pieces) - 1
        if last:
            out += [PART + x for x in pieces]
        for j, x in enumerate(pieces):
            out.append((FIRST if not j else LAST if j == last else WITHIN) + _opening(x))
            if 0 < j < last and (remark := _closing(x)):
                out.append(WITHIN + "(" + remark)
    else:
        out.append(FIRST + _opening(key))
    return out


def page_keys(text: str, site: str, want: frozenset[str] | set[str], short: dict[str, list[str]]) -> set[str]:
    """What a page adds to the counts, of ``want``. ``short`` remembers lines.

    The same texts as those of ``LineReader``, made for the page at once.
    """
    if "&" in text:
        text = html.unescape(text)
    headings = [x for x in text.split("\n") if _HEADING(x.strip())] if "<" in text or "==" in text else []
    low = _plain_page(text, site)
    keys: set[str] = set()
    for x in headings:
        key = _key(_plain_page(x, site).strip())
        keys |= {HEADED + key, HEADING_FORM + _form(key)} & want
    for line in low.split("\n"):
        if not line or line.isspace() or _BULLET.match(line):
            continue
        mine = short.get(line)
        if mine is None:
            key = line.strip().removeprefix("...").removesuffix("...").strip().strip("= ")
            mine = [k for k in _line_keys(key) if k in want]
            if len(line) <= LineReader.CHARS:
                short[line] = mine
        keys.update(mine)
    return keys


def _plain_page(text: str, site: str) -> str:
    if "<" in text:
        text = _TAG.sub("", _ANCHORS.sub("</a> | <a", text))
    text = text.replace("\xa0", " ")
    if site and site in text.lower():
        text = pattern_of(site).sub("thissite", text)
    return _DIGITS("0", text.lower())


def labels(p: Pages, counts: dict[str, int], pages: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(class, weight, why) of each line; weight 0 where the counts say nothing.

    List items and program text are body, rows of links frame. Else, from what
    all pages hold: a line that also occurs as a sentence of paragraphs, or
    marked up as a heading, is body, and so is a label of the form of such
    headings; another line that recurs is frame, unless it opens like sentences of
    paragraphs (pages have near copies). Where words that open lines recur but
    hardly ever open a sentence within a paragraph, the first segment is frame;
    where a remark closes lines in that way, the last. What is left of sentences,
    which no other page has, is body.
    """
    most = max(RECURS, int(pages * RECURS_SHARE))
    n = lambda kind, what: counts.get(kind + what, 0)
    out, weight, why = np.zeros(len(p.texts), np.int64), np.zeros(len(p.texts)), [""] * len(p.texts)
    for i, (text, shape) in enumerate(zip(p.texts, p.shapes)):
        key = _key(text)
        pieces = _SENTENCES(key)
        opening, closing = _opening(pieces[0]), "(" + _closing(pieces[-1])
        if shape in (ITEM, CODE):
            found = (BODY, 1.0, "shape")
        elif shape == LINKS:
            found = (FRAME, 1.0, "links")
        elif n(PART, key) >= max(2, ASTRAY * n(WHOLE, key)) or n(HEADED, key):
            found = (BODY, 1.0, "within")
        elif shape == LABEL and len(pieces) == 1 and n(HEADING_FORM, _form(key)) >= 2:
            found = (BODY, 0.7, "heading")
        elif n(WHOLE, key) >= most and (shape == LABEL or n(WITHIN, opening) <= ASTRAY * n(FIRST, opening)):
            found = (FRAME, 1.0, "recurs")
        elif n(FIRST, opening) >= most and n(WITHIN, opening) <= ASTRAY * n(FIRST, opening):
            found = (FRAME, 0.7, "opening")
        elif shape != LABEL and len(closing) > 1 and n(LAST, closing) >= most and n(WITHIN, closing) <= ASTRAY * n(LAST, closing):
            found = (FRAME, 0.7, "closing")
        elif shape in (SENTENCE, LONG):
            found = (BODY, 0.5, "single")
        else:
            continue
        out[i], weight[i], why[i] = found
    return out, weight, why


def title_parts(title: str, site: str) -> list[str]:
    """The segments of a title, without the site's name at its end."""
    title = re.sub(r"[\s_]+", " ", title).strip()
    if site:
        title = re.sub(rf"(?i)\s*(?:-|::|\|)\s*{re.escape(site)}\b.*$", "", title)
    return [x for x in _SEGMENTS(title) if x and not x.isspace()]


def fit(rows: list[tuple[str | None, str | None, str | None]], counts: dict[str, int], pages_in_all: int) -> BodyModel:
    """A model from (snippet, file path, title) rows and the counts of their lines over all pages.

    Every eighth site is kept for the report. A title of a page, standing on
    another one, is a link to it: titles are segments of frame lines.
    """
    pages = Pages([r[:2] for r in rows])
    label, weight, why = labels(pages, counts, pages_in_all)
    held_page = np.array([zlib.crc32(site_of(r[1]).encode()) % 8 == 0 for r in rows] or [False])
    held = np.repeat(held_page, pages.counts) if len(rows) else np.zeros(0, bool)
    use = (weight > 0) & ~held
    if not use.any():
        half = np.full((2, 2), 0.5)
        return BodyModel(Softmax(np.zeros((1 << 15, 2), np.float32), np.zeros((DENSE + 1, 2), np.float32)), half[0], np.stack([half] * 4), np.stack([half] * 7), np.stack([half] * KINDS), half[0], {"lines": 0})
    # of lines known by their opening or closing only that segment is known
    opening, closing = (np.array([w == x for w in why])[pages.owner] for x in ("opening", "closing"))
    known = ~(opening & ~pages.first) & ~(closing & ~pages.last)
    seg_label, seg_weight = label[pages.owner], np.where(held, 0, weight / np.sqrt(pages.sizes))[pages.owner]
    examples: dict[tuple, list] = {}
    for i in np.flatnonzero((seg_weight > 0) & known):
        at = examples.setdefault((_DIGITS("0", pages.segments[i]), pages.dense[i].tobytes(), seg_label[i]), [pages.segments[i], pages.dense[i], seg_label[i], 0.0])
        at[3] = min(MOST_WEIGHT, at[3] + seg_weight[i])
    titles = {tuple(title_parts(r[2], site_of(r[1]))) for r, h in zip(rows, held_page) if r[2] and not h}
    data = list(examples.values())
    for t in sorted(titles):
        for j, x in enumerate(t):
            dense = [np.log1p(len(x)) / 4, len(t) == 1, len(t) > 1 and not j, len(t) > 1 and j == len(t) - 1, x[0] == "(", x[-1] == ":"]
            data.append([x, np.array(dense, np.float32), FRAME, TITLE_WEIGHT])
    target, w = np.array([d[2] for d in data]), np.array([d[3] for d in data])
    softmax = train_softmax([d[0] for d in data], np.stack([d[1] for d in data]), target, 2, w, l2=1e-6, rounds=80)
    prior = np.bincount(target, weights=w, minlength=2) + 1.0
    # potentials: counts over the labelled lines; unknown segments as the classifier sees them, blocks and pages by majority
    z = softmax.logits(pages.segments, pages.dense)
    state = np.where(known, seg_label, (z[:, 1] > z[:, 0]).astype(np.int64))
    votes = np.bincount(pages.blocks, weights=np.where(use, label - 0.5, 0), minlength=len(pages.pages))
    block = (votes > 0).astype(np.int64)
    page = (np.bincount(pages.pages, weights=block - 0.5, minlength=len(rows)) > 0).astype(np.int64)
    of, shape = use[pages.owner], pages.kinds // (KINDS // 7)
    trained = ~held_page[pages.pages]
    by_shape = _counted(shape[trained], page[pages.pages][trained], block[trained], 7)
    model = BodyModel(
        softmax,
        prior / prior.sum(),
        _counted(np.minimum(pages.sizes, 3)[pages.owner][of], seg_label[of], state[of], 4),
        _counted(pages.shapes[use], block[pages.blocks[use]], label[use], 7),
        _counted(pages.kinds[trained], page[pages.pages][trained], block[trained], KINDS, BACKOFF * by_shape[np.arange(KINDS) // (KINDS // 7)]),
        (np.bincount(page[~held_page], minlength=2) + 1.0) / ((~held_page).sum() + 2),
    )
    model.report = {"pages": len(rows), "lines": int(use.sum()), "frame_share": float(label[use].mean())}
    test = held & (weight > 0)
    if test.any():
        got, alone = body_probability(pages, model)[test] < 0.5, body_probability(pages, model, False)[test] < 0.5
        want = label[test] == FRAME
        model.report |= {"unseen_lines": int(test.sum()), "unseen_accuracy": float((got == want).mean()), "unseen_accuracy_without_messages": float((alone == want).mean()), "changed_by_messages": float((got != alone).mean())}
        model.report |= {f"unseen_recall_{k}": float((got[want == v] == v).mean()) for k, v in (("body", False), ("frame", True)) if (want == v).any()}
    return model


def line_counts(pages: DataFrame, text_col: str, path_col: str, wanted: set[str]) -> dict[str, int]:
    """On how many different pages of the whole table each of ``wanted`` occurs; those on none are left out.

    ``wanted`` comes from a bounded sample, so what is sent out and gathered is
    bounded. Equal texts are one page. Keys are counted per (key, page), so a
    line that a third of all pages have is spread over the tasks.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(frozenset(wanted))
    rows = pages.select(pages[f"`{text_col}`"].alias("text_"), pages[f"`{path_col}`"].alias("path_"), F.xxhash64(pages[f"`{text_col}`"]).alias("page_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, done, short = shared.value, set(), {}
        for whole in batches:
            for batch in text_slices(whole, "text_"):
                found, at = [], []
                texts, paths, ids = (batch.column(c).to_pylist() for c in ("text_", "path_", "page_"))
                for text, path, page in zip(texts, paths, ids):
                    if not text or page in done:  # only a saving: pages are told apart below
                        continue
                    if len(done) > SEEN:
                        done.clear()
                        short.clear()
                    done.add(page)
                    keys = page_keys(text, site_of(path), want, short)
                    found += keys
                    at += [page] * len(keys)
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(at, pa.int64())], names=["what", "page"])

    seen = rows.mapInArrow(run, "what string, page bigint")
    return {r["what"]: r["n"] for r in seen.groupBy("what").agg(F.count_distinct("page").alias("n")).collect()}  # as many as wanted, at most


def wanted_keys(rows: list[tuple]) -> set[str]:
    """Everything that ``labels`` may ask for about the lines of these pages."""
    p = Pages([r[:2] for r in rows])
    out: set[str] = set()
    for text, shape in zip(p.texts, p.shapes):
        if shape in (ITEM, CODE, LINKS):
            continue
        key = _key(text)
        pieces = _SENTENCES(key)
        opening, closing = _opening(pieces[0]), "(" + _closing(pieces[-1])
        out |= {WHOLE + key, PART + key, HEADED + key, HEADING_FORM + _form(key), FIRST + opening, WITHIN + opening, LAST + closing, WITHIN + closing}
    return out


def fitted(pages: DataFrame, text_col: str = "snippet", path_col: str = "filePath", title_col: str | None = "title") -> BodyModel:
    """A model fitted on a bounded sample of ``pages`` (TRAIN_PAGES), with counts over all of them. An empty table gives one that knows nothing."""
    title = pages[f"`{title_col}`"].cast("string") if title_col in pages.columns else F.lit(None).cast("string")
    rows = pages.select(pages[f"`{text_col}`"].alias("text"), pages[f"`{path_col}`"].alias("path"), title.alias("title"))
    picked, total = hash_sample(rows, "text", TRAIN_PAGES)
    one: dict[str, tuple] = {}
    for r in picked:
        one.setdefault(r["text"], (r["text"], r["path"], r["title"]))
    sample = sorted(one.values(), key=lambda r: r[0])
    return fit(sample, line_counts(pages, text_col, path_col, wanted_keys(sample)) if sample else {}, total)


def _mapped(pages: DataFrame, id_col: str, text_col: str, path_col: str, title_col: str | None, model: BodyModel | None, schema: str, emit) -> DataFrame:
    model = model or fitted(pages, text_col, path_col, title_col)
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select(pages[f"`{id_col}`"].alias("id_"), pages[f"`{text_col}`"].alias("text_"), pages[f"`{path_col}`"].alias("path_"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices(whole, "text_"):
                texts = batch.column("text_").to_pylist()
                p = Pages(list(zip(texts, batch.column("path_").to_pylist())))
                yield emit(batch, texts, p, body_probability(p, shared.value) >= 0.5)

    return rows.mapInArrow(run, f"id_ {dict(rows.dtypes)['id_']}, {schema}").withColumnRenamed("id_", id_col)


def frame_lines(pages: DataFrame, id_col: str = "result_id", text_col: str = "snippet", path_col: str = "filePath", title_col: str | None = "title", model: BodyModel | None = None) -> DataFrame:
    """(``id_col``, line_no INT): the non-blank lines, split at newline and numbered from 0, that aren't body.

    A page delivered again gives the same lines again, which count once. Null,
    empty and blank texts have none; null paths are pages of no site; null ids
    stay. Whole texts are read; titles only for fitting, other columns not at
    all. An empty table gives none.
    """

    def emit(batch: pa.RecordBatch, texts: list, p: Pages, is_body: np.ndarray) -> pa.RecordBatch:
        owner = np.repeat(np.arange(len(texts)), p.counts)
        keep = ~is_body
        return pa.RecordBatch.from_arrays([batch.column("id_").take(pa.array(owner[keep])), pa.array(np.array(p.numbers, np.int32)[keep])], names=["id_", "line_no"])

    return _mapped(pages, id_col, text_col, path_col, title_col, model, "line_no int", emit).distinct()


def main_body(pages: DataFrame, id_col: str = "result_id", text_col: str = "snippet", path_col: str = "filePath", title_col: str | None = "title", model: BodyModel | None = None) -> DataFrame:
    """(``id_col``, body STRING): one row per row of ``pages``, its lines that are body, joined by newlines.

    Null texts give null, texts without body lines the empty text; blank lines
    between body lines go.
    """

    def emit(batch: pa.RecordBatch, texts: list, p: Pages, is_body: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(p.counts)
        bodies = [None if t is None else "\n".join(p.lines[i] for i in range(e - n, e) if is_body[i]) for t, e, n in zip(texts, ends, p.counts)]
        return pa.RecordBatch.from_arrays([batch.column("id_"), pa.array(bodies, pa.string())], names=["id_", "body"])

    return _mapped(pages, id_col, text_col, path_col, title_col, model, "body string", emit)
