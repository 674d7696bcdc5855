"""Blocks of documents, each with its own inverted index, and a whole log of queries ranked over them.

Looking up every query's documents by a join takes rows for each pair of a query
and a document that holds its rarest term. Here a task keeps a block of documents
in arrays, looks up all queries in it and hands on their best documents only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions.query import document_term
from corvidex.session import durable, ship

#: Documents or words after which a block ends, and after which a piece of it is counted; a block's documents are numbered by two bytes.
BLOCK_DOCS, BLOCK_WORDS, PIECE_DOCS, PIECE_WORDS = 32_768, 4_000_000, 4_096, 1_000_000
#: Different words a task remembers the terms of.
REMEMBERED = 500_000
#: Rows of results a task keeps to cut them over several blocks.
KEPT = 2_000_000
#: A term that is in so large a share of a block's documents is looked up by document number; so many terms at once.
DENSE_SHARE, DENSE_TERMS = 1 / 16, 200
_OTHER, _LINK = -1, -2
_SCHEMA = "terms array<string>, starts array<int>, docs binary, tfs binary, doc_ids binary, lengths binary, counted array<string>, counts array<bigint>, words bigint"


class _Words(dict):
    """Numbers of the terms of words as they stand in a text; words of other terms and links have numbers below 0."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, raw: bytes) -> int:
        number = _LINK if raw.startswith(b"http") else self.numbers.get(document_term(raw.decode("utf-8", "replace")), _OTHER)
        if len(self) >= REMEMBERED:
            self.clear()
        self[raw] = number
        return number


def build(docs: DataFrame, terms: list[str], phrases: list[list[str]], doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of ``docs`` that hold ``terms``, and ``phrases`` as terms of their own (their words joined by blanks), written once.

    A row per block: postings by term and document number (docs, tfs), the
    documents (doc_ids, lengths), occurrences of the terms (counted, counts) and
    the number of all words. Documents without an id are only counted. Every text
    is read once; ``doc`` is a bigint, a row per document.
    """
    names = [*terms, *(" ".join(p) for p in phrases)]
    limits = BLOCK_DOCS, BLOCK_WORDS, PIECE_DOCS, PIECE_WORDS

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        numbers = {t: k for k, t in enumerate(terms)}
        spoken = [[numbers[w] for w in p] for p in phrases]
        opens = np.zeros(len(terms) + 1, bool)  # its last place is for other words
        opens[[p[0] for p in spoken]] = True
        number = _Words(numbers).__getitem__
        made = _Block(names, len(terms), limits)
        for b in batches:
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = raw.split() if raw else ()  # bytes are split at ASCII white space
                made.add(doc_id, map(number, words), len(words))
                if made.piece_full():
                    made.count(spoken, opens)
                    if made.full():
                        yield made.row()
                        made = _Block(names, len(terms), limits)
        made.count(spoken, opens)
        if made.doc_ids:
            yield made.row()

    ship(docs.sparkSession)
    return durable(docs.select(F.col(doc).alias("doc_id"), F.lower(text).cast("binary").alias("text")).mapInArrow(run, _SCHEMA))


class _Block:
    """A block while it is made: words of a piece of its documents, and what was counted of earlier pieces."""

    def __init__(self, names: list[str], n_terms: int, limits: tuple[int, int, int, int]):
        import array

        import numpy as np

        self.most_docs, self.most_words, self.piece_docs, self.piece_words = limits
        self.names, self.doc_ids, self.lengths, self.sizes, self.ids = names, [], [], [], array.array("i")
        self.keys, self.tfs, self.ctf, self.words = [], [], np.zeros(n_terms, np.int64), 0

    def add(self, doc_id: int | None, ids: Iterator[int], size: int) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(size)
        self.ids.extend(ids)

    def piece_full(self) -> bool:
        return len(self.ids) >= self.piece_words or len(self.sizes) >= self.piece_docs

    def full(self) -> bool:
        return len(self.doc_ids) >= self.most_docs or self.words >= self.most_words

    def count(self, spoken: list[list[int]], opens) -> None:
        """Counts the words of the piece and finds its phrases."""
        import array

        import numpy as np

        n = len(self.sizes)
        first = len(self.doc_ids) - n
        ids = np.array(self.ids, np.int32)
        at = np.repeat(np.arange(n), self.sizes)
        kept = ids != _LINK
        ids, at = ids[kept], at[kept]
        self.lengths.append(np.bincount(at, minlength=n))
        self.words += len(ids)
        known = ids >= 0
        self.ctf += np.bincount(ids[known], minlength=len(self.ctf))
        named = np.array([d is not None for d in self.doc_ids[first:]], bool)
        known &= named[at]
        keys, tfs = np.unique((ids[known].astype(np.int64) << 16) | (at[known] + first), return_counts=True)
        self.keys.append(keys)
        self.tfs.append(tfs.astype(np.int32))
        begins = np.flatnonzero(opens[ids])
        begins = begins[np.argsort(ids[begins], kind="stable")]
        begun = ids[begins]
        for k, words in enumerate(spoken):
            p = begins[np.searchsorted(begun, words[0]) : np.searchsorted(begun, words[0], "right")]
            p = p[p + len(words) <= len(ids)]
            for i, w in enumerate(words):
                p = p[ids[p + i] == w]
            p = p[at[p] == at[p + len(words) - 1]]
            held = np.unique(at[p])
            held = held[named[held]]
            self.keys.append((np.int64(len(self.ctf) + k) << 16) | (held + first))
            self.tfs.append(np.ones(len(held), np.int32))
        self.sizes, self.ids = [], array.array("i")

    def row(self):
        import numpy as np
        import pyarrow as pa

        doc_ids = np.array([d or 0 for d in self.doc_ids], np.int64)
        order = np.argsort(doc_ids, kind="stable")  # documents are numbered in their order
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        keys, tfs = np.concatenate(self.keys), np.concatenate(self.tfs)
        keys = (keys & ~0xFFFF) | number[keys & 0xFFFF]
        by = np.argsort(keys)
        keys, tfs = keys[by], tfs[by]
        present, starts = np.unique(keys >> 16, return_index=True)
        counted = np.flatnonzero(self.ctf)
        columns = [
            pa.array([[self.names[k] for k in present]], pa.list_(pa.string())),
            pa.array([np.append(starts, len(keys)).astype(np.int32)], pa.list_(pa.int32())),
            *(pa.array([x.tobytes()], pa.binary()) for x in ((keys & 0xFFFF).astype(np.uint16), tfs, doc_ids[order], np.concatenate(self.lengths)[order].astype(np.int32))),
            pa.array([[self.names[k] for k in counted]], pa.list_(pa.string())),
            pa.array([self.ctf[counted]], pa.list_(pa.int64())),
            pa.array([self.words], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["terms", "starts", "docs", "tfs", "doc_ids", "lengths", "counted", "counts", "words"])


def counts(blocks: DataFrame) -> DataFrame:
    """(term, ctf, total_terms) of the terms of the blocks."""
    ctf = blocks.select(F.explode(F.arrays_zip("counted", "counts")).alias("x")).groupBy(F.col("x.counted").alias("term")).agg(F.sum("x.counts").alias("ctf"))
    return ctf.crossJoin(F.broadcast(blocks.agg(F.coalesce(F.sum("words"), F.lit(0)).alias("total_terms"))))  # one row


def best(blocks: DataFrame, asked: DataFrame, weight: Callable, digits: int) -> DataFrame:
    """(query_id, doc_id, score): of each task's blocks, the best documents of every query.

    ``asked``: asked, an array of structs query_id, most, items; the items of a
    query are structs c, term, qtf, and a document must hold them all. Its score
    is the sum of qtf * weight(tf, length, c), zero scores are dropped, and a
    query has no more than ``most`` documents of a task, by score to ``digits``
    digits, then by document. Every task has some blocks and some rows of
    ``asked``, which are not broadcast: a log has any size.
    """
    rows = durable(asked.select(F.monotonically_increasing_id().alias("part"), "asked"))
    pairs = blocks.select("terms", "starts", "docs", "tfs", "doc_ids", "lengths").crossJoin(rows.hint("shuffle_replicate_nl"))
    most_kept, dense = KEPT, (DENSE_SHARE, DENSE_TERMS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def out():
            for q, doc, score, _ in kept.values():
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(doc), pa.array(score)], ["query_id", "doc_id", "score"])
            kept.clear()

        kept: dict[int, tuple] = {}  # by part of the queries: what is best so far
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                part = row["part"].as_py()
                found = _search(row, weight, digits, *dense)
                if part in kept:
                    found = tuple(np.concatenate(x) for x in zip(kept[part], found))
                q, doc, score, most = found
                by = np.lexsort((doc, -np.round(score, digits), q))
                q = q[by]
                new = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
                place = np.arange(len(q)) - np.repeat(new, np.diff(np.append(new, len(q))))
                by = by[place < most[by]]
                kept[part] = tuple(x[by] for x in found)
                if sum(len(x[0]) for x in kept.values()) > most_kept:
                    yield from out()
        yield from out()

    ship(blocks.sparkSession)
    return pairs.mapInArrow(run, "query_id bigint, doc_id bigint, score double")


def _search(row: dict, weight: Callable, digits: int, share_dense: float, most_dense: int) -> tuple:
    """query_id, doc_id, score and most of the best documents of a block, for all queries of ``row``."""
    import numpy as np
    import pyarrow.compute as pc

    docs, tfs, doc_ids, lengths = (np.frombuffer(row[c].as_buffer(), t) for c, t in (("docs", np.uint16), ("tfs", np.int32), ("doc_ids", np.int64), ("lengths", np.int32)))
    starts = row["starts"].values.to_numpy()
    query_ids, mosts, items = row["asked"].values.flatten()
    sizes = items.value_lengths().to_numpy()
    c, term, qtf = items.flatten().flatten()
    local = pc.fill_null(pc.index_in(term, value_set=row["terms"].values), -1).to_numpy()
    c, qtf, query_ids, mosts = (x.to_numpy() for x in (c, qtf, query_ids, mosts))
    share = np.zeros(len(starts) - 1)
    share[local[local >= 0]] = c[local >= 0]
    weights = weight(tfs, lengths[docs], np.repeat(share, np.diff(starts)))
    dense: dict[int, np.ndarray] = {}
    ends = np.cumsum(sizes)
    whole = np.flatnonzero(np.minimum.reduceat(local, ends - sizes) >= 0) if len(sizes) else ()
    ends, sizes, starts, local, qtf = ends.tolist(), sizes.tolist(), starts.tolist(), local.tolist(), qtf.tolist()

    def held(terms: list[int]) -> tuple:
        """The documents that hold all terms, and each term's weights in them."""
        a, b = starts[terms[0]], starts[terms[0] + 1]
        found, parts = docs[a:b], [weights[a:b]]
        for t in terms[1:]:
            a, b = starts[t], starts[t + 1]
            full = dense.get(t)
            if full is None and b - a >= share_dense * len(doc_ids) and len(dense) < most_dense:
                full = dense[t] = np.full(len(doc_ids), np.nan)
                full[docs[a:b]] = weights[a:b]
            if full is not None:
                own = full[found]
                same = own == own
                found, parts, own = found[same], [x[same] for x in parts], own[same]
            else:
                mine, less = docs[a:b], len(found) > b - a
                few, many = (mine, found) if less else (found, mine)
                at = np.minimum(many.searchsorted(few), len(many) - 1)
                same = many[at] == few
                found, at = few[same], at[same]
                parts, own = ([x[at] for x in parts], weights[a:b][same]) if less else ([x[same] for x in parts], weights[a:b][at])
            if not len(found):
                break
            parts.append(own)
        return found, parts

    rows, docs_of, scores = [], [], []
    for q in whole:
        a, b = ends[q] - sizes[q], ends[q]
        found, parts = held(local[a:b])
        if not len(found):
            continue
        score = sum(x * n for x, n in zip(parts, qtf[a:b]))  # always in the same order, so that equal documents have equal scores
        if not score.all():
            found, score = found[score != 0], score[score != 0]
        most = int(mosts[q])
        if most < len(found):
            near = np.round(score, digits)
            last = np.partition(near, len(near) - most)[len(near) - most] if most > 0 else np.inf
            above = near > last
            ties = np.flatnonzero(near == last)[: most - int(above.sum())]
            above[ties] = True
            found, score = found[above], score[above]
        rows.append(np.full(len(found), q))
        docs_of.append(found)
        scores.append(score)
    if not rows:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0), none
    at = np.concatenate(rows)
    return query_ids[at], doc_ids[np.concatenate(docs_of)], np.concatenate(scores), mosts[at]
