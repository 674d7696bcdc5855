"""Requests as function calls: search, expansion terms, and answers, as text or JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import parse_qsl, quote_plus

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.functions.query import parse_query, whitespace_terms
from corvidex.functions.text import plain_tokens, query_snippet
from corvidex.operators.feedback import expansion_terms
from corvidex.operators.index import Index
from corvidex.operators.knowledge import opens_gate
from corvidex.operators.rank import RANKERS, best_answer, best_first, full_scan, page, ranker
from corvidex.operators.spelling import spell_check
from corvidex.session import durable
from corvidex.sources.writers import json_object, knowledge_json, knowledge_text, text_line

_NUMBER = re.compile(r"[+-]?[0-9]+").fullmatch
#: Rankers that a request can name.
RANKER_NAMES = frozenset(RANKERS) | {"fullscan", "none"}
_DEFAULTS = {"title": "", "url": "", "file_path": "", "page_rank": 0.0, "num_views": 0, "vote": 0, "answer": ""}


@dataclass(frozen=True)
class Request:
    """The options of a request with their defaults."""

    query: str = ""
    num: int = 10
    numterms: int = 5
    includequery: bool = True
    spellcheck: bool = True
    know: bool = True
    page: int = 1
    ranker: str = "none"
    format: str = "text"

    @staticmethod
    def parse(query_string: str) -> Request:
        """From ``key=value&...``: keys in any case, values that can't be read ignored, the last one holds.

        Numbers are whole, with a sign or without, and of 32 bits; a ranker must be one of RANKER_NAMES.
        """
        values: dict = {}
        for key, value in parse_qsl(query_string, keep_blank_values=True):
            key = "num" if key.lower() == "numdocs" else key.lower()
            if key in ("num", "numterms", "page"):
                if _NUMBER(value) and -(2**31) <= int(value) < 2**31:
                    values[key] = int(value)
            elif key in ("includequery", "spellcheck", "know"):
                if value.lower() in ("true", "false"):
                    values[key] = value.lower() == "true"
            elif key == "query":
                values[key] = value
            elif key == "ranker":
                if value.lower() in RANKER_NAMES:
                    values[key] = value.lower()
            elif key == "format" and value.lower() in ("text", "html"):
                values[key] = value.lower()
        return Request(**values)


class Engine:
    """An index, the index of questions, tags and dictionary behind the requests.

    ``texts`` (doc_id, text) is only read for the snippets of a page of results.
    """

    def __init__(self, index: Index, questions: Index | None = None, tags: DataFrame | None = None, dictionary: DataFrame | None = None, texts: DataFrame | None = None):
        self.index, self.questions, self.tags, self.dictionary, self.texts = index, questions, tags, dictionary, texts

    def results(self, r: Request) -> DataFrame:
        """(doc_id, score, title, url, file_path, page_rank, num_views) of the page of results, as far as the index has them; none for a page or number below 1."""
        stats, query = self.index.doc_stats, parse_query(r.query)
        if r.ranker == "fullscan":
            scored = full_scan(stats.select("doc_id", plain_tokens(F.col("title")).alias("title_tokens")), whitespace_terms(r.query))
        else:
            scored = ranker(r.ranker)(self.index, query)
        best = page(scored, r.num, r.page) if r.num > 0 and r.page > 0 else scored.limit(0)
        columns = [c for c in ("title", "url", "file_path", "page_rank", "num_views") if c in stats.columns]
        return stats.select("doc_id", *columns).join(F.broadcast(best), "doc_id").orderBy(*best_first())  # a page of rows

    def know(self, r: Request) -> DataFrame | None:
        """The best answer without asking the gate."""
        return best_answer(self.questions, parse_query(r.query), r.ranker) if self.questions and r.know else None

    def prf(self, r: Request) -> DataFrame:
        return expansion_terms(self.index, parse_query(r.query), r.ranker, r.num, r.numterms, r.includequery)

    def _filled(self, rows: DataFrame, defaults: dict) -> DataFrame:
        return rows.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in rows.columns})

    def result_objects(self, r: Request) -> DataFrame:
        """(doc_id, score, json) of the page of results, with snippets around the query's tokens."""
        rows = durable(self._filled(self.results(r), _DEFAULTS))  # a page of rows, read twice
        if self.texts is not None:
            texts = self.texts.join(F.broadcast(rows.select("doc_id")), "doc_id", "left_semi")  # a page of rows
            snippet = query_snippet(F.col("text"), list(parse_query(r.query).tokens))
            rows = rows.join(texts.select("doc_id", snippet.alias("snippet")), "doc_id", "left")
        return self._filled(rows, {"snippet": ""}).select("doc_id", "score", json_object().alias("json")).orderBy(*best_first())

    def spelling(self, r: Request) -> str:
        return spell_check(self.index, r.query, self.dictionary, r.ranker) if r.spellcheck and self.dictionary is not None else ""

    def search(self, r: Request) -> str:
        """The response to a search: text lines, or JSON for the format ``html``."""
        gate = self.tags is not None and not opens_gate(r.query, self.tags).isEmpty()
        return self._response(r, self.know(r) if gate else None, True)

    def know_response(self, r: Request) -> str:
        """The response to a request for an answer: no results, and no gate."""
        return self._response(r, self.know(r), False)

    def prf_response(self, r: Request) -> str:
        """The response to a request for expansion terms: ``term<tab>probability`` lines."""
        rows = self.prf(r).orderBy(F.desc("prob"), "term").collect()  # as many as asked for
        return "".join(f"{x['term']}\t{x['prob']}\n" for x in rows)

    def _response(self, r: Request, answer: DataFrame | None, with_results: bool) -> str:
        if answer is not None:
            answer = self._filled(answer, _DEFAULTS)
        spelling = self.spelling(r)
        if r.format == "text":
            lines = self._filled(self.results(r), _DEFAULTS).orderBy(*best_first()).select(text_line().alias("line")).collect() if with_results else []  # one page
            out = "\n".join(x["line"] for x in lines)
            out += "\n" if out else ""
            if answer is not None:
                out += "".join(x["t"] + "\n" for x in answer.select(knowledge_text().alias("t")).collect())
            if spelling:
                out += "Did you mean:" + spelling
            return out or "No results retrieved!"
        found = [json.loads(x["json"]) for x in self.result_objects(r).collect()] if with_results else []
        best = [json.loads(x["j"]) for x in answer.select(knowledge_json().alias("j")).collect()] if answer is not None else []
        return json.dumps({"results": found, "knowledge": best[0] if best else None, "spellcheck": quote_plus(spelling) if spelling else None, "query": quote_plus(str(parse_query(r.query)))})
