"""Builders by name: index types, rankers, link analysers and log miners, for settings that name them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from corvidex.operators import index, knowledge, mining
from corvidex.operators.rank import RANKERS

# Names of index types in settings.
#: One index serves all types: positions are read only where a phrase asks for them.
INDEXES: dict[str, Callable[..., object]] = {
    "fullscan": index.full_scan_documents,
    "inverted-doconly": index.build,
    "inverted-occurrence": index.build,
    "inverted-compressed": index.build,
    "stackoverflow-compressed": knowledge.qa_index,
    "stackoverflow-occurrence": knowledge.qa_index,
}
CORPUS_ANALYZERS: dict[str, Callable[..., DataFrame]] = {"pagerank": mining.page_rank}
LOG_MINERS: dict[str, Callable[..., DataFrame]] = {"numviews": mining.num_views}


def find(table: dict, name: str):
    """The builder of a name in any case; ValueError for names without one."""
    found = table.get(name.strip().lower())
    if found is None:
        raise ValueError(f"no {name!r}; there are {', '.join(table)}")
    return found


__all__ = ["CORPUS_ANALYZERS", "INDEXES", "LOG_MINERS", "RANKERS", "find"]
