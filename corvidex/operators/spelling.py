"""Spelling: a dictionary of counted words, candidates near a word, and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvidex.functions.query import Query, original_terms, parse_query
from corvidex.functions.text import edits1
from corvidex.functions.words import QUERY_STOP_WORDS
from corvidex.operators.feedback import expansion_terms
from corvidex.operators.index import Index


def dictionary(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, cnt): the runs of ASCII letters, digits and underscores of the lower-cased texts, counted."""
    return texts.select(F.explode(F.regexp_extract_all(F.lower(text), F.lit("([a-zA-Z0-9_]+)"), F.lit(1))).alias("word")).groupBy("word").agg(F.count("*").alias("cnt"))


def index_dictionary(index: Index) -> DataFrame:
    """(word, cnt): the vocabulary of an index with the number of documents of each term."""
    return index.term_stats.select(F.col("term").alias("word"), F.col("df").alias("cnt"))


def candidates1(words: DataFrame, dic: DataFrame) -> DataFrame:
    """(word, candidate, cnt): dictionary words one edit from each of ``words`` (word); stop words left out.

    Words of the dictionary have no candidates.
    """
    unknown = words.select("word").distinct().join(dic, "word", "left_anti")
    near = unknown.select("word", F.explode(F.array_distinct(edits1(F.col("word")))).alias("candidate"))
    return near.join(_usable(dic), "candidate").select("word", "candidate", "cnt")


def candidates2(words: DataFrame, dic: DataFrame) -> DataFrame:
    """(word, candidate, cnt): dictionary words within two edits (edits of edits), stop words left out.

    Two words within two edits have a string in common that two deletions at
    most make of either: an equi-join on those strings finds all pairs, some too
    many, and the pairs are then held against the definition: an edit of the word
    of which the candidate is an edit. Edits only bring in the letters a to z.
    """
    unknown = words.select("word").distinct().join(dic, "word", "left_anti")
    near = unknown.select("word", F.explode(_deletions2(F.col("word"))).alias("rest"))
    around = _usable(dic).select("candidate", "cnt", F.explode(_deletions2(F.col("candidate"))).alias("rest"))
    pairs = near.join(around, "rest").select("word", "candidate", "cnt").distinct()
    return pairs.where(F.arrays_overlap(edits1(F.col("word")), edits1(F.col("candidate"), backwards=True)))


def _deletions(word: Column) -> Column:
    """The word without each of its letters."""
    n = F.length(word)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.concat(F.substring(word, F.lit(1), i), F.substring(word, i + 2, n)))).otherwise(F.array().cast("array<string>"))


def _deletions2(word: Column) -> Column:
    """The word and what is left of it without one or two letters, each once."""
    one = _deletions(word)
    return F.array_distinct(F.concat(F.array(word), one, F.flatten(F.transform(one, _deletions))))


def _usable(dic: DataFrame) -> DataFrame:
    return dic.where(~F.col("word").isin(*sorted(QUERY_STOP_WORDS))).select(F.col("word").alias("candidate"), "cnt")


def correct(words: DataFrame, dic: DataFrame) -> DataFrame:
    """(word, correction): the word if it is known, else the most frequent of the nearest candidates, else the word.

    Ties go to the first in alphabetical order. Known words include stop words.
    """
    all_words = words.select("word").distinct()
    known = all_words.join(dic, "word", "left_semi").select("word", F.col("word").alias("candidate"), F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("cnt"))
    levels = known.unionByName(candidates1(all_words, dic).withColumn("level", F.lit(1))).unionByName(candidates2(all_words, dic).withColumn("level", F.lit(2)))
    best = levels.groupBy("word").agg(F.min_by("candidate", F.struct("level", -F.col("cnt"), "candidate")).alias("correction"))
    return all_words.join(best, "word", "left").select("word", F.coalesce("correction", "word").alias("correction"))


def spell_check(index: Index, raw: str, dic: DataFrame, ranker_name: str = "favorite") -> str:
    """A corrected query, or the empty string if nothing is to be changed.

    Unknown words are replaced by an expansion term of the known ones that is
    one edit away, else two edits away, in the order of the expansion; else by
    the top expansion term if no word is near; else by the most frequent near
    word. The words of one query are handled on the driver, all data by joins.
    """
    spark = index.term_doc.sparkSession
    words = original_terms(raw)
    if not words:
        return ""
    asked = spark.createDataFrame([(w,) for w in sorted(set(words))], "word string")
    known = {r["word"] for r in asked.join(dic, "word", "left_semi").collect()}  # words of one query
    unknown = [w for w in dict.fromkeys(words) if w not in known]
    if not unknown:
        return ""
    expansion: list[str] = []
    if known:
        query: Query = parse_query(" ".join(w for w in words if w in known), frozenset())
        expansion = [r["term"] for r in expansion_terms(index, query, ranker_name, 20, 20, include_query=False).collect()]
    todo = spark.createDataFrame([(w,) for w in unknown], "word string")
    wanted = F.col("candidate").isin(expansion) if expansion else F.lit(False)
    fixes: dict[str, str] = {}
    best_of: dict[str, str] = {}
    for level, find in ((1, candidates1), (2, candidates2)):
        found = find(todo, dic)
        # one row per word of the query and per expansion term near it
        for r in found.groupBy("word").agg(F.min_by("candidate", F.struct(-F.col("cnt"), "candidate")).alias("best"), F.collect_set(F.when(wanted, F.col("candidate"))).alias("near")).collect():
            if r["word"] in fixes:
                continue
            near = [t for t in expansion if t in r["near"]]
            if near:
                fixes[r["word"]] = near[0]
            best_of.setdefault(r["word"], r["best"])
    out = [w if w in known else fixes.get(w) or best_of.get(w) or (expansion[0] if expansion else w) for w in words]
    return " ".join(out) if out != words else ""
