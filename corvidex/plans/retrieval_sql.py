"""SQL that gives the same rows as ``retrieval_queries``, written apart from it; only the stem's rule is shared."""

from __future__ import annotations

from corvidex.functions.text import ENTITY, named_entities
from corvidex.functions.words import EXPANSION_STOP_WORDS, PUNCTUATION, QUERY_STOP_WORDS
from corvidex.operators.stemmer import _LAST, _LONG, _MIDDLE

MISSPELLED = ["buffr", "claosed", "tabel", "qeury", "depnds", "retrys", "nulll", "servr"]
TAGS = ["java", "python", "thread", "search", "web", "script", "index"]

_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _words(values) -> str:
    return ", ".join(_lit(v) for v in sorted(values))


def _shape(x: str) -> str:
    out = f"regexp_replace(translate(regexp_replace({x}, '[^aeiouy]', 'c', 'g'), 'aeiou', 'vvvvv'), '^y', 'c')"
    for _ in range(3):
        out = f"replace(replace({out}, 'vy', 'vc'), 'cy', 'cv')"
    return out


def _stems(source: str) -> str:
    """CTEs that end in ``stems``(w, term) for the distinct words of ``source``(w)."""
    return f"""
 s1 AS (SELECT w, CASE WHEN length(w) < 3 THEN w WHEN ends_with(w, 'sses') OR ends_with(w, 'ies') THEN left(w, length(w) - 2)
         WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, length(w) - 1) ELSE w END AS x FROM (SELECT DISTINCT w FROM {source})),
 s2 AS (SELECT w, x, CASE WHEN length(w) < 3 THEN NULL
         WHEN ends_with(x, 'eed') THEN NULL
         WHEN ends_with(x, 'ed') AND contains({_shape("left(x, length(x) - 2)")}, 'v') THEN left(x, length(x) - 2)
         WHEN ends_with(x, 'ing') AND contains({_shape("left(x, length(x) - 3)")}, 'v') THEN left(x, length(x) - 3) END AS st FROM s1),
 s3 AS (SELECT *, {_shape("st")} AS cv FROM s2),
 stems AS (SELECT w, CASE
     WHEN length(w) < 3 THEN w
     WHEN ends_with(x, 'eed') THEN CASE WHEN contains({_shape("left(x, length(x) - 3)")}, 'vc') THEN left(x, length(x) - 1) ELSE x END
     WHEN st IS NULL THEN x
     WHEN ends_with(st, 'at') OR ends_with(st, 'bl') OR ends_with(st, 'iz') THEN st || 'e'
     WHEN length(st) > 1 AND right(st, 1) = right(left(st, length(st) - 1), 1) AND ends_with(cv, 'c') THEN CASE WHEN right(st, 1) IN ('l', 's', 'z') THEN st ELSE left(st, length(st) - 1) END
     WHEN length(cv) - length(replace(cv, 'vc', '')) = 2 AND ends_with(cv, 'cvc') AND right(st, 1) NOT IN ('w', 'x', 'y') THEN st || 'e'
     ELSE st END AS term FROM s3)"""


def _collection(source: str = "documents", doc: str = "doc_id", text: str = "text") -> str:
    """CTEs of an index: postings, term_doc, term_stats, lens, scalars."""
    return f"""
 lists AS (SELECT {doc} AS doc_id, list_filter(string_split_regex(lower({text}), '{_SPACE}'), lambda x: x <> '' AND NOT starts_with(x, 'http')) AS ws FROM {source}),
 raw AS (SELECT doc_id, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS pos FROM lists),
 stripped AS (SELECT doc_id, raw, translate(raw, {_lit(PUNCTUATION)}, '') AS w, pos FROM raw),
 {_stems("stripped")},
 postings AS (SELECT term, doc_id, pos::INT AS pos FROM stripped JOIN stems USING (w)),
 term_doc AS (SELECT term, doc_id, count(*) AS tf FROM postings GROUP BY term, doc_id),
 term_stats AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS ctf FROM term_doc GROUP BY term),
 lens AS (SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS length FROM lists),
 scalars AS (SELECT count(*) AS num_docs, coalesce(sum(length), 0)::BIGINT AS total_terms FROM lens)"""


def _hits(terms: list[str], phrases: list[list[str]] = ()) -> str:
    """CTE hits(doc_id) of documents with all terms and phrases."""
    sql = f"SELECT doc_id FROM term_doc WHERE term IN ({_words(terms)}) GROUP BY doc_id HAVING count(*) = {len(set(terms))}"
    for p in phrases:
        joins = "".join(f" JOIN postings p{i} ON p{i}.doc_id = p0.doc_id AND p{i}.pos = p0.pos + {i} AND p{i}.term = {_lit(w)}" for i, w in enumerate(p) if i)
        sql += f" INTERSECT SELECT p0.doc_id FROM postings p0{joins} WHERE p0.term = {_lit(p[0])}"
    return f" hits AS ({sql})"


def _ql(terms: list[str]) -> str:
    """CTE ql(doc_id, score)."""
    return f""" ql AS (SELECT doc_id, sum(log2(0.5::DOUBLE * tf / length + 0.5::DOUBLE * ctf / total_terms)) AS score
   FROM term_doc JOIN hits USING (doc_id) JOIN term_stats USING (term) JOIN lens USING (doc_id), scalars WHERE term IN ({_words(terms)}) AND length > 0 GROUP BY doc_id HAVING score <> 0)"""


_GRAPH = """
 e0 AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
 e AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS degree FROM e0 WHERE src IN (SELECT p_partkey FROM part) AND dst IN (SELECT p_partkey FROM part)),
 r1 AS (SELECT p_partkey AS name, 0.9::DOUBLE * coalesce(g, 0) + 0.1::DOUBLE AS pr FROM part LEFT JOIN (SELECT dst, sum(1.0::DOUBLE / degree) AS g FROM e GROUP BY dst) ON dst = p_partkey),
 r2 AS (SELECT p_partkey AS name, 0.9::DOUBLE * coalesce(g, 0) + 0.1::DOUBLE AS pr FROM part LEFT JOIN (SELECT dst, sum(pr / degree) AS g FROM e JOIN r1 ON name = src GROUP BY dst) ON dst = p_partkey)"""

_VIEWS = """
 views AS (SELECT d.doc_id AS name, coalesce(v, 0)::BIGINT AS views FROM (SELECT DISTINCT doc_id FROM documents) d
   LEFT JOIN (SELECT user_id, sum(floor(value)::INT) AS v FROM events WHERE value IS NOT NULL GROUP BY user_id) ON user_id = d.doc_id)"""

# the query words as they stand in the index
_T = ["close", "buffer"]
_P = ["close", "too", "early", "buffer"]
_C = f"WITH {_collection()}"
_TOP = " ORDER BY round(score, 9) DESC, doc_id LIMIT 10"
_PAGE = "SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, score FROM {} " + _TOP + ")"
_PHRASES = [["close", "too", "early"]]

_LIKELIHOOD = _C + "," + _hits(_T) + "," + _ql(_T)
_FULL = f"{_C}, {_GRAPH}, {_VIEWS}"

RUN = """
WITH run AS (SELECT query_id AS query, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, doc_id) AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM scored_document GROUP BY query_id, doc_id)),
 votes AS (SELECT doc_id, vote FROM (SELECT doc_id, vote, row_number() OVER (PARTITION BY doc_id ORDER BY crawled_at DESC, knowledge_id DESC) AS k FROM knowledge) WHERE k = 1 AND vote IS NOT NULL),
 graded AS (SELECT query, rank, CASE WHEN vote >= 40 THEN 10.0::DOUBLE WHEN vote >= 20 THEN 7.0 WHEN vote >= 8 THEN 5.0 WHEN vote >= 0 THEN 1.0 ELSE 0.0 END AS gain, vote IS NOT NULL AS known FROM run LEFT JOIN votes USING (doc_id)),
 j AS (SELECT query, rank, gain, CASE WHEN gain > 1 THEN 1 ELSE 0 END AS rel FROM graded WHERE query IN (SELECT query FROM graded WHERE known)),
 h AS (SELECT *, sum(rel) OVER (PARTITION BY query ORDER BY rank) AS hits FROM j)
"""


def _prf_k(k: int) -> str:
    return f"sum(CASE WHEN rank <= {k} THEN rel ELSE 0 END)::DOUBLE AS h{k}"


_PRF = f"t AS (SELECT query, {_prf_k(1)}, {_prf_k(5)}, {_prf_k(10)}, sum(rel) AS n FROM j GROUP BY query), m AS (SELECT query, " + ", ".join(
    f"h{k} / {k} AS p_{k}, CASE WHEN n > 0 THEN h{k} / n ELSE 0 END AS r_{k}" for k in (1, 5, 10)
) + " FROM t), prf_m AS (SELECT query, " + ", ".join(
    f"p_{k}, r_{k}, CASE WHEN p_{k} = 0 OR r_{k} = 0 THEN 0 ELSE 1 / (0.5::DOUBLE / p_{k} + 0.5::DOUBLE / r_{k}) END AS f_{k}" for k in (1, 5, 10)
) + " FROM m)"
_CURVE = """levels AS (SELECT query, level, floor(n * level / 10.0)::BIGINT AS k FROM (SELECT query, sum(rel) AS n FROM j GROUP BY query), (SELECT unnest(range(0, 11))::INT AS level)),
 curve AS (SELECT l.query, level, coalesce(h.hits / h.rank::DOUBLE, 0)::DOUBLE AS precision FROM levels l LEFT JOIN h ON h.query = l.query AND h.rel = 1 AND h.hits = l.k)"""
_AP = "ap_m AS (SELECT query, CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rel = 1 THEN hits / rank::DOUBLE ELSE 0 END) / sum(rel) ELSE 0 END::DOUBLE AS ap FROM h GROUP BY query)"
_RR = "rr_m AS (SELECT query, coalesce(1.0::DOUBLE / min(CASE WHEN rel = 1 THEN rank END), 0) AS rr FROM j GROUP BY query)"


def _ndcg(k: int) -> str:
    return f"""nd{k} AS (SELECT query, CASE WHEN sum(ideal) > 0 THEN sum(d) / sum(ideal) ELSE 0 END AS ndcg_{k} FROM (
  SELECT query, gain / log2(rank + 1.0::DOUBLE) AS d, gain / log2(row_number() OVER (PARTITION BY query ORDER BY gain DESC, rank) + 1.0::DOUBLE) AS ideal FROM j WHERE rank <= {k}) GROUP BY query)"""


_NDCG = ", ".join(map(_ndcg, (1, 5, 10)))
_PRF_COLUMNS = ", ".join(f"round({m}_{k}, 6) AS {m}_{k}" for m in "prf" for k in (1, 5, 10))
_ND_COLUMNS = ", ".join(f"round(ndcg_{k}, 6) AS ndcg_{k}" for k in (1, 5, 10))

_DICT = "dic AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-zA-Z0-9_]+')) AS word FROM documents) GROUP BY word)"
_ASKED = f"asked AS (SELECT unnest([{_words(MISSPELLED)}]) AS word UNION SELECT word FROM (SELECT unnest(string_split_regex(trim(lower(translate(query, {_lit(PUNCTUATION)}, ''))), ' +')) AS word FROM search_query WHERE query_id % 20 = 0) WHERE word <> ''), unknown AS (SELECT word FROM asked WHERE word NOT IN (SELECT word FROM dic))"
_USABLE = f"usable AS (SELECT word AS candidate, cnt FROM dic WHERE word NOT IN ({_words(QUERY_STOP_WORDS)}))"
_EDIT1 = """letters AS (SELECT chr(c::INT) AS c FROM (SELECT unnest(range(97, 123)) AS c)),
 spots AS (SELECT word, unnest(range(0, length(word) + 1)) AS i FROM unknown),
 edits AS (
   SELECT word, left(word, i) || substr(word, i + 2) AS candidate FROM spots WHERE i < length(word)
   UNION SELECT word, left(word, i) || substr(word, i + 2, 1) || substr(word, i + 1, 1) || substr(word, i + 3) FROM spots WHERE i < length(word) - 1
   UNION SELECT word, left(word, i) || c || substr(word, i + 2) FROM spots, letters WHERE i < length(word)
   UNION SELECT word, left(word, i) || c || substr(word, i + 1) FROM spots, letters),
 near1 AS (SELECT word, candidate, cnt FROM edits JOIN usable USING (candidate))"""
_EDIT2 = """near2 AS (SELECT word, candidate, cnt FROM unknown, usable WHERE abs(length(word) - length(candidate)) <= 2 AND damerau_levenshtein(word, candidate) <= 2
   AND len(list_filter(string_split(regexp_replace(candidate, '[a-z]', '', 'g'), ''), lambda c: c <> '' AND NOT contains(word, c))) = 0)"""
_SPELL = f"WITH {_DICT}, {_ASKED}, {_USABLE}, {_EDIT1}, {_EDIT2}"

_NEWEST = """newest AS (SELECT knowledge_id, title, url, "filePath", knowledge, vote, numviews, pagerank FROM (SELECT *, row_number() OVER (PARTITION BY knowledge_id ORDER BY crawled_at DESC) AS k FROM knowledge) WHERE k = 1),
 qa AS (SELECT knowledge_id AS doc_id, concat_ws(' ', title, knowledge) AS text, knowledge AS answer, coalesce(vote, 0) AS vote, coalesce(numviews, 0) AS num_views, CASE WHEN pagerank IS NULL OR isnan(pagerank) THEN 0 ELSE pagerank END AS page_rank FROM newest)"""
_ANSWER = ["table", "return", "null"]
_KNOW = f"WITH {_NEWEST}, {_collection('qa')}, {_hits(_ANSWER)}, {_ql(_ANSWER)}"


def _expansion(left_out: set[str]) -> str:
    return f"""{_LIKELIHOOD}, best AS (SELECT doc_id FROM ql {_TOP}),
 top AS (SELECT term, sum(tf) AS tf FROM term_doc WHERE doc_id IN (SELECT doc_id FROM best) AND term NOT IN ({_words(left_out)}) GROUP BY term ORDER BY tf DESC, term LIMIT 8)
 SELECT term, round(tf / (SELECT sum(tf) FROM top)::DOUBLE, 6) AS prob FROM top"""


def _html(x: str) -> str:
    out = x
    for pattern in ("(?s)<!--.*?-->", "(?is)<script[^>]*>.*?</script>", "(?is)<style[^>]*>.*?</style>", "(?s)</?[A-Za-z][^>]*>"):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    names = ", ".join(f"{_lit(k)}: {_lit(v)}" for k, v in named_entities().items())
    name = f"regexp_extract(p, '{ENTITY}', 1)"
    code = f"CASE WHEN lower(left({name}, 2)) = '#x' THEN ('0x' || substr({name}, 3))::BIGINT WHEN left({name}, 1) = '#' THEN substr({name}, 2)::BIGINT END"
    char = f"CASE WHEN left({name}, 1) = '#' THEN chr(({code})::INT) ELSE element_at(MAP {{{names}}}, {name})[1] END"
    read = f"list_transform(string_split({out}, '&')[2:], lambda p: coalesce({char} || substr(p, length({name}) + 2), '&' || p))"
    out = f"CASE WHEN contains({out}, '&') THEN string_split({out}, '&')[1] || array_to_string({read}, '') ELSE {out} END"
    return f"trim(regexp_replace({out}, '{_SPACE}', ' ', 'g'))"


def _encoded(x: str) -> str:
    return f"replace(replace(replace(url_encode({x}), '%20', '+'), '~', '%7E'), '%2A', '*')"


def _bare(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '[<>&\\x00-\\x20\\x{{0085}}\\x{{00A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g')"


def _snippet(tokens: tuple[str, ...] = ("null", "close", "buffer")) -> str:
    """The query snippet, token by token in nested selects."""
    sql = "SELECT doc_id, text, lower(text) AS body, 1::BIGINT AS start, '...' AS out FROM documents"
    size = 250 // len(tokens)
    for t in tokens:
        found = f"(CASE WHEN instr(substr(body, start), '{t}') > 0 THEN instr(substr(body, start), '{t}') + start - 1 ELSE 0 END)"
        sql = f"SELECT doc_id, text, body, CASE WHEN place > 0 THEN place + {size} ELSE 1 END AS start, CASE WHEN place > 0 THEN out || substr(body, place, {size}) || '...' ELSE out END AS out FROM (SELECT *, {found} AS place FROM ({sql}))"
    return f"SELECT doc_id, left(text, 250) || '...' AS lead, CASE WHEN length(out) < 10 THEN left(text, 250) || '...' WHEN text IS NULL THEN NULL ELSE out END AS snippet FROM ({sql})"


_RESOLVE = """WITH parts AS (SELECT 'P' || p_partkey AS name, p_partkey % 5 = 0 AS moved FROM part),
 names AS (SELECT name FROM parts UNION ALL SELECT name || '.html' FROM parts WHERE moved),
 pairs AS (SELECT 'P' || a.l_partkey AS src, 'P' || b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1),
 moved AS (SELECT name, name || '.html' AS target FROM parts WHERE moved),
 nodes AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM moved))
 SELECT DISTINCT src, coalesce(target, dst) AS dst FROM pairs LEFT JOIN moved ON moved.name = dst WHERE src IN (SELECT name FROM nodes) AND coalesce(target, dst) IN (SELECT name FROM nodes)"""


def _steps() -> str:
    """The SELECT of the full stems of ``dic``, after ``stems`` of its words."""
    sql, n = "SELECT w, term AS t FROM stems", 0

    def step(rest: str, then: str, extra: str = "") -> None:
        nonlocal sql, n
        n += 1
        sql = f"SELECT w, CASE WHEN {then} END AS t FROM (SELECT *, {_shape('rest')} AS form FROM (SELECT *, {rest} AS rest FROM (SELECT *{extra} FROM ({sql}))))"

    m = "((length(form) - length(replace(form, 'vc', ''))) / 2)"
    step("CASE WHEN ends_with(t, 'y') THEN left(t, length(t) - 1) END", "contains(form, 'v') THEN rest || 'i' ELSE t")
    for pairs in (_LONG, _MIDDLE):
        found = "CASE " + " ".join(f"WHEN ends_with(t, '{a}') THEN '{a}'" for a, _ in sorted(pairs, key=lambda p: -len(p[0]))) + " END AS suf"
        instead = "CASE suf " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + " END"
        step("left(t, length(t) - length(suf))", f"{m} > 0 THEN rest || {instead} ELSE t", ", " + found)
    found = "CASE " + " ".join(f"WHEN ends_with(t, '{a}') THEN '{a}'" for a in sorted(_LAST, key=lambda p: -len(p))) + " END AS suf"
    step("left(t, length(t) - length(suf))", f"{m} > 1 AND (suf <> 'ion' OR right(rest, 1) IN ('s', 't')) THEN rest ELSE t", ", " + found)
    step("CASE WHEN ends_with(t, 'e') THEN left(t, length(t) - 1) END", f"{m} > 1 OR {m} = 1 AND NOT (ends_with(form, 'cvc') AND right(rest, 1) NOT IN ('w', 'x', 'y')) THEN rest ELSE t")
    step("CASE WHEN ends_with(t, 'll') THEN left(t, length(t) - 1) END", f"{m} > 1 THEN rest ELSE t")
    return f"SELECT w AS word, CASE WHEN length(w) < 3 THEN w ELSE t END AS stem FROM ({sql})"


_TITLE_WORDS = f"len(list_intersect(list_filter(string_split_regex(string_split_regex(text, '\\r\\n|\\r|\\n')[1], '{_SPACE}'), lambda x: x <> ''), ['Best', 'warum', 'Cómo'])) > 0"

def _renamed(sql: str, *names: str) -> str:
    """CTEs ``names`` of ``sql`` with a q before the name, beside those of the collection."""
    for n in names:
        sql = sql.replace(f"{n} AS", f"q{n} AS").replace(f"FROM {n}", f"FROM q{n}")
    return sql


_LOG = f"""
 qparts AS (SELECT query_id, unnest(p) AS part, generate_subscripts(p, 1) AS k FROM (SELECT query_id, regexp_extract_all(query, '"[^"]*"|[^"]+') AS p FROM search_query)),
 qlists AS (SELECT query_id, k, starts_with(part, '"') AS quoted, list_filter(string_split_regex(replace(part, '"', ''), '{_SPACE}'), lambda x: x <> '') AS ws FROM qparts),
 qraw AS (SELECT query_id, k, quoted, len(ws) AS n, unnest(ws) AS raw, generate_subscripts(ws, 1) - 1 AS i FROM qlists),
 qwords AS (SELECT *, translate(lower(raw), {_lit(PUNCTUATION)}, '') AS w FROM qraw),
 {_renamed(_stems("qwords"), "s1", "s2", "s3", "stems")},
 said AS (SELECT query_id, k, i, n, quoted AND n > 1 AS in_phrase, CASE WHEN quoted AND n = 1 THEN raw ELSE term END AS term FROM qwords JOIN qstems USING (w) WHERE quoted OR term NOT IN ({_words(QUERY_STOP_WORDS)})),
 q AS (SELECT query_id, term, count(*) AS qtf FROM said GROUP BY query_id, term),
 qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
 phrases AS (SELECT query_id, k, i, n, term FROM said WHERE in_phrase),
 pn AS (SELECT query_id, count(DISTINCT k) AS n_phrases FROM phrases GROUP BY query_id),
 starts AS (SELECT query_id, k, doc_id FROM phrases JOIN postings USING (term) GROUP BY query_id, k, n, doc_id, pos - i HAVING count(*) = n),
 held AS (SELECT query_id, doc_id, count(DISTINCT k) AS n_held FROM starts GROUP BY query_id, doc_id)"""

SQL = {
    "tokenize_stem": f"{_C} SELECT raw, term, count(*) AS n FROM stripped JOIN stems USING (w) GROUP BY raw, term",
    "postings": f"{_C} SELECT term, doc_id, pos FROM postings",
    "term_stats": f"{_C} SELECT term, df, ctf FROM term_stats",
    "doc_stats": f"{_FULL} SELECT doc_id, length, round(coalesce(pr, 0), 6) AS page_rank, coalesce(views, 0) AS num_views FROM lens LEFT JOIN r2 ON r2.name = doc_id LEFT JOIN views ON views.name = doc_id",
    "corpus_scalars": f"{_C} SELECT num_docs, total_terms FROM scalars",
    "doc_term_map": f"{_C} SELECT doc_id, term, tf FROM term_doc WHERE doc_id % 20 = 0",
    "match_conjunctive": f"{_C}, {_hits(_T)} SELECT doc_id FROM hits",
    "match_phrase": f"{_C}, {_hits(_P, _PHRASES)} SELECT doc_id FROM hits",
    "match_title_any": f"SELECT doc_id FROM documents WHERE {_TITLE_WORDS}",
    "rank_ql": _LIKELIHOOD + " " + _PAGE.format("ql"),
    "rank_ql_page2": _LIKELIHOOD + " " + _PAGE.format("ql").replace("LIMIT 10", "LIMIT 10 OFFSET 10"),
    "rank_ql_batch": f"""{_C},
 qlists AS (SELECT query_id, list_filter(string_split_regex(lower(replace(query, '"', ' ')), '{_SPACE}'), lambda x: x <> '' AND NOT starts_with(x, 'http')) AS ws FROM search_query),
 qwords AS (SELECT query_id, translate(w, {_lit(PUNCTUATION)}, '') AS w FROM (SELECT query_id, unnest(ws) AS w FROM qlists)),
 {_stems("qwords").replace("s1 AS", "q1 AS").replace("FROM s1", "FROM q1").replace("s2 AS", "q2 AS").replace("FROM s2", "FROM q2").replace("s3 AS", "q3 AS").replace("FROM s3", "FROM q3").replace("stems AS", "qstems AS")},
 q AS (SELECT query_id, term, count(*) AS qtf FROM qwords JOIN qstems USING (w) WHERE term NOT IN ({_words(QUERY_STOP_WORDS)}) GROUP BY query_id, term),
 qn AS (SELECT query_id, count(*) AS n FROM q GROUP BY query_id),
 rows AS (SELECT query_id, doc_id, sum(qtf * log2(0.5::DOUBLE * tf / length + 0.5::DOUBLE * ctf / total_terms)) AS score, count(*) AS hit FROM q JOIN term_doc USING (term) JOIN term_stats USING (term) JOIN lens USING (doc_id), scalars GROUP BY query_id, doc_id),
 ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM rows JOIN qn USING (query_id) WHERE hit = n AND score <> 0)
 SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked WHERE rank <= 10""",
    "rank_ql_log": f"""{_C}, {_LOG},
 rows AS (SELECT query_id, doc_id, sum(qtf * log2(0.5::DOUBLE * tf / length + 0.5::DOUBLE * ctf / total_terms)) AS score, count(*) AS hit FROM q JOIN term_doc USING (term) JOIN term_stats USING (term) JOIN lens USING (doc_id), scalars GROUP BY query_id, doc_id),
 ranked AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank
   FROM rows JOIN qn USING (query_id) LEFT JOIN pn USING (query_id) LEFT JOIN held USING (query_id, doc_id) WHERE hit = n AND score <> 0 AND coalesce(n_phrases, 0) = coalesce(n_held, 0))
 SELECT query_id, doc_id, round(score, 6) AS score, rank FROM ranked JOIN search_query USING (query_id) WHERE rank <= coalesce(numdocs, 10)""",
    "rank_comprehensive": f"""{_FULL}, {_hits(_P, _PHRASES)}, {_ql(_P)},
 full_score AS (SELECT doc_id, 0.65::DOUBLE * score + 0.2::DOUBLE * sqrt(coalesce(pr, 0) + 1) + 0.15::DOUBLE * log2(coalesce(views, 0) + 1.0::DOUBLE) AS score FROM ql LEFT JOIN r2 ON r2.name = doc_id LEFT JOIN views ON views.name = doc_id) {_PAGE.format("full_score")}""",
    "rank_cosine": f"""{_C}, {_hits(_T)},
 w AS (SELECT term, doc_id, (log2(tf) + 1) * log2(num_docs / df::DOUBLE) AS w FROM term_doc JOIN hits USING (doc_id) JOIN term_stats USING (term), scalars),
 wq AS (SELECT term, log2(num_docs / df::DOUBLE) AS wq FROM term_stats, scalars WHERE term IN ({_words(_T)})),
 cos AS (SELECT doc_id, sum(w * coalesce(wq, 0)) / (sqrt(sum(w * w)) * (SELECT sqrt(sum(wq * wq)) FROM wq)) AS score FROM w LEFT JOIN wq USING (term) GROUP BY doc_id HAVING sum(w * w) > 0) {_PAGE.format("cos")}""",
    "rank_conjunctive": f"{_C}, {_hits(_P, _PHRASES)}, one AS (SELECT doc_id, 1.0::DOUBLE AS score FROM hits) {_PAGE.format('one')}",
    "rank_numview": f"{_FULL}, {_hits(_T)}, nv AS (SELECT doc_id, log2(views + 1.0::DOUBLE) AS score FROM hits JOIN views ON name = doc_id WHERE views > 0) {_PAGE.format('nv')}",
    "rank_fullscan": f"SELECT doc_id, CASE WHEN {_TITLE_WORDS} THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM documents",
    "knowledge_top1_ql": f"{_KNOW} SELECT doc_id, round(score, 6) AS score, answer FROM ql JOIN qa USING (doc_id) ORDER BY round(ql.score, 9) DESC, doc_id LIMIT 1",
    "knowledge_top1_comprehensive": f"""{_KNOW}, k AS (SELECT doc_id, answer, 0.6::DOUBLE * score + 0.1::DOUBLE * sqrt(page_rank + 1) + 0.05::DOUBLE * log2(num_views + 1.0::DOUBLE) + 0.35::DOUBLE * CASE WHEN vote >= 0 THEN log2(vote + 1.0::DOUBLE) ELSE 0 END AS s FROM ql JOIN qa USING (doc_id))
 SELECT doc_id, round(s, 6) AS score, answer FROM k ORDER BY round(s, 9) DESC, doc_id LIMIT 1""",
    "tag_gate": f"SELECT DISTINCT query_id FROM (SELECT query_id, unnest(string_split_regex(trim(lower(translate(query, {_lit(PUNCTUATION)}, ''))), ' +')) AS tag FROM search_query) WHERE tag IN ({_words(TAGS)})",
    "link_extract": """SELECT result_id AS src, unnest(regexp_extract_all(line, '<[a|A].*?href="/?([^ /#"]*)".*?>', 1)) AS dst FROM (SELECT result_id, unnest(string_split_regex(max(snippet), '\\r\\n|\\r|\\n')) AS line FROM scored_document GROUP BY result_id)""",
    "link_targets": _RESOLVE.split(" moved AS")[0].rstrip(", \n").replace("SELECT 'P' || a", "SELECT DISTINCT 'P' || a") + " SELECT src, dst FROM pairs",
    "redirect_resolve": _RESOLVE,
    "full_stems": f"WITH {_DICT}, words AS (SELECT word AS w FROM dic), {_stems('words')} {_steps()}",
    "qa_pages": f"""WITH {_NEWEST}, bare AS (SELECT *, {_bare('title')} AS t, {_bare('knowledge')} AS k FROM newest)
 SELECT knowledge_id AS name, trim(t) AS title, trim(trim(t) || ' one two a < b && c') AS question, trim(trim(k) || ' end½') AS answer,
   coalesce(vote, 0)::INT AS vote, coalesce(numviews, 0)::INT AS num_views FROM bare""",
    "page_rank": f"WITH {_GRAPH} SELECT name, round(pr, 6) AS pr FROM r2",
    "num_views": f"WITH {_VIEWS} SELECT name, views FROM views",
    "num_views_stream": "SELECT user_id::VARCHAR AS name, sum(floor(value)::INT)::BIGINT AS views FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL GROUP BY user_id",
    "prf_terms": _expansion(set(EXPANSION_STOP_WORDS)),
    "prf_terms_excl_query": _expansion(set(EXPANSION_STOP_WORDS) | set(_T)),
    "prf_similarity": """WITH once AS (SELECT run_id, max({'c0': c0, 'c1': c1}) AS r FROM prf GROUP BY run_id, pos_in_run),
 runs AS (SELECT run_id, lower(trim(r.c0, E' \\t\\r\\n')) AS term, sum(r.c1) AS prob FROM once WHERE trim(r.c0, E' \\t\\r\\n') <> '' GROUP BY 1, 2),
 pairs AS (SELECT a.run_id AS q1, b.run_id AS q2, sum(sqrt(a.prob * b.prob)) AS coefficient FROM runs a JOIN runs b USING (term) WHERE a.run_id % 20 = 0 AND a.run_id <> b.run_id GROUP BY 1, 2),
 placed AS (SELECT *, row_number() OVER (PARTITION BY q1 ORDER BY round(coefficient, 9) DESC, q2) AS place FROM pairs)
 SELECT q1, q2, round(coefficient, 6) AS coefficient, place FROM placed WHERE place <= 10""",
    "prf_similarity_all": """WITH once AS (SELECT run_id, max({'c0': c0, 'c1': c1}) AS r FROM prf GROUP BY run_id, pos_in_run),
 runs AS (SELECT run_id, lower(trim(r.c0, E' \\t\\r\\n')) AS term, sum(r.c1) AS prob FROM once WHERE trim(r.c0, E' \\t\\r\\n') <> '' GROUP BY 1, 2)
 SELECT a.run_id AS q1, b.run_id AS q2, round(sum(sqrt(a.prob * b.prob)), 6) AS coefficient FROM runs a JOIN runs b USING (term) WHERE a.run_id % 20 = 0 AND a.run_id <> b.run_id GROUP BY 1, 2""",
    "spearman_pr_nv": f"""WITH {_GRAPH}, {_VIEWS}, both_v AS (SELECT name, round(pr, 9) AS pr, views FROM r2 JOIN views USING (name)),
 ranked AS (SELECT row_number() OVER (ORDER BY pr DESC, name) AS a, row_number() OVER (ORDER BY views DESC, name) AS b FROM both_v)
 SELECT count(*) AS n, round(coalesce(corr(a, b), 0), 6) AS rho FROM ranked""",
    "eval_precision_recall_f": f"{RUN}, {_PRF} SELECT query, {_PRF_COLUMNS} FROM prf_m",
    "eval_pr_curve": f"{RUN}, {_CURVE} SELECT query, level, round(precision, 6) AS precision FROM curve",
    "eval_avg_precision": f"{RUN}, {_AP} SELECT query, round(ap, 6) AS ap FROM ap_m",
    "eval_ndcg": f"{RUN}, {_NDCG} SELECT query, {_ND_COLUMNS} FROM nd1 JOIN nd5 USING (query) JOIN nd10 USING (query)",
    "eval_mrr": f"{RUN}, {_RR} SELECT query, round(rr, 6) AS rr FROM rr_m",
    "eval_metrics": f"{RUN}, {_PRF}, {_CURVE}, {_AP}, {_NDCG}, {_RR}, wide AS (SELECT query, "
    + ", ".join(f"max(CASE WHEN level = {i} THEN precision END) AS pr_{i}" for i in range(11))
    + f" FROM curve GROUP BY query) SELECT query, {_PRF_COLUMNS}, "
    + ", ".join(f"round(pr_{i}, 6) AS pr_{i}" for i in range(11))
    + f", round(ap, 6) AS ap, {_ND_COLUMNS}, round(rr, 6) AS rr FROM prf_m JOIN wide USING (query) JOIN ap_m USING (query) JOIN nd1 USING (query) JOIN nd5 USING (query) JOIN nd10 USING (query) JOIN rr_m USING (query)",
    "spell_dictionary": f"WITH {_DICT} SELECT word, cnt FROM dic",
    "spell_edit1": f"{_SPELL} SELECT word, candidate, cnt FROM near1",
    "spell_edit2": f"{_SPELL} SELECT word, candidate, cnt FROM near2",
    "spell_correct": f"""{_SPELL}, levels AS (SELECT word, word AS candidate, 0 AS level, 0 AS cnt FROM asked WHERE word IN (SELECT word FROM dic) UNION ALL SELECT word, candidate, 1, cnt FROM near1 UNION ALL SELECT word, candidate, 2, cnt FROM near2),
 best AS (SELECT word, candidate, row_number() OVER (PARTITION BY word ORDER BY level, cnt DESC, candidate) AS k FROM levels)
 SELECT asked.word, coalesce(candidate, asked.word) AS correction FROM asked LEFT JOIN best ON best.word = asked.word AND k = 1""",
    "html_text_title": f"""WITH {_NEWEST}, pages AS (SELECT knowledge_id, '<html><head><title>' || coalesce(title, '') || '</title></head><body>' || coalesce(knowledge, '') || '</body></html>' AS html FROM newest)
 SELECT knowledge_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '{_SPACE}', ' ', 'g')) AS title, {_html("html")} AS text FROM pages""",
    "snippet": _snippet(),
    "title_encoded": "SELECT result_id, replace(replace(replace(url_encode(max(title)), '%20', '+'), '~', '%7E'), '%2A', '*') AS title FROM scored_document GROUP BY result_id",
    "result_lines": f"""WITH once AS (SELECT result_id, max(doc_id) AS doc_id, max(title) AS title, max(url) AS url, max("filePath") AS fp, floor(max(score) * 1e6 + 0.5)::DECIMAL(20,0) * 0.000001::DECIMAL(6,6) AS score,
   floor(coalesce(CASE WHEN NOT isnan(max(pagerank)) THEN max(pagerank) END, 0) * 1e6 + 0.5)::DECIMAL(20,0) * 0.000001::DECIMAL(6,6) AS pr, coalesce(max(numviews), 0) AS nv, max(snippet) AS snippet FROM scored_document GROUP BY result_id)
 SELECT result_id, doc_id || chr(9) || coalesce(title, '') || chr(9) || score || chr(9) || 'PR:' || pr || chr(9) || 'NV:' || nv || chr(9) AS line,
   '{{"id":' || doc_id || ',"title":"' || {_encoded("coalesce(title, '')")} || '","url":"' || coalesce(url, '') || '","filePath":"' || coalesce(fp, '') || '","score":' || score || ',"pagerank":' || pr || ',"numviews":' || nv || ',"snippet":"' || {_encoded("coalesce(snippet, '')")} || '"}}' AS json FROM once""",
    "same_content": "SELECT doc_id FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL)",
    "request_search": f"""{_FULL}, {_hits(_T)}, {_ql(_T)}, titles AS (SELECT doc_id, string_split_regex(text, '\\r\\n|\\r|\\n')[1] AS title, concat_ws('/', lower(source), name) AS url, concat_ws('/', 'data', kind, name) AS fp FROM documents),
 snips AS ({_snippet(tuple(_T))}),
 full_score AS (SELECT doc_id, coalesce(pr, 0) AS page_rank, coalesce(views, 0) AS num_views, 0.65::DOUBLE * score + 0.2::DOUBLE * sqrt(coalesce(pr, 0) + 1) + 0.15::DOUBLE * log2(coalesce(views, 0) + 1.0::DOUBLE) AS score FROM ql LEFT JOIN r2 ON r2.name = doc_id LEFT JOIN views ON views.name = doc_id)
 SELECT doc_id AS id, coalesce(title, '') AS title, url, fp AS "filePath", round(full_score.score, 6) AS score, round(page_rank, 6) AS pagerank, num_views AS numviews, coalesce(snippet, '') AS snippet
 FROM full_score JOIN titles USING (doc_id) JOIN snips USING (doc_id) ORDER BY round(full_score.score, 9) DESC, doc_id LIMIT 7 OFFSET 7""",
    "request_know": f"""{_KNOW}, more AS (SELECT knowledge_id, coalesce(url, '') AS url, coalesce("filePath", '') AS fp FROM newest),
 k AS (SELECT doc_id, answer, page_rank, num_views, vote, 0.6::DOUBLE * score + 0.1::DOUBLE * sqrt(page_rank + 1) + 0.05::DOUBLE * log2(num_views + 1.0::DOUBLE) + 0.35::DOUBLE * CASE WHEN vote >= 0 THEN log2(vote + 1.0::DOUBLE) ELSE 0 END AS s FROM ql JOIN qa USING (doc_id))
 SELECT doc_id AS id, coalesce(newest.title, '') AS title, more.url, fp AS "filePath", coalesce(answer, '') AS knowledge, round(s, 6) AS score, round(page_rank, 6) AS pagerank, num_views AS numviews, k.vote
 FROM k JOIN more ON more.knowledge_id = doc_id JOIN newest ON newest.knowledge_id = doc_id ORDER BY round(s, 9) DESC, doc_id LIMIT 1""",
    "request_prf": _expansion(set(EXPANSION_STOP_WORDS)),
}
