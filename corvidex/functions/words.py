"""The word lists and character sets that results depend on."""

from __future__ import annotations

# Characters that are removed wherever they stand in a word.
PUNCTUATION = ".,!?;:()[]=^*'\"。，！；：‘’“”\\#•"

# Words that a query drops, tested after stemming.
QUERY_STOP_WORDS = frozenset(
    "the of and in & to ^ is for on as by was with from that at it are this edit retrieved or - / an be which his also has not were he have a their had been can you she other its about her there no they 1 n/a may wikipedia up down vote stack overflow such so".split()
)

# Words that never are expansion terms.
EXPANSION_STOP_WORDS = frozenset(
    "the of and in & to ^ is for on as by was with from that at it are this edit retrieved or - / an be which his also has not were he have a their had by been can you your but i she other its about her there no they 1 n/a may wikipedia up down vote stack overflow editÂ\xa0Â\xa0 • | ► – such all any most 2010 2012 2011 2009 2008 2007 more 2 3 4 5 { } one two if".split(" ")
)

# Gain of each grade of relevance; any other grade has none.
GAINS = {"Perfect": 10.0, "Excellent": 7.0, "Good": 5.0, "Fair": 1.0, "Bad": 0.0}

# Weights of the scores in the comprehensive rankings.
WEIGHTS = {"ql": 0.65, "pagerank": 0.2, "views": 0.15}
KNOWLEDGE_WEIGHTS = {"ql": 0.6, "pagerank": 0.1, "views": 0.05, "vote": 0.35}
