"""Queries of the corpus operators and the SQL that some of them can be held against."""

from __future__ import annotations

from . import oracles
from .bpe_roundtrip import op4_bpe_roundtrip
from .collocations import op13_collocations
from .decontaminate import op8_decontaminate
from .licences import op10_licences
from .line_dedup import op3_line_dedup
from .ngram_join import op12_jaccard_join
from .near_dup import op2_near_dup
from .neighbours import op5_neighbours
from .quality import op6_quality
from .shards import op9_shards
from .spelling import op11_spelling
from .token_store import op1_token_store
from .url_rules import op7_url_rules

QUERIES = {
    f.__name__: f
    for f in (op1_token_store, op2_near_dup, op3_line_dedup, op4_bpe_roundtrip, op5_neighbours, op6_quality, op7_url_rules, op8_decontaminate, op9_shards, op10_licences, op11_spelling, op12_jaccard_join, op13_collocations)
}
ORACLE_SQL: dict[str, str] = oracles.SQL
