"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from .embeddings import SQL as EMBEDDING_SQL
from .embeddings import op8_embedding_near_dedup
from .exact_dedup import SQL as EXACT_SQL
from .exact_dedup import op10_exact_dedup
from .html import op9_html_main_text
from .language import op5_language_id
from .lexical import SQL as LEXICAL_SQL
from .lexical import op12_ranked_search
from .mixing import SQL as MIX_SQL
from .mixing import op3_source_mixing
from .packing import op1_best_fit_packing
from .pieces import op13_piece_round_trip
from .quality import op2_quality_rules
from .secrets import op6_secret_scan
from .simhash import op4_simhash_near_dedup
from .spelling import SQL as SPELLING_SQL
from .spelling import op11_spelling_variants
from .tokens import op7_token_counts

OPERATORS = (
    op1_best_fit_packing, op2_quality_rules, op3_source_mixing, op4_simhash_near_dedup, op5_language_id, op6_secret_scan,
    op7_token_counts, op8_embedding_near_dedup, op9_html_main_text, op10_exact_dedup, op11_spelling_variants, op12_ranked_search, op13_piece_round_trip,
)
QUERIES = {f.__name__: f for f in OPERATORS}
SQL = {"op3_source_mixing": MIX_SQL, "op8_embedding_near_dedup": EMBEDDING_SQL, "op10_exact_dedup": EXACT_SQL, "op11_spelling_variants": SPELLING_SQL,
       "op12_ranked_search": LEXICAL_SQL}
