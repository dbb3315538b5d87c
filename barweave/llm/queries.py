"""All queries of the subpackage, in one place."""

import corpus_pipeline
from barweave.llm import hard_negatives, html_text, language, lattice, mixing, near_dedup, nearest, packing, quality, ranked_search, rules, tokens, url_filter  # noqa: F401
from barweave.llm.base import QUERIES, query

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

__all__ = ["QUERIES"]
