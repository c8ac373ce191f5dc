"""All queries of the subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, html_text, importance, line_dedup, near_dedup, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, toxicity

MODULES = (line_dedup, token_counts, quality_rules, decontaminate, html_text, near_dedup, toxicity, sentencepiece_codec, importance, suffix_dedup)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
