"""Queries of this subpackage by name."""

from . import bpe, decontaminate, html_text, licenses, lm_scoring, near_dedup, quality_classifier, quality_rules, token_files, toxicity

_modules = [bpe, token_files, quality_rules, quality_classifier, licenses, decontaminate, toxicity, html_text, near_dedup, lm_scoring]
QUERIES = {k: v for m in _modules for k, v in m.QUERIES.items()}
SQL = {k: v for m in _modules for k, v in m.SQL.items()}
