"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from urdimbre.llm import conversations, language, mixture, quantiles, scans, sentences, splits, tokens

MODULES = (conversations, scans, quantiles, splits, language, tokens, mixture, sentences)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
