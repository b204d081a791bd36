"""The queries of this package and their DuckDB texts."""

from __future__ import annotations

from tenura.llm import (alignment, chat, decontam, html, minhash, packing, quality, simhash, substrings, tokencounts, tokenfile,
                        toxicity, vectorcodes)

MODULES = [substrings, tokenfile, packing, tokencounts, simhash, toxicity, html, chat, quality, decontam,
           alignment, minhash, vectorcodes]


def queries() -> dict:
    return {k: q for m in MODULES for k, q in m.QUERIES.items()}


def oracles() -> dict:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
