"""All registered queries: name -> callable(spark, sf_dir) and name -> DuckDB SQL."""

from __future__ import annotations

import importlib

MODULES = [
    "tenura.plans.survival_queries",
    "tenura.plans.explore_queries",
    "tenura.plans.model_queries",
    "tenura.plans.cox_queries",
    "tenura.plans.ml_queries",
]


def _load():
    q, s = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for k in mod.QUERIES:
            if k in q:
                raise ValueError(f"duplicate query name {k}")
        q.update(mod.QUERIES)
        s.update(mod.SQL)
    return q, s


def all_queries():
    return _load()[0]


def all_oracles():
    return _load()[1]
