"""All registered queries of the library proper, with their SQL."""

from __future__ import annotations

from tidemark.queries import engine, frequency, samples, series, similarity

ALL = {**frequency.QUERIES, **samples.QUERIES, **series.QUERIES, **similarity.QUERIES, **engine.QUERIES}


def queries():
    return {name: q for name, (q, _) in ALL.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in ALL.items() if sql}
