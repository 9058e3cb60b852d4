"""Named queries over the test tables, each with its SQL oracle where SQL can say it."""

from __future__ import annotations


def _load():
    from matchloom.plans import corpus_queries, match_queries, model_queries, phrase_queries, registry, screen_queries, source_queries, text_queries  # noqa: F401

    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
