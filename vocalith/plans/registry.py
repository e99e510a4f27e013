"""All queries over the synthetic tables, with their SQL."""

from __future__ import annotations

from vocalith.plans import corpus, curation, evaluation, frames, gates, listening, service, sources

BOOKS = [sources.book, gates.book, curation.book, corpus.book, frames.book, service.book, evaluation.book, listening.book]


def queries() -> dict:
    return {name: f for b in BOOKS for name, f in b.queries.items()}


def oracles() -> dict:
    return {name: sql for b in BOOKS for name, sql in b.oracles.items()}
