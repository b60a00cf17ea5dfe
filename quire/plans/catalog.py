"""Importing the query modules fills the registry."""

from quire.plans import (  # noqa: F401
    queries_books,
    queries_cache,
    queries_corpus,
    queries_evaluation,
    queries_extraction,
    queries_questions,
    queries_retrieval,
    queries_storage,
    queries_streaming,
    queries_text,
    queries_validation,
)
from quire.plans.registry import oracles, queries  # noqa: F401
