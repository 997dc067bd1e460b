"""Column-level building blocks: fixed vocabularies, string, numeric and predicate functions."""

from . import numeric, predicates, text, vocab  # noqa: F401
