"""Importing this package registers every query."""

from quillmill.queries import classification, corpus, dialog, generation, runs, sources  # noqa: F401
from quillmill.queries.registry import ORACLES, QUERIES  # noqa: F401
