"""Operators for large text corpora: rules, deduplication, language, tokens, links, quality, secrets, mixing, scoring.

Nothing else in the library imports this subpackage; ``queries`` has its registered queries.
"""
