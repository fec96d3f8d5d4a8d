"""Operators for preparing text corpora at scale; see README.md, "llm"."""
