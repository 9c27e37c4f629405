"""Relational operators over documents, spans, tokens and findings."""
