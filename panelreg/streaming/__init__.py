"""Scoring rows that arrive later."""
