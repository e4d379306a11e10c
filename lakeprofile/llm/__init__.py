"""Operators for preparing training data: cleaning, deduplication, decontamination, scoring, search and encoding."""
