"""Operators on tables: lines, sections, chunks, retrieval, scoring, evaluation."""
