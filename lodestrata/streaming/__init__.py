"""Filings that arrive as files, taken into the store as they come."""
