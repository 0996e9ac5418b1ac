"""Detectors and the relational operators over findings."""
