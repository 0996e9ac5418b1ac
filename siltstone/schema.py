"""Columns and ranks shared by every stage."""

from __future__ import annotations

# Labels and their order.
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")

#: One row for each file: the relation that every detector reads. ``path_key`` orders files by path component.
FILES = "path string, path_key array<string>, file string, package string, name string, ext string, text string, locked boolean"

#: The public columns of a finding, in report order.
PUBLIC = ("cwe_id", "cwe_name", "severity", "confidence", "package", "file", "line", "code", "description", "zero_day_relevance")
#: Columns that order findings and decide filters; dropped at the sinks.
ORDER = ("path_key", "check_ord", "part", "at", "emit")
