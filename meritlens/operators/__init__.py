"""Operators on DataFrames: features, matching, scoring, ranking, audits, evaluation."""
