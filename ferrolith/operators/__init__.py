"""Operators over DataFrames: validation, matching, merging, scoring, ranking and sampling."""
