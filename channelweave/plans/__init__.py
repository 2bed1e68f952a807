"""Queries that are composed of operators: decompositions, nulls, studies, reports."""
