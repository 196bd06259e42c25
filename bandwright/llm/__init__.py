"""Operators of a large training-data pipeline, one module each.

Nothing outside this folder imports it. ``queries.py`` registers one query per
operator and ``checks.py`` holds the check SQL of those that SQL can express.
"""
