"""Corpus operators for training-data pipelines: one module per operator, plus shared helpers.

Nothing outside this subpackage imports it; ``gridlace.llm.registry`` lists its queries.
"""
