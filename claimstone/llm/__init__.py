"""Operators that prepare text corpora for language-model training.

Nothing outside this package (and the pipeline and entry modules) imports it.
"""
