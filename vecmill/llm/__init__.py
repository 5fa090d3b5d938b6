"""Operators for preparing language-model training corpora.

Nothing outside this folder, the pipeline script and the entry point imports it.
"""
