"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it; removing the folder removes the
operators, their queries and their SQL together.
"""
