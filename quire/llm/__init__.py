"""Operators for text of training corpora. Nothing outside this subpackage imports it."""
