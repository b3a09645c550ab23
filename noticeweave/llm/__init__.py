"""Operators that prepare texts for training and retrieval. Nothing outside this subpackage imports it."""
