"""Operators that prepare texts for training and auditing language models. Nothing outside this package imports it."""
