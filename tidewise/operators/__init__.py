"""Operators of sequences, by kind; ``Seq`` joins them."""
