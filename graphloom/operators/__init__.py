"""Relational, graph and ranking operators."""
