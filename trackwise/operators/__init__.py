"""Relational operators over the network's data sets."""
