"""Counters over alignments that keep arriving."""
