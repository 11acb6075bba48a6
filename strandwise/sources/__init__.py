"""Readers of alignments, gene models, sequences, tables and signal tracks; text sinks."""
