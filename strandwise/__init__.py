"""Sequencing quality-control analytics and training-data operators on Spark."""
