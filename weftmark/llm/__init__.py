"""Operators of a training-data pipeline; optional, imported by nothing else."""
