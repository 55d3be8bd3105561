"""The jobs, built from operators and functions."""
