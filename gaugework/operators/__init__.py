"""Profiling, privacy, synthesis and checks on data."""
