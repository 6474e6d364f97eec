"""Shape profiling, synthesis and change checks on Spark."""
