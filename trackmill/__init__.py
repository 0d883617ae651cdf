"""Trajectory analytics as Spark jobs: cleaning, segmenting, gridding, transport diagnostics."""
