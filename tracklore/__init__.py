"""Trajectory and cohort analytics as Spark DataFrame operators."""
