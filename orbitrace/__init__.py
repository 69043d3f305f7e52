"""Trajectory, surface-field and region analytics expressed as Spark DataFrame operators."""
