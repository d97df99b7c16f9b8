"""Brick-assembly analytics as Spark DataFrame operators."""
