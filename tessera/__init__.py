"""Sketches, projections, retrieval and matrix analytics as PySpark DataFrame operators."""
