"""Polycrystal homogenisation and map analytics as Spark DataFrame operators."""
