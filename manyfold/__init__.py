"""Spark-first analytics over data that carries several, possibly contradictory, interpretations."""
