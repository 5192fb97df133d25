"""Marginalia: document forensics and corpus analytics as Spark DataFrame transformations."""
