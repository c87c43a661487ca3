"""Dialogue-act sequence analytics as Spark DataFrame operators."""
