"""Tessella: snapshot analytics on Spark."""
