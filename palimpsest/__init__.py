"""Versioned document analytics on Spark."""
