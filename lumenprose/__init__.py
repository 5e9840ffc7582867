"""Controlled-language analytics on Spark."""
