"""Relational tables as queries, nested documents and property graphs on Spark."""
