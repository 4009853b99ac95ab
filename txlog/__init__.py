"""Spark jobs over transaction logs of a web cache."""
