"""Codicil: building, maintaining and querying a searchable document corpus on Spark."""
