"""Revision diffing of structured documents and tables as Spark jobs."""
