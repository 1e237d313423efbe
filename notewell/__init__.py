"""Notewell: analytics over free-text customer notes, built from Spark DataFrames.

Every operator takes DataFrames or Columns and returns DataFrames or Columns; the
same column functions serve batch jobs and Structured Streaming jobs.
"""

__all__ = ["functions", "operators", "plans", "sources", "streaming"]
