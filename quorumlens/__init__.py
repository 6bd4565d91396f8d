"""Memories of meetings from transcripts, kept, searched, linked and counted as Spark DataFrames."""
