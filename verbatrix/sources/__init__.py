"""Readers and writers: HTML filings and transcripts, blocks as JSON lines, questions and runs, chunk collections."""
