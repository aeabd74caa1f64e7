"""Document-transcription analytics as DataFrame, SQL and Structured Streaming operations."""
