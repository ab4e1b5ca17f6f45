"""Sentiment analytics for short social texts, expressed as Spark DataFrame jobs."""
