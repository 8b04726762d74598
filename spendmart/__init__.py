"""Token-usage and spend analytics for AI-assistant transcripts, as Spark DataFrame operators."""
