"""Structured Streaming intake: the batch operators on arriving file rows."""
