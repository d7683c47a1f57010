"""Structured Streaming form of the message rate limiter."""
