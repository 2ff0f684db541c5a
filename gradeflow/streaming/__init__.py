"""Structured Streaming operators, each with a batch twin that the same rows give the same results in."""
