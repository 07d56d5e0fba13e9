"""Stateful operators, in batch form and on Structured Streaming."""
