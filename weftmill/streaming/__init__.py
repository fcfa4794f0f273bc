"""Stateful operators for Structured Streaming, with batch twins."""
