"""Structured Streaming jobs of the intake and the ledger."""
