"""Inputs that arrive in chunks: micro-batches with checkpoints, idempotent parts and running counts."""
