"""Operators for training-data pipelines; nothing else in partyframe imports this subpackage."""
