"""Mutations as streams."""

from orrery.streaming.mutations import apply_mutations, latest_state

__all__ = ["apply_mutations", "latest_state"]
