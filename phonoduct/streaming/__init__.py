"""Unbounded inputs: framed statistics, sessions and voiced runs of event streams."""
