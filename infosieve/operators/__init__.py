"""Distributed operators of the selection engine."""
