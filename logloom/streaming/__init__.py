"""Stateful processing of group operations."""
