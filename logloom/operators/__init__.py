"""Relational operators over message-log tables."""
