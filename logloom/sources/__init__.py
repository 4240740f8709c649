"""Message tables and log sources."""
