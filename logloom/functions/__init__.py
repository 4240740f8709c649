"""Column functions on topics, properties and arguments."""
