"""Message-log analytics on PySpark."""
