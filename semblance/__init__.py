"""semblance: duplicate, truncated and look-alike content analytics on Spark."""
