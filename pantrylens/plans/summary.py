"""To come."""
