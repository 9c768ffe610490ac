"""Plans, fixtures and queries."""
