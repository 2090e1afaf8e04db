"""varietas.sources."""
