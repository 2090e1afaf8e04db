"""varietas.streaming."""
