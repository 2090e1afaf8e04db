"""varietas.functions."""
