"""varietas.operators."""
