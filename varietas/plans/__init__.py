"""varietas.plans."""
