"""keyloom.plans."""
