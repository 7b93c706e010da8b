"""keyloom.operators."""
