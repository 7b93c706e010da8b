"""keyloom.functions."""
