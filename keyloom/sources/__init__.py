"""keyloom.sources."""
