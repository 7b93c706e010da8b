"""keyloom.streaming."""
