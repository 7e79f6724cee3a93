"""quercus.streaming."""
