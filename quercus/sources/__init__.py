"""quercus.sources."""
