"""quercus."""
