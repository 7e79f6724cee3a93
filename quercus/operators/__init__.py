"""quercus.operators."""
