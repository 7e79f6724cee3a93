"""Tree kernel: annotation, rendering, traversal, matching, rewriting."""
