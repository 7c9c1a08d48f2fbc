"""Column functions: paths, texts, graph attributes."""
