"""Code-dependency graphs, code-risk scans and graph queries as Spark jobs."""
