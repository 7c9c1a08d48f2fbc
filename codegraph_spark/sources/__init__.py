"""Reading source files and graph documents; writing graphs."""
