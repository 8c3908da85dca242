"""Reading loads, publications and rule files; writing the monitor's own tables."""
