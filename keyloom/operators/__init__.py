"""The operators: profiles, keys, inclusion dependencies, selection, quality checks and recommendations."""
