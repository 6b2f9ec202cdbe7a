"""Where resources, registries and truth come from, and where documents go."""
