"""Plan helpers: lineage cuts, connected components, size-checked joins."""
