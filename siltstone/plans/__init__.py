"""Plan helpers: lineage cuts, size-checked broadcasts, session settings."""
