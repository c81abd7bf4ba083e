"""bugroute plans."""
