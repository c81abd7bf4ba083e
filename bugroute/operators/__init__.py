"""bugroute operators."""
