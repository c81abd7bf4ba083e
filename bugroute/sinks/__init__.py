"""Sinks: bug CSV fixtures, word-vector text formats, bundles, model files."""
