"""Structured Streaming entry points.

The reference is a batch job; it has no stream operators (no watermark,
window or state).  What a user of it does with new reports is score them, so
this package runs the *same* batch operators on each micro-batch of newly
arrived bug CSV files, with the category lists, class list, word vectors and
model fitted earlier.
"""

from bugroute.streaming.scoring import score_stream  # noqa: F401
