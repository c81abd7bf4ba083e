"""Column -> Column helpers (all JVM-side built-ins, no Python UDFs)."""

from bugroute.functions.arrays import (  # noqa: F401
    clear_nan_values,
    one_hot_array,
    pad_array,
    unit_vector,
)
from bugroute.functions.text import (  # noqa: F401
    escape_word,
    java_split,
    sentence_array,
    groups_of,
    padded_words,
    token_array,
    trim_trailing_empty,
    unescape_word,
    word_array,
    word_group_arrays,
)
