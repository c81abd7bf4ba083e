"""Training-data pipeline operators (one module each) and their queries.

Nothing outside this subpackage imports it; ``__spark_entry__`` registers
``bugroute.llm.queries`` when the subpackage is present.
"""
