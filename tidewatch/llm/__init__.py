"""Training-data operators: each module holds one operator and its query.

Nothing outside this folder imports it; ``__spark_entry__`` adds
:func:`tidewatch.llm.registry.queries` only when the folder is there.
"""
