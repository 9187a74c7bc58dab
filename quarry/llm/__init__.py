"""Training-data operators: one module per operator, registered through ``quarry.llm.queries``.

Nothing outside this package imports it.
"""
