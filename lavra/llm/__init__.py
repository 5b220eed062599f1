"""Training-data operators: thirteen corpus operators and the pipeline built on them.

Nothing outside this subpackage imports it; its registered queries are in
:mod:`lavra.llm.queries`.
"""
