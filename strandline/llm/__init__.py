"""Training-data operators: one module per operator, plus shared byte-level helpers.

Nothing outside this folder imports it but ``corpus_pipeline`` and ``__spark_entry__``; ``queries.queries()`` and
``queries.oracle_sql()`` hand out the thin registered queries and their SQL.
"""
