"""quarrymill: a PySpark-native analytics engine for software-knowledge data.

Operators are functions from DataFrame to DataFrame, grouped by kind:

* ``sources``    readers and writers, with explicit schemas
* ``functions``  column expressions and small numeric routines
* ``operators``  relational, statistical, graph, temporal and set-merge operators
* ``plans``      session settings, lineage cutting, composed reports
* ``streaming``  Structured Streaming forms
* ``queries``    the registered queries and their SQL counterparts
* ``llm``        text and training-data operators; nothing else imports it
"""
