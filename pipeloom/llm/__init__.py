"""Training-data operators: ten operators over document, embedding and conversation tables.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
``opN_*`` queries, the other modules hold the operators themselves.
"""
