"""Training-data operators: one module for each, all over whole tables and whole texts.

Nothing outside this subpackage imports it.  ``queries.py`` lists the registered queries.
"""
