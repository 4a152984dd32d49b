"""Training-data operators: one module per operator, each with its own general interface.

``queries.py`` holds the thin ``opN_<name>`` queries over the shared tables and their SQL.
"""
