"""Training-data operators: ten corpus-scale components and their queries.

Nothing else in the library imports this subpackage. Each module holds one
operator with its own general interface; ``queries`` derives the registered
result tables from them.
"""
