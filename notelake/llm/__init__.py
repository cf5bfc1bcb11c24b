"""Operations of a training-data pipeline over ``documents``-like tables.

Nothing else in the library imports this subpackage.  Each module holds one
operator; ``queries`` binds them to the supplied tables.
"""
