"""Operations of a training-data pipeline over text, chat and vector tables.

Nothing else in the library imports this subpackage; it can be removed whole.
"""
