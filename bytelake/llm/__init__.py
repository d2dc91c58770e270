"""Operations of a training-data pipeline over tables of documents, vectors and urls.

Nothing else in the library imports this subpackage.
"""
