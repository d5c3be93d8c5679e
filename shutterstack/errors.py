"""Errors the library raises."""


class CatalogError(Exception):
    """Base of all errors of the library."""


class NotFoundError(CatalogError):
    """A folder, file or row that has to be there is missing."""


class QueryError(CatalogError):
    """A search or a parameter that makes no sense."""


class StorageError(CatalogError):
    """A table can't be read or written as asked."""
