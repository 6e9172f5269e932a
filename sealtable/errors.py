"""Errors of the engine. ValueError and TypeError are used as such for bad rows and fields."""


class SealError(Exception):
    """Base of all errors below."""


class DatabaseError(SealError):
    """The database can't be opened, read or restored."""


class TableError(SealError):
    """A table is missing, or there already."""


class NotFoundError(TableError):
    """There is no table of this name."""


class DuplicateError(TableError):
    """There is a table of this name already."""


class IndexFailure(SealError):
    """A secondary index is missing, there already, or on no column."""


class HashError(SealError):
    """A value has no canonical form to hash."""


class IntegrityFailure(SealError):
    """Stored hashes do not match their rows."""


class TransactionError(SealError):
    """A transaction is open already, not open, or unknown."""


class CorruptedError(DatabaseError):
    """A manifest can't be read."""


class ConflictError(DatabaseError):
    """Another writer committed first."""
