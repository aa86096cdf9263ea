"""Errors with details that a program can read."""

from __future__ import annotations


class TidemarkError(Exception):
    """The root of all errors raised on purpose; details says what it was about."""

    def __init__(self, message: str, **details):
        super().__init__(message)
        self.message, self.details = message, {k: v for k, v in details.items() if v is not None}


class SessionNotFound(TidemarkError):
    """No session of that key."""


class SessionExists(TidemarkError):
    """A session of that key is there already."""


class InvalidSession(TidemarkError):
    """Session metadata lacks what it needs."""


class EventNotFound(TidemarkError):
    """No event of that id."""


class EventTooLarge(TidemarkError):
    """An event is beyond the size that is stored."""


class InvalidValue(TidemarkError, ValueError):
    """An argument or stored value is outside its range."""


class StorageFailure(TidemarkError):
    """Reading or writing a table failed."""


class ConnectionFailure(StorageFailure):
    """The storage can't be reached."""


class AuthenticationFailure(ConnectionFailure):
    """The storage refused the credentials."""


class PermissionDenied(TidemarkError):
    """A user may not touch that session."""


class ChunkingFailure(TidemarkError):
    """A text couldn't be cut into chunks."""


class SyncFailure(TidemarkError):
    """Lines of a session couldn't be stored."""


class Conflict(SyncFailure):
    """Two writers changed the same session."""


class RewindFailure(TidemarkError):
    """A session couldn't be taken back to an earlier turn."""


class EmbeddingFailure(TidemarkError):
    """A provider gave no vector."""


ValidationError = InvalidValue
