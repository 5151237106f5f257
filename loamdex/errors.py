"""What can go wrong, and the exit code of each kind."""

from __future__ import annotations


class LoamdexError(Exception):
    """Any error of this library."""

    code = 1


class UsageError(LoamdexError):
    code = 2


class ConfigError(LoamdexError):
    code = 3


class SourceError(LoamdexError):
    pass


class SearchError(LoamdexError):
    pass


class PartialError(LoamdexError):
    """Some of the work is done."""


class ParseError(LoamdexError):
    """A file that can't be read as its format; a row's status in a scan, never the end of it."""

    def __init__(self, path: str, message: str):
        super().__init__(f"{path}: {message}")
        self.path = path


class ModelError(LoamdexError):
    code = 4


class EmbeddingError(LoamdexError):
    code = 4


class StorageError(LoamdexError):
    code = 5


def exit_code(error: BaseException | None) -> int:
    """0 for none, a kind's own code, 5 for files that can't be read or written, 1 for everything else."""
    if error is None:
        return 0
    if isinstance(error, LoamdexError):
        cause = error.__cause__
        return exit_code(cause) if type(error) is LoamdexError and isinstance(cause, Exception) else error.code
    return 5 if isinstance(error, OSError) else 1
