"""Errors by area; each carries a context that its text shows."""

from __future__ import annotations

from typing import Any


class MillraceError(Exception):
    def __init__(self, message: str, context: dict[str, Any] | None = None):
        super().__init__(message)
        self.message, self.context = message, dict(context or {})

    def __str__(self) -> str:
        return self.message + (f" ({', '.join(f'{k}={v!r}' for k, v in self.context.items())})" if self.context else "")


class SettingsError(MillraceError):
    """Settings that can't be read or don't hold."""


class ScanError(MillraceError):
    """A corpus that can't be scanned."""


class StoreError(MillraceError):
    """A table that can't be written or searched."""


class MissingRepository(MillraceError):
    """A repository that was never indexed."""


class ProviderFailure(MillraceError):
    """A model provider that fails or isn't known."""


class RetrieveError(MillraceError):
    """A retrieval request that doesn't hold."""


class AskError(MillraceError):
    """A question or tool call that doesn't hold."""


class EvalError(MillraceError):
    """An evaluation input that doesn't hold."""
