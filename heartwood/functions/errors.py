"""What went wrong, as callers of a run read it: a code, a message, a hint; and the envelope around a result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heartwood.config import ConfigError, MissingKey
from heartwood.operators.models import TRANSIENT
from heartwood.sources.store import LockHeld

VERSION = "1"
EXIT = {"success": 0, "partial": 1, "error": 2}


class ConfirmationRequired(RuntimeError):
    """An action that deletes needs a yes."""


class BudgetExhausted(RuntimeError):
    """A hard limit of a run stopped it."""


def classify(error: BaseException) -> tuple[str, str, str | None]:
    """(code, message, hint); the first that fits."""
    message = str(error)
    rules = (
        (isinstance(error, ConfirmationRequired), "confirmation_required", "Run it again with yes."),
        (isinstance(error, BudgetExhausted), "budget_exhausted", "Raise the limit or take a smaller tree."),
        (isinstance(error, LockHeld), "lock_held", "Wait, or see whether the other process hangs."),
        (isinstance(error, MissingKey), "provider_not_configured", "Set the provider's key."),
        (isinstance(error, (ConnectionError, TimeoutError)), "provider_unreachable", "See whether the network and the provider answer."),
        (isinstance(error, RuntimeError) and TRANSIENT in message, "provider_unreachable", "Try again later."),
        (isinstance(error, ConfigError) and "provider" in message, "provider_not_configured", "Choose a provider in the settings."),
    )
    for fits, code, hint in rules:
        if fits:
            return code, message, hint
    return "unknown_error", message if isinstance(error, Exception) else repr(error), None


def status(errors: Column, data: Column) -> Column:
    """success without errors; with them error if there is no data (null or an empty text, array or map), else partial."""
    return F.when(F.size(errors) == 0, "success").when(data.isNull() | data.cast("string").isin("", "{}", "[]"), "error").otherwise("partial")


def envelope(command: str, data: dict, errors: list[BaseException], elapsed_ms: int = 0, tokens_used: int = 0, est_cost_usd: float = 0.0, recommended_next: str | None = None) -> dict:
    listed = [dict(zip(("code", "message", "hint"), classify(e), strict=True)) for e in errors]
    state = "success" if not errors else "partial" if data else "error"
    meta = {"version": VERSION, "elapsed_ms": elapsed_ms, "tokens_used": tokens_used, "est_cost_usd": est_cost_usd}
    return {"status": state, "command": command, "metadata": meta, "data": data, "errors": listed, "recommended_next": recommended_next}
