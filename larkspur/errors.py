"""Conditions that callers can catch by kind."""

from __future__ import annotations

import os
import warnings


class LarkspurError(Exception):
    """Base of all errors of this library."""


class InputError(LarkspurError):
    """A bad argument: type, value, or missing."""


class ColumnError(LarkspurError):
    """A metadata column that is missing or holds nulls."""


class SplitError(LarkspurError):
    """No valid split can be made."""


class OverlapError(LarkspurError):
    """Train and test share a level that they must not share."""


class FitError(LarkspurError):
    """No fold could be fitted."""


class AuditError(LarkspurError):
    """An audit that doesn't apply to the fit."""


class DependencyError(LarkspurError):
    """An optional package is missing."""


class LarkspurWarning(UserWarning):
    """Base of all warnings of this library."""


class ValidationWarning(LarkspurWarning):
    """A pipeline guardrail."""


class FoldWarning(LarkspurWarning):
    """A problem of single folds."""


class FallbackWarning(LarkspurWarning):
    """Another behaviour than asked for was taken."""


def warn(message: str, kind: type[LarkspurWarning] = LarkspurWarning) -> None:
    warnings.warn(message, kind, stacklevel=3)


def is_strict(spark=None) -> bool:
    """The session's ``larkspur.strict`` setting, or the variable LARKSPUR_STRICT."""
    value = spark.conf.get("larkspur.strict", None) if spark is not None else None
    return (value or os.environ.get("LARKSPUR_STRICT", "")).lower() in ("1", "true", "yes")


def strict_checks(strict: bool, seed: int | None, nested: bool, mode: str) -> None:
    if not strict:
        return
    if seed is None:
        warn("strict: no explicit seed was given", ValidationWarning)
    if nested and mode == "combined":
        warn("strict: nested combined splits may have empty inner folds", ValidationWarning)


def signal(message: str, strict: bool) -> None:
    """A guardrail: an error in strict mode, a warning otherwise."""
    if strict:
        raise InputError(message)
    warn(message, ValidationWarning)
