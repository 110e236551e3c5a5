"""Classified failures: one enum carried on the exception, never guessed from a message."""

from __future__ import annotations

from enum import Enum


class Failure(str, Enum):
    """What went wrong; the value is the stable slug."""

    READ_ONLY = "read_only"
    MISSING_JOIN = "missing_join"
    BAD_JOIN = "bad_join"
    UNKNOWN_COLUMN = "unknown_column"
    UNKNOWN_RELATION = "unknown_relation"
    FANOUT = "fanout"
    SEMANTIC = "semantic_error"
    WRONG_GRAIN = "wrong_grain"
    SCOPE_DRIFT = "scope_drift"
    INTENT = "intent_error"
    OVERVALIDATION = "overvalidation"
    METRIC = "metric_mismatch"
    RANKING = "ranking_target"
    GROUPING = "grouping_intent"
    IMPLAUSIBLE = "implausible_result"
    UNGROUNDED = "ungrounded_answer"
    AMBIGUOUS = "ambiguous_path"
    NO_PLAN = "cannot_plan"
    EXECUTION = "execution_error"


class ValidationError(ValueError):
    """A query that must not run as it is; ``failure`` says of which class, the message what to do."""

    def __init__(self, failure: Failure, message: str) -> None:
        super().__init__(f"[{failure.value}] {message}")
        self.failure, self.message = failure, message


def classify(error: BaseException) -> Failure:
    """The class of any exception."""
    return error.failure if isinstance(error, ValidationError) else Failure.EXECUTION
