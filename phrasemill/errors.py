"""Kinds of errors; all are ValueErrors, too, so that one clause catches what an input can be wrong by."""

from __future__ import annotations


class TextRankError(ValueError):
    """Anything that an extraction can fail by."""


class EmptyInput(TextRankError):
    """There is no token."""


class NoCandidates(TextRankError):
    """There are tokens, and none that could be in a phrase."""


class ConvergenceFailure(TextRankError):
    def __init__(self, iterations: int, delta: float):
        super().__init__(f"no convergence within {iterations} iterations (last change {delta:.6f})")
        self.iterations, self.delta = iterations, delta


class InvalidConfig(TextRankError):
    """A setting is out of its range."""


class Serialization(TextRankError):
    """JSON that can't be read or written."""


class Internal(TextRankError):
    """What should not happen."""


class PipelineRuntimeError(TextRankError):
    """A stage failed on a document: code, path (a JSON pointer), stage, message, hint."""

    def __init__(self, code: str, stage: str, message: str, hint: str | None = None, path: str | None = None):
        self.code, self.stage, self.message, self.hint = code, stage, message, hint
        self.path = path or f"/runtime/{stage}"
        super().__init__(f"[{code}] {self.path} (stage: {stage}): {message}")

    def as_dict(self) -> dict[str, str]:
        out = {"code": self.code, "path": self.path, "stage": self.stage, "message": self.message}
        return out | {"hint": self.hint} if self.hint else out
