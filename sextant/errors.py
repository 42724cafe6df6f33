"""Error kinds and exit codes."""

from __future__ import annotations

CONTRACT_VERSION = 1  # fixed value

# Exit codes by error kind.
EXIT_CODES = {"USAGE": 2, "AUTH": 3, "RUN_MISSING": 4, "API": 5, "INTERNAL": 1}


class SextantError(Exception):
    def __init__(self, code: str, message: str, hint: str | None = None) -> None:
        super().__init__(message)
        self.code, self.hint, self.exit_code = code, hint, EXIT_CODES[code]


def classify(error: BaseException) -> SextantError:
    """401 and 403 mean the key, any other numeric status the service, the rest is internal."""
    if isinstance(error, SextantError):
        return error
    status = getattr(error, "status", None)
    if status in (401, 403):
        return SextantError("AUTH", str(error), "Check the judge's key.")
    numeric = isinstance(status, (int, float)) and not isinstance(status, bool)
    return SextantError("API" if numeric else "INTERNAL", str(error))


def envelope(error: SextantError) -> dict:
    body = {"code": error.code, "message": str(error)}
    if error.hint:
        body["hint"] = error.hint
    return {"error": body}
