"""The one exception the library raises for a refused table, policy or decision."""


class Refused(ValueError):
    """A check failed. ``reason`` is a fixed code and ``counts`` holds violation
    totals only: no cell value ever enters a message or a log."""

    def __init__(self, reason: str, **counts: int) -> None:
        shown = ", ".join(f"{name}={n}" for name, n in counts.items() if n)
        super().__init__(f"refused: {reason}" + (f" ({shown})" if shown else ""))
        self.reason = reason
        self.counts = {name: n for name, n in counts.items() if n}


def refuse_if(condition: bool, reason: str, **counts: int) -> None:
    if condition:
        raise Refused(reason, **counts)


def refuse_any(reason: str, counts: dict) -> None:
    """Refuse when any violation count is non-zero."""
    bad = {name: int(n) for name, n in counts.items() if n}
    if bad:
        raise Refused(reason, **bad)
