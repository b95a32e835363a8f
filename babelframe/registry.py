"""A folder of dialects with the state of each and the runs that checked it.

<name>.json is the dialect, as config.save_dialect writes it; <name>.log has a JSON line for each change of state and each run.
The log is only appended to, so what was known of a dialect at any time can be read later.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterable
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException

from .config import FOLDER, REFERENCE, Dialect, list_dialects, load_dialect, save_dialect
from .errors import SqlError
from .session import Engine
from .verify.checks import dialects_agree

#: The states of a dialect.
STATES = "draft generating generated validated validated_manual needs_review failed deprecated".split()


class Registry:
    """Dialects by name. A dialect without a log is a draft; the name of the reference dialect is taken."""

    def __init__(self, folder: Path | str = FOLDER):
        self.folder = Path(folder)

    def names(self, state: str | None = None) -> list[str]:
        return [n for n in list_dialects(self.folder) if state is None or self.state(n) == state]

    def load(self, name: str) -> Dialect:
        return load_dialect(name, self.folder)

    def save(self, dialect: Dialect, state: str = "draft") -> Path:
        """A changed dialect starts again at the given state, since earlier runs say nothing of it."""
        if dialect.name == REFERENCE.name:
            raise ValueError(f"the name {dialect.name!r} is taken")
        self.folder.mkdir(parents=True, exist_ok=True)
        path = save_dialect(dialect, self.folder)
        self.set_state(dialect.name, state)
        return path

    def log(self, name: str) -> list[dict[str, Any]]:
        if name not in list_dialects(self.folder):
            raise KeyError(f"no dialect {name!r}")
        path = self.folder / f"{name}.log"
        return [json.loads(line) for line in path.read_text().splitlines()] if path.exists() else []

    def state(self, name: str) -> str:
        return next((e["state"] for e in reversed(self.log(name)) if "state" in e), "draft")

    def history(self, name: str) -> list[dict[str, Any]]:
        """Runs, the oldest first: at, total, passed and the queries that failed."""
        return [e for e in self.log(name) if "total" in e]

    def set_state(self, name: str, state: str) -> None:
        if state not in STATES:
            raise ValueError(f"a state is one of {', '.join(STATES)}, not {state!r}")
        self._append(name, {"state": state})

    def validate(self, name: str, spark, tables: dict, queries: Iterable[str]) -> dict[str, Any]:
        """Runs queries of the reference's surface in it and in a dialect's, notes the run and sets the state: validated if all agree, else needs_review.

        A query that fails in the dialect counts as one that disagrees. No queries leave the state as it is.
        """
        base, own = (Engine(spark, d, tables) for d in (REFERENCE, self.load(name)))
        asked, failed = list(queries), []
        for sql in asked:
            try:
                agree = not dialects_agree([base, own], sql)
            except (SqlError, PySparkException):
                agree = False
            if not agree:
                failed.append(sql)
        run = self._append(name, {"total": len(asked), "passed": len(asked) - len(failed), "failed": failed})
        if asked:
            self.set_state(name, "needs_review" if failed else "validated")
        return run

    def _append(self, name: str, entry: dict[str, Any]) -> dict[str, Any]:
        self.log(name)  # there is such a dialect
        entry = {"at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds"), **entry}
        with open(self.folder / f"{name}.log", "a", encoding="utf-8") as f:
            f.write(json.dumps(entry) + "\n")
        return entry
