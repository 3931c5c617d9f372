"""Where vault, policies, packs and audit log of a project lie."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass
from pathlib import Path

from maskloom.plans.policy import DEFAULT, Policy

FOLDER, VARIABLE = ".maskloom", "MASKLOOM_STATE_DIR"


@dataclass(frozen=True)
class State:
    root: Path
    found: str  # pinned, discovered or created

    @staticmethod
    def resolve(explicit: str | None = None, start: str | None = None) -> "State":
        """The folder named; else the variable's; else that of the nearest parent
        that has one; else a new one here."""
        named = explicit or os.environ.get(VARIABLE)
        if named:
            return State(Path(named).absolute(), "pinned")
        here = Path(start or os.getcwd()).absolute()
        for folder in (here, *here.parents):
            if (folder / FOLDER).is_dir():
                return State(folder / FOLDER, "discovered")
        return State(here / FOLDER, "created")

    @property
    def warning(self) -> str | None:
        return f"policies of {self.root}, found above and not pinned, are in force" if self.found == "discovered" else None

    def path(self, name: str, shared: str | None = None) -> str:
        """Of vault, packs or audit, as Spark takes it. On a cluster ``shared``, a
        folder that executors reach too, stands for this machine's."""
        return f"{shared.rstrip('/')}/{name}" if shared else f"file://{self.root / name}"

    def policy(self) -> Policy:
        """Global, repository and session layer; the global one is written first
        if there is none."""
        folder = self.root / "policy"
        folder.mkdir(parents=True, exist_ok=True)
        first = folder / "global.policy.json"
        if not first.exists():
            first.write_text(json.dumps(DEFAULT, indent=2) + "\n", encoding="utf-8")
        layers = [folder / f"{name}.policy.json" for name in ("global", "repo", "session")]
        return Policy.load(*(str(p) for p in layers if p.exists()))
