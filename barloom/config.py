"""Where state and bars lie: given, else a TOML file named by BARLOOM_CONFIG, else ~/.barloom.toml, else ~/.barloom."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass
from pathlib import Path

from barloom.model import InvalidRequestError

VARIABLE = "BARLOOM_CONFIG"


@dataclass(frozen=True)
class MarketDataConfig:
    """Driver and executors share both folders."""

    state_dir: str
    data_dir: str

    @property
    def catalog(self) -> Path:
        return Path(self.state_dir, "catalog.db")


def resolve_config(state_dir: str | None = None, data_dir: str | None = None) -> MarketDataConfig:
    """Explicit folders before the file's, those before the defaults. Unknown keys and values that are no text are refused."""
    named = os.environ.get(VARIABLE)
    path = Path(named) if named else Path.home() / ".barloom.toml"
    told: dict = {}
    if named or path.exists():
        try:
            told = tomllib.loads(path.read_text())
        except (OSError, ValueError) as e:
            raise InvalidRequestError(f"{path}: {e}") from e
    for key, value in told.items():
        if key not in ("state_dir", "data_dir") or not isinstance(value, str):
            raise InvalidRequestError(f"{path}: {key} = {value!r}")
    home = Path.home() / ".barloom"
    return MarketDataConfig(state_dir or told.get("state_dir") or str(home / "state"), data_dir or told.get("data_dir") or str(home / "data"))
