"""Map description: mandatory keys, types, and exactly one pair of channel lists."""

from __future__ import annotations

import json
from dataclasses import dataclass
from pathlib import Path

# Mandatory keys with their types, and the two spellings of the pair of channel lists.
MANDATORY = {
    "FEM": str,
    "FEBD": str,
    "mod_feb_map": dict,
    "x_pitch": (int, float),
    "y_pitch": (int, float),
    "mM_channels": int,
    "sum_rows_cols": bool,
}
CHANNEL_LISTS = [("channels_j1", "channels_j2"), ("Time", "Energy")]

# Channels and ASICs of the front-end modules.
FRONT_ENDS = {"FEM128": (128, 2), "FEM256": (256, 4)}


@dataclass(frozen=True)
class MapConfig:
    fem: str
    modules: dict[int, tuple[int, int, int]]
    first: tuple[int, ...]
    second: tuple[int, ...]
    x_pitch: float
    y_pitch: float
    mm_channels: int
    sum_rows_cols: bool

    @property
    def channels(self) -> int:
        return FRONT_ENDS[self.fem][0]

    @property
    def asics(self) -> int:
        return FRONT_ENDS[self.fem][1]

    @property
    def rows(self) -> int:
        """Proven bound on the number of rows of the channel map."""
        return 2 * min(len(self.first), len(self.second)) * len(self.modules)


def _typed(value, expected) -> bool:
    if isinstance(value, bool) and expected is not bool:
        return False
    return isinstance(value, expected)


def validated(raw: dict) -> MapConfig:
    """Check a map description and return it as a ``MapConfig``."""
    for key, expected in MANDATORY.items():
        if key not in raw:
            raise ValueError(f"map description lacks {key}")
        if not _typed(raw[key], expected):
            raise ValueError(f"{key} has the wrong type: {type(raw[key]).__name__}")
    pairs = [names for names in CHANNEL_LISTS if all(isinstance(raw.get(n), list) for n in names)]
    if len(pairs) != 1:
        raise ValueError(f"exactly one pair of channel lists is needed: {CHANNEL_LISTS}")
    if raw["FEM"] not in FRONT_ENDS:
        raise ValueError(f"unsupported FEM {raw['FEM']!r}")
    first, second = (tuple(int(c) for c in raw[name]) for name in pairs[0])
    modules = {int(sm): tuple(int(v) for v in place) for sm, place in raw["mod_feb_map"].items()}
    if any(len(place) != 3 for place in modules.values()):
        raise ValueError("every module needs [port, slave, febport]")
    return MapConfig(
        raw["FEM"], modules, first, second, raw["x_pitch"], raw["y_pitch"], raw["mM_channels"], raw["sum_rows_cols"]
    )


def _read(path: str) -> dict:
    text = Path(path).read_text()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as missing:
        raise RuntimeError("reading YAML needs PyYAML; JSON works without it") from missing
    return yaml.safe_load(text)


def load_config(path: str) -> MapConfig:
    """Read a map description from YAML (if PyYAML is installed) or JSON, on the driver."""
    return validated(_read(path))


def read_run_config(path: str) -> dict:
    """Read a run description: energy window, channel minimum, hit threshold and map file."""
    raw = _read(path)
    window = raw.get("energy_range")
    return {
        "energy_range": None if window is None else (float(window[0]), float(window[1])),
        "min_ch": int(raw["min_ch"]),
        "min_energy": float(raw["en_min_ch"]),
        "map_file": raw["map_file"],
    }
