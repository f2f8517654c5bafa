"""Settings in JSON or YAML files: rules, feature lists, palettes."""

from __future__ import annotations

import json
from pathlib import Path


def load(path: str | Path) -> object:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: no YAML reader is installed; give the settings as JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def load_rules(path: str | Path, key: str = "canonization_rules") -> list[dict]:
    """Rules by number."""
    rules = load(path)
    return sorted(rules[key] if isinstance(rules, dict) else rules, key=lambda r: r["number"])


def load_features(path: str | Path) -> list[str]:
    return [str(x) for x in load(path)]


def load_palettes(path: str | Path) -> dict[str, list[str]]:
    """Lists of colours by name; a colour is # and six hexadecimal digits."""
    out = {}
    for name, colours in load(path).items():
        bad = [c for c in colours if len(c) != 7 or c[0] != "#" or any(x not in "0123456789abcdefABCDEF" for x in c[1:])]
        if bad:
            raise ValueError(f"palette {name}: {bad[0]} is no colour")
        out[name] = list(colours)
    return out
