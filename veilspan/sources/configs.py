"""Recognizer configurations and prompts from YAML files, read and checked on the driver."""

from __future__ import annotations

import warnings
from collections.abc import Mapping
from pathlib import Path

from ..operators.recognizers import Recognizer, from_config

#: The recognizers that come with the library.
SHIPPED = Path(__file__).parent / "patterns" / "recognizers.yaml"


def check(entry: Mapping) -> None:
    """Raise ValueError for what a configuration entry lacks or has wrong."""
    if not isinstance(entry, Mapping):
        raise ValueError("a recognizer must be a mapping")
    if not isinstance(entry.get("entity_type"), str) or not entry["entity_type"].strip():
        raise ValueError("entity_type must be a non-empty text")
    patterns = entry.get("patterns")
    if not isinstance(patterns, list) or not patterns:
        raise ValueError(f"{entry['entity_type']}: patterns must be a non-empty list")
    for k, p in enumerate(patterns):
        if not isinstance(p, Mapping) or not isinstance(p.get("pattern"), str):
            raise ValueError(f"{entry['entity_type']}: pattern {k} must have a text named pattern")
    for name in ("context_words", "deny_lists"):
        if entry.get(name) is not None and not isinstance(entry[name], list):
            raise ValueError(f"{entry['entity_type']}: {name} must be a list")
    base = entry.get("confidence_base", 0.85)
    if isinstance(base, bool) or not isinstance(base, int | float) or not 0 <= base <= 1:
        raise ValueError(f"{entry['entity_type']}: confidence_base must be within 0 and 1")


def load_file(path: str | Path, folder: str | Path = ".") -> list[dict]:
    """The checked entries of one file; a relative path is looked up in ``folder``."""
    import yaml

    path = Path(path) if Path(path).is_absolute() else Path(folder) / path
    data = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(data, dict) or not isinstance(data.get("recognizers"), list):
        raise ValueError(f"{path}: the file must have a list named recognizers")
    for entry in data["recognizers"]:
        check(entry)
    return data["recognizers"]


def list_files(folder: str | Path, pattern: str = "*.yaml") -> list[Path]:
    return sorted(Path(folder).glob(pattern))


def load_all(folder: str | Path, pattern: str = "*.yaml") -> list[dict]:
    """The entries of all files in order of their names; a bad file is skipped with a warning."""
    import yaml

    files = list_files(folder, pattern)
    if not files:
        raise FileNotFoundError(f"no {pattern} in {folder}")
    out = []
    for f in files:
        try:
            out += load_file(f)
        except (ValueError, OSError, yaml.YAMLError) as e:
            warnings.warn(f"{f} is skipped: {e}", stacklevel=2)
    return out


def by_type(folder: str | Path, entity_type: str) -> dict | None:
    """The first entry of a type among all files."""
    return next((x for x in load_all(folder) if x["entity_type"] == entity_type), None)


def recognizers(folder: str | Path) -> list[Recognizer]:
    return [from_config(x) for x in load_all(folder)]


def prompt(path: str | Path, key: str, *folders: str | Path) -> str:
    """A prompt template by its key; a relative path is looked up in the folders and then in the current one."""
    import yaml

    tried = [Path(path)] if Path(path).is_absolute() else [Path(f) / path for f in (*folders, ".")]
    found = next((p for p in tried if p.is_file()), None)
    if found is None:
        raise FileNotFoundError(f"none of {', '.join(map(str, tried))} exists")
    data = yaml.safe_load(found.read_text(encoding="utf-8"))
    if key not in data:
        raise KeyError(f"{key} is not among {sorted(data)}")
    return data[key]
