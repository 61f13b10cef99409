"""User detectors: objects with a ``name`` and ``detect(text)`` that returns matches."""

from __future__ import annotations

import importlib.util
import os
import sys
from collections.abc import Iterable, Mapping, Sequence
from pathlib import Path
from types import ModuleType

MAX_MESSAGE = 160
_loaded: dict[str, tuple] = {}


def describe_error(error: BaseException) -> str:
    """The first line only and not all of a long one: messages may quote the text."""
    line = str(error).split("\n", 1)[0]
    return line if len(line) <= MAX_MESSAGE else f"{line[:MAX_MESSAGE]}…"


def is_plugin(value: object) -> bool:
    return isinstance(getattr(value, "name", None), str) and callable(getattr(value, "detect", None))


def resolve_path(given: str) -> Path | None:
    """An existing absolute path, or one below the home folder."""
    path = Path(os.path.expanduser(given) if given == "~" or given.startswith("~/") else given)
    return path if path.is_absolute() and path.exists() else None


def plugins_of(module: ModuleType) -> tuple:
    many = getattr(module, "plugins", None)
    found = [getattr(module, "default", None), getattr(module, "plugin", None), *(many if isinstance(many, (list, tuple)) else ())]
    return tuple(x for x in found if is_plugin(x))


def load_plugins(paths: Iterable[str]) -> tuple:
    """Plugins of Python files; unusable paths and files that fail are reported and passed over."""
    out: list = []
    for given in paths:
        path = resolve_path(given)
        if path is None:
            print(f"Ignoring plugin path: {given}", file=sys.stderr)
            continue
        key = str(path)
        if key not in _loaded:
            try:
                spec = importlib.util.spec_from_file_location(f"hushframe_plugin_{len(_loaded)}", path)
                module = importlib.util.module_from_spec(spec)
                spec.loader.exec_module(module)
                _loaded[key] = plugins_of(module)
            except Exception as e:  # noqa: BLE001  a broken plugin must not stop the rest
                print(f"Failed to load plugin {key}: {describe_error(e)}", file=sys.stderr)
                _loaded[key] = ()
        out += _loaded[key]
    return tuple(out)


def reset_plugins() -> None:
    _loaded.clear()


def _get(match: object, key: str):
    return match.get(key) if isinstance(match, Mapping) else getattr(match, key, None)


def plugin_spans(text: str, plugins: Sequence) -> list[tuple]:
    """Valid matches of each plugin in turn; one that fails is reported and passed over."""
    out = []
    for plugin in plugins:
        try:
            for m in plugin.detect(text):
                start, end, value = _get(m, "start"), _get(m, "end"), _get(m, "value")
                whole = all(isinstance(x, int) and not isinstance(x, bool) for x in (start, end))
                if not whole or not 0 <= start < end <= len(text) or text[start:end] != value:
                    continue
                sure, category = _get(m, "confidence"), _get(m, "category")
                fine = isinstance(sure, (int, float)) and not isinstance(sure, bool) and 0 <= sure <= 1
                out.append((value, plugin.name if category is None else category, start, end, float(sure) if fine else 1.0))
        except Exception as e:  # noqa: BLE001
            print(f"Plugin {plugin.name} failed: {describe_error(e)}", file=sys.stderr)
    return out
