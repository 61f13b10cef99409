"""Configuration of the engine: immutable, read on the driver, fixed when a plan is built."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace
from pathlib import Path
from urllib.parse import urlsplit

from hushframe.functions.categories import CATEGORIES, DEFAULT_CATEGORIES, LABELS

DEFAULT_ENDPOINT = "http://localhost:11434"
DEFAULT_MODEL = "gemma3:4b"
DISABLED_BY = "HUSHFRAME_FILTER"


@dataclass(frozen=True)
class DictionaryEntry:
    text: str
    category: str
    exact: bool = False
    case_sensitive: bool = False
    fold_width: bool = False


@dataclass(frozen=True)
class CustomPattern:
    name: str
    pattern: str
    category: str | None = None

    @property
    def target(self) -> str:
        return self.category if self.category is not None else self.name


@dataclass(frozen=True)
class CustomCategory:
    name: str
    label: str | None = None
    placeholder: str | None = None
    enabled: bool = True
    patterns: tuple[str, ...] = ()
    dictionary: tuple[str, ...] = ()


@dataclass(frozen=True)
class AuditConfig:
    enabled: bool = False
    destination: str = "stderr"
    path: str | None = None
    review_threshold: float = 0.8


@dataclass(frozen=True)
class Control:
    """Switches an operator may flip between runs; each change gives a new value."""

    passthrough: bool = False
    disabled: frozenset[str] = frozenset()

    def toggled(self) -> Control:
        return replace(self, passthrough=not self.passthrough)

    def with_passthrough(self, on: bool) -> Control:
        return replace(self, passthrough=on)

    def disable(self, category: str) -> Control:
        return replace(self, disabled=self.disabled | {category})

    def enable(self, category: str) -> Control:
        return replace(self, disabled=self.disabled - {category})

    def reset(self) -> Control:
        return Control()

    def active(self, categories: Iterable[str]) -> tuple[str, ...]:
        return tuple(c for c in categories if c not in self.disabled)

    def status(self) -> dict:
        return {"passthroughEnabled": self.passthrough, "disabledCategories": sorted(self.disabled)}


@dataclass(frozen=True)
class Config:
    enabled: bool = True
    mode: str = "pseudonymize"
    categories: tuple[str, ...] = DEFAULT_CATEGORIES
    heuristic_ner: bool = True
    custom_patterns: tuple[CustomPattern, ...] = ()
    custom_categories: tuple[CustomCategory, ...] = ()
    plugins: tuple = ()
    dictionary: tuple[DictionaryEntry, ...] = ()
    allowlist: tuple[str, ...] = ()
    audit: AuditConfig = field(default_factory=AuditConfig)
    endpoint: str = DEFAULT_ENDPOINT
    allow_remote: bool = False
    model: str = DEFAULT_MODEL
    provider_enabled: bool = False
    control: Control = field(default_factory=Control)
    surnames: tuple[str, ...] | None = None

    @property
    def is_enabled(self) -> bool:
        return self.enabled and not self.control.passthrough

    @property
    def reversible(self) -> bool:
        return self.mode != "anonymize"

    @property
    def configured(self) -> tuple[str, ...]:
        """Built-in, enabled custom and pattern categories, each once, in that order."""
        own = [c.name for c in self.custom_categories if c.enabled]
        return tuple(dict.fromkeys([*self.categories, *own, *(p.target for p in self.custom_patterns)]))

    @property
    def active(self) -> tuple[str, ...]:
        return self.control.active(self.configured)

    @property
    def all_dictionary(self) -> tuple[DictionaryEntry, ...]:
        own = [DictionaryEntry(t, c.name) for c in self.custom_categories if c.enabled for t in c.dictionary]
        return (*self.dictionary, *own)

    @property
    def all_patterns(self) -> tuple[CustomPattern, ...]:
        own = [CustomPattern(f"{c.name}_{k + 1}", p, c.name) for c in self.custom_categories if c.enabled for k, p in enumerate(c.patterns)]
        return (*self.custom_patterns, *own)

    def prefix(self, category: str) -> str:
        """What a placeholder of the category starts with; disabled custom categories still name it."""
        for c in self.custom_categories:
            if c.name == category:
                named = c.placeholder if c.placeholder is not None else c.label
                if named is not None:
                    return named
                break
        return LABELS.get(category, category)

    def known(self, category: str) -> bool:
        return category in CATEGORIES or category in self.configured

    def normalize_category(self, raw: str) -> str | None:
        """A category named in a path: URL-decoded, trimmed, upper-cased; None if it isn't known."""
        from urllib.parse import unquote

        name = unquote(raw).strip().upper()
        return name if self.known(name) else None

    def with_control(self, control: Control) -> Config:
        return replace(self, control=control)

    def status(self) -> dict:
        return self.control.status() | {"filterEnabled": self.enabled, "activeCategories": list(self.active)}


def is_loopback(host: str) -> bool:
    host = host.lower().removeprefix("[").removesuffix("]")
    return host in ("localhost", "::1") or host.startswith("127.")


def normalize_endpoint(endpoint: object, allow_remote: bool) -> str:
    """The endpoint's origin if it is http(s) and local, or remote ones are allowed; else the default."""
    if not isinstance(endpoint, str):
        return DEFAULT_ENDPOINT
    try:
        url = urlsplit(endpoint.strip())
        port = url.port
    except ValueError:
        return DEFAULT_ENDPOINT
    if url.scheme not in ("http", "https") or not url.hostname:
        return DEFAULT_ENDPOINT
    host = f"[{url.hostname}]" if ":" in url.hostname else url.hostname
    usual = {"http": 80, "https": 443}[url.scheme]
    if allow_remote or is_loopback(url.hostname):
        return f"{url.scheme}://{host}" + (f":{port}" if port not in (None, usual) else "")
    print(f"Ignoring endpoint {endpoint!r}: it is not on this machine and remote ones are not allowed.", file=sys.stderr)
    return DEFAULT_ENDPOINT


def from_mapping(raw: Mapping) -> Config:
    """A configuration from parsed JSON; what is missing or malformed gets its default."""
    audit = raw.get("auditLog") if isinstance(raw.get("auditLog"), Mapping) else {}
    threshold = audit.get("reviewThreshold")
    numeric = isinstance(threshold, (int, float)) and not isinstance(threshold, bool)
    remote = raw.get("allowRemoteOllama") is True
    pick = lambda key, default: default if raw.get(key) is None else raw[key]
    entry = lambda d: DictionaryEntry(d["text"], d["category"], d.get("matchMode") == "exact", d.get("caseSensitive") is True, bool(d.get("normalizeWidth")))
    own = lambda c: CustomCategory(c["name"], c.get("label"), c.get("placeholder"), c.get("enabled") is not False, tuple(c.get("patterns") or ()), tuple(c.get("dictionary") or ()))
    return Config(
        enabled=bool(pick("enabled", True)),
        mode="anonymize" if raw.get("mode") == "anonymize" else "pseudonymize",
        categories=tuple(pick("categories", DEFAULT_CATEGORIES)),
        heuristic_ner=bool(pick("heuristicNerEnabled", True)),
        custom_patterns=tuple(CustomPattern(p["name"], p["pattern"], p.get("category")) for p in pick("customPatterns", ())),
        custom_categories=tuple(own(c) for c in pick("customCategories", ())),
        plugins=tuple(p for p in raw["plugins"] if isinstance(p, str)) if isinstance(raw.get("plugins"), list) else (),
        dictionary=tuple(entry(d) for d in pick("dictionary", ())),
        allowlist=tuple(pick("allowlist", ())),
        audit=AuditConfig(bool(audit.get("enabled", False)), "file" if audit.get("destination") == "file" else "stderr", audit.get("path") if isinstance(audit.get("path"), str) else None, float(threshold) if numeric else 0.8),
        endpoint=normalize_endpoint(raw.get("ollamaEndpoint"), remote),
        allow_remote=remote,
        model=pick("ollamaModel", DEFAULT_MODEL),
        provider_enabled=bool(pick("ollamaEnabled", False)),
    )


def load(path: str | Path | None = None, env: Mapping[str, str] | None = None) -> Config:
    """Configuration from a JSON file; a missing or malformed file gives the defaults."""
    if (os.environ if env is None else env).get(DISABLED_BY) == "0":
        return Config(enabled=False)
    try:
        raw = json.loads(Path(path).read_text("utf8")) if path is not None else {}
        return from_mapping(raw) if isinstance(raw, Mapping) else Config()
    except (OSError, ValueError, KeyError, TypeError):
        return Config()
