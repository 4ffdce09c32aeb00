"""Rules and settings from YAML files, environment files, and provider modules by name."""

from __future__ import annotations

import importlib
import importlib.util
import os
from pathlib import Path

from ..operators.rules import Rule
from ..operators.stages import Provider, mock_provider


def load_rules(text: str, locale: str, lexicons: dict[str, list[dict]] | None = None) -> tuple[Rule, ...]:
    """A locale's rules from YAML: a list of mappings under rules; lexicon_ref takes its terms from lexicons. Unknown keys and repeated ids fail."""
    import yaml

    data = yaml.safe_load(text) or {}
    named = (lexicons or {}) | data.get("lexicons", {})
    out = []
    for r in data.get("rules", ()):
        r = {k: v for k, v in r.items() if k not in ("tests", "message", "fix", "note")}
        terms = named[r.pop("lexicon_ref")] if "lexicon_ref" in r else r.pop("terms", ())
        keep = tuple(t.get("preserve_case", True) for t in terms)
        fold = r.pop("flags", "i") != ""
        java = _java if fold else _exact
        known = {"id", "type", "severity", "when_source", "unless_source", "target_forbid", "target_require", "max_chars", "min_words", "applies_to", "meta_kinds", "autofix", "hypothesis"}
        if unknown := set(r) - known:
            raise ValueError(f"{r.get('id')}: unknown {sorted(unknown)}")
        out.append(
            Rule(
                r["id"], r["type"], r["severity"], tuple((java(t["pattern"]), t.get("prefer")) for t in terms), keep, java(r.get("when_source", "")), java(r.get("unless_source", "")), tuple(map(java, r.get("target_forbid", ()))),
                tuple(map(java, r.get("target_require", ()))), r.get("max_chars", 0), r.get("min_words", 3), tuple(r.get("applies_to", ())), tuple(r.get("meta_kinds", ())), r.get("autofix", False), r.get("hypothesis", False), (locale,),
            )
        )
    if len({r.id for r in out}) < len(out):
        raise ValueError("rule ids repeat")
    return tuple(out)


def _java(pattern: str) -> str:
    """A pattern whose word boundaries know all letters, without regard to case."""
    return "(?iuU)" + pattern if pattern else ""


def _exact(pattern: str) -> str:
    return "(?uU)" + pattern if pattern else ""


def load_env(path: str) -> dict[str, str]:
    """KEY=value lines into the environment; what is set already stays."""
    out = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().removeprefix("export ").partition("=")
        if eq and not key.startswith("#"):
            out[key.strip()] = os.environ.setdefault(key.strip(), value.strip().strip("\"'"))
    return out


class Providers:
    """Providers by name, stages routed to them, and one to fall back on."""

    def __init__(self) -> None:
        self.known: dict[str, Provider] = {"mock": mock_provider()}
        self.routes: dict[str, str] = {}

    def add(self, name: str, provider: Provider) -> None:
        if name in self.known:
            raise ValueError(f"{name} is there already")
        self.known[name] = provider

    def load(self, name: str, module: str, **settings) -> None:
        """A provider from a module's create_provider(**settings); a path to a file or a module's name."""
        if module.endswith(".py"):
            spec = importlib.util.spec_from_file_location(name, module)
            found = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(found)
        else:
            found = importlib.import_module(module)
        self.add(name, found.create_provider(**settings))

    def route(self, **stages: str) -> None:
        if missing := set(stages.values()) - set(self.known):
            raise ValueError(f"unknown providers {sorted(missing)}")
        self.routes |= stages

    def of(self, stage: str) -> Provider:
        return self.known[self.routes.get(stage, "mock")]

    def independent(self, stage: str, judge: str = "validation") -> bool:
        return self.routes.get(stage, "mock") != self.routes.get(judge, "mock")
