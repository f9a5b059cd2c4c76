"""Settings of a view and their defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace
from typing import Any

from skein.functions.lexicon import TYPE_RULES


@dataclass(frozen=True)
class TypeRule:
    on: bool = True
    min_appearances: int = 2
    min_importance: float = 3


def default_rules() -> dict[str, TypeRule]:
    return {t: TypeRule(*r) for t, r in TYPE_RULES.items()}


@dataclass(frozen=True)
class Settings:
    """When to extract, what to promote, how to apply changes, and how cards look."""

    enabled: bool = False
    extract_every: int = 6
    settle_lag: int = 2
    window_max: int = 12
    context_msgs: int = 3
    max_chars_per_msg: int = 5000
    min_confidence: float = 0.6
    min_importance: float = 3
    instant_importance: float = 8
    episode_gap: int = 6
    long_episode_msgs: int = 10
    type_rules: dict[str, TypeRule] = field(default_factory=default_rules)
    protagonist: tuple[str, ...] = ("Dragon",)
    excluded_types: tuple[str, ...] = ()
    apply_mode: str = "auto"
    conflict_policy: str = "both"
    player_authoritative: bool = True
    static_match: str = "delta"
    on_manual_edit: str = "lock"
    include_uncertain: bool = True
    evidence_strictness: str = "strict"
    static_books: tuple[str, ...] = ()
    auto_detect_static: bool = True
    book_prefix: str = "Skein_"
    position: int = 0
    depth: int = 4
    order: int = 100
    role: int = 0
    max_chars: int = 900
    max_keys: int = 8
    extra_rules: str = ""

    def rule(self, kind: str) -> TypeRule:
        return self.type_rules.get(kind) or self.type_rules.get("other") or TypeRule()


def merge_settings(saved: dict[str, Any] | None) -> Settings:
    """Saved values over the defaults; type rules merge by type and by field, unknown names are ignored."""
    known, saved = {f.name for f in fields(Settings)}, dict(saved or {})
    rules = default_rules()
    for kind, given in (saved.pop("type_rules", None) or {}).items():
        rules[kind] = replace(rules.get(kind, TypeRule()), **(given if isinstance(given, dict) else vars(given)))
    return replace(Settings(), type_rules=rules, **{k: tuple(v) if isinstance(v, list) else v for k, v in saved.items() if k in known})


def members(settings: Settings) -> list[tuple[str, str, Any]]:
    """(name, kind, value) of every member, as a form needs them."""
    return [(f.name, str(f.type), getattr(settings, f.name)) for f in fields(settings)]
