"""Taxonomies, rules and profiles: small, frozen, compiled to columns while a plan is built."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Taxonomy:
    name: str
    default_level: str
    levels: dict[str, int]  # level -> rank
    categories: dict[str, str] = field(default_factory=dict)  # category -> path
    names: dict[str, str] = field(default_factory=dict)  # level -> what it is called

    def rank(self, level: str | None) -> int:
        return self.levels.get(level or "", 0)

    def max_level(self, levels: list[str]) -> str:
        """The first of the highest-ranked levels; the default level of none."""
        return max(levels, key=self.rank) if levels else self.default_level


@dataclass(frozen=True)
class Matcher:
    operator: str
    params: dict = field(default_factory=dict)
    target: str = "field_value"


@dataclass(frozen=True)
class Rule:
    id: str
    level: str | None
    category: str | None
    priority: int
    matchers: tuple[Matcher, ...]
    match_logic: str = "OR"
    enabled: bool = True


@dataclass(frozen=True)
class Downgrade:
    id: str
    keywords: tuple[str, ...]
    level: str
    category: str
    force_suppress: bool = False
    max_force_suppress_level: str | None = None
    exempt_rules: tuple[str, ...] = ()


@dataclass(frozen=True)
class Composite:
    id: str
    field_patterns: tuple[str, ...]
    target_level: str
    category: str
    min_matches: int = 2


@dataclass(frozen=True)
class Profile:
    domain: str
    rules: tuple[Rule, ...]
    downgrades: tuple[Downgrade, ...] = ()
    composites: tuple[Composite, ...] = ()


@dataclass(frozen=True)
class Standard:
    id: str
    taxonomy: str
    domains: tuple[str, ...]


@dataclass(frozen=True)
class Policy:
    """When the later layers of the funnel run and when a person must look."""

    rule_confidence: float = 0.95
    composite_confidence: float = 0.90
    review_below: float = 0.5
    llm_below: float = 0.60
    enable_ner: bool = False
    enable_llm: bool = False
