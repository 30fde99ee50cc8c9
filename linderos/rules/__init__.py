"""The rule catalogue."""

from __future__ import annotations

from collections.abc import Iterable

from . import destinacion_uso, duplicados, fisicas, juridicas, novedades, numero_predial, ph_condominio, registral, terreno
from .model import Check, Part, Rule

__all__ = ["Check", "Part", "Rule", "catalogue", "categories", "register_rule", "unregister_rule", "select_rules"]

_BUILT_IN: tuple[Rule, ...] = tuple(
    rule
    for module in (
        destinacion_uso, duplicados, fisicas, juridicas, novedades, numero_predial, ph_condominio, registral, terreno
    )
    for rule in module.category.rules
)
_ADDED: dict[str, Rule] = {}


def catalogue() -> list[Rule]:
    """Built-in rules in category order, then registered ones."""
    return [*_BUILT_IN, *_ADDED.values()]


def register_rule(rule: Rule) -> None:
    """Add a user rule, given as parts, as a DataFrame builder or as SQL text."""
    if sum(bool(x) for x in (rule.parts, rule.build, rule.sql)) != 1:
        raise ValueError(f"rule {rule.id}: give exactly one of parts, build and sql")
    if any(rule.id == known.id for known in _BUILT_IN):
        raise ValueError(f"rule {rule.id} exists")
    _ADDED[rule.id] = rule


def unregister_rule(rule_id: str) -> None:
    _ADDED.pop(rule_id, None)


def categories(rules: Iterable[Rule] | None = None) -> list[str]:
    """Distinct categories in alphabetical order."""
    return sorted({rule.categoria for rule in (catalogue() if rules is None else rules)})


def select_rules(
    categorias: Iterable[str] | None = None,
    severidades: Iterable[str] | None = None,
    rules: Iterable[Rule] | None = None,
) -> list[Rule]:
    """Rules in all of the given filters; an empty or absent filter lets everything pass."""
    chosen = list(catalogue() if rules is None else rules)
    wanted, levels = set(categorias or ()), set(severidades or ())
    if wanted:
        chosen = [rule for rule in chosen if rule.categoria in wanted]
    if levels:
        chosen = [rule for rule in chosen if rule.severidad in levels]
    return chosen
