"""Compatibility of two schema versions.

Removing a label, an edge type or a property, or changing a property's type, is incompatible.
Everything else (additions, `@indexed`, optionality, endpoints) is compatible.
"""

from __future__ import annotations

from dataclasses import dataclass

from .types import Schema


@dataclass(frozen=True)
class Evolution:
    reasons: tuple[str, ...] = ()

    @property
    def compatible(self) -> bool:
        return not self.reasons


def diff(old: Schema, new: Schema) -> Evolution:
    why: list[str] = []
    for kind, before, after in (("node label", old.nodes, new.nodes), ("edge type", old.edges, new.edges)):
        for name, was in before.items():
            if (now := after.get(name)) is None:
                why.append(f"{kind} {name} was removed")
                continue
            for p in was.properties:
                if (q := now.prop(p.name)) is None:
                    why.append(f"{name}.{p.name} was removed")
                elif q.type != p.type:
                    why.append(f"{name}.{p.name} changed its type from {p.type} to {q.type}")
    return Evolution(tuple(why))
