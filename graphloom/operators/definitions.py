"""Upsert of predicate and type definitions: all of a patch or nothing."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from ..model import InvalidSchema
from ..sources import codec, corpus
from .merge import SHINGLE_WORDS, SIMILARITY
from .schema import Predicate, Schema, effective


@dataclass
class Changes:
    """Names of definitions by what was done with them."""

    created: list[str] = field(default_factory=list)
    updated: list[str] = field(default_factory=list)
    unchanged: list[str] = field(default_factory=list)
    conflicts: list[str] = field(default_factory=list)

    @property
    def message(self) -> str:
        return f"Apply schema\n\nCreated: {len(self.created)}\nUpdated: {len(self.updated)}\nUnchanged: {len(self.unchanged)}"


def _runs(text: str) -> set[tuple[str, ...]]:
    w = text.split()
    return {tuple(w[i : i + SHINGLE_WORDS]) for i in range(max(len(w) - SHINGLE_WORDS + 1, 1))}


def _append(old: str, new: str) -> str:
    if not old.strip() or not new.strip():
        return old or new
    parts = lambda t: [p.strip() for p in t.split("\n\n") if p.strip()]
    known = [_runs(p) for p in parts(old)]
    near = lambda p: any(len(k & _runs(p)) > SIMILARITY * len(k | _runs(p)) for k in known)
    return "\n\n".join(parts(old) + [p for p in parts(new) if not near(p)])


def _union(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(dict.fromkeys(a + b))


def apply(schema: Schema, text: str) -> tuple[Schema, Changes]:
    """The schema with a patch's definitions merged in; InvalidSchema for any bad one, and then nothing is changed.

    Role and policy stay as first defined; a differing label or alignment is
    kept and reported as a conflict; descriptions grow by new paragraphs and
    lists of predicates and bases by new members.
    """
    patch = codec.parse_patch(text, corpus.META)
    bad = [n.id for n in patch.nodes if n.type not in ("Property", "Class")]
    if bad or not patch.nodes:
        raise InvalidSchema(f"neither Property nor Class: {', '.join(bad)}" if bad else "no definitions")
    given = Schema()
    for n in patch.nodes:
        corpus.add_definition(given, n)
    given.check()
    out, done = Schema(dict(schema.predicates), dict(schema.types)), Changes()

    def note(name: str, old: object, new: object) -> None:
        (done.created if old is None else done.unchanged if old == new else done.updated).append(name)

    for name, p in given.predicates.items():
        old = out.predicates.get(name)
        new = p if old is None else _merge_predicate(old, p, done)
        note(name, old, new)
        out.predicates[name] = new
    for name, t in given.types.items():
        old_type = out.types.get(name)
        new_type = t if old_type is None else replace(old_type, merge=old_type.merge or t.merge, required=_union(old_type.required, t.required), optional=_union(old_type.optional, t.optional), bases=_union(old_type.bases, t.bases), description=_append(old_type.description, t.description))
        note(name, old_type, new_type)
        out.types[name] = new_type
    effective(out.types)
    return out, done


def _merge_predicate(old: Predicate, new: Predicate, done: Changes) -> Predicate:
    for key in ("label", "aligned"):
        a, b = getattr(old, key), getattr(new, key)
        if a and b and a != b:
            done.conflicts.append(f"{old.name}.{key}")
    return replace(old, label=old.label or new.label, aligned=old.aligned or new.aligned, description=_append(old.description, new.description))


def usage(schema: Schema) -> dict[str, list[str]]:
    """Types by the predicates that their effective contracts name."""
    out: dict[str, list[str]] = {}
    for t in effective(schema.types).values():
        for p in t.required + t.optional:
            out.setdefault(p, []).append(t.name)
    return out
