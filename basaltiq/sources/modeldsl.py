"""A schema language: `struct name { field: type pk not_null unique }`; a field whose type is another struct becomes a foreign key."""

from __future__ import annotations

import re
from graphlib import CycleError, TopologicalSorter

from ..errors import ParseError


def parse(text: str) -> dict[str, list[tuple[str, str, set[str]]]]:
    text = re.sub(r"//[^\n]*|#[^\n]*", "", text)
    out: dict[str, list] = {}
    rest = text
    while rest.strip():
        m = re.match(r"\s*struct\s+(\w+)\s*\{([^{}]*)\}", rest)
        if not m:
            raise ParseError(rest.strip()[:40])
        if m[1] in out:
            raise ParseError(f"struct {m[1]} twice")
        fields = []
        for line in filter(str.strip, re.split(r"[\n,;]", m[2])):
            f = re.fullmatch(r"\s*(\w+)\s*:\s*(\w+)((?:\s+(?:pk|not_null|unique))*)\s*", line)
            if not f:
                raise ParseError(line.strip())
            fields.append((f[1], f[2], set(f[3].split())))
        out[m[1]] = fields
        rest = rest[m.end() :]
    return out


def statements(text: str) -> list[str]:
    """CREATE TABLE statements, parents first; cycles are refused."""
    structs = parse(text)
    try:
        order = list(TopologicalSorter({s: {t for _, t, _ in fs if t in structs} for s, fs in structs.items()}).static_order())
    except CycleError as e:
        raise ParseError("structs refer to each other in a circle") from e
    out = []
    for s in order:
        columns = []
        for name, kind, flags in structs[s]:
            words = ""
            if kind in structs:
                key = next(((n, k) for n, k, fl in structs[kind] if "pk" in fl), None)
                if key is None:
                    raise ParseError(f"struct {kind} has no pk")
                name, kind, words = f"{name}_{key[0]}", key[1], f" REFERENCES {kind}({key[0]})"
            words += " PRIMARY KEY" * ("pk" in flags) + " NOT NULL" * ("not_null" in flags) + " UNIQUE" * ("unique" in flags)
            columns.append(f"{name} {kind.upper()}{words}")
        out.append(f"CREATE TABLE {s} ({', '.join(columns)})")
    return out
