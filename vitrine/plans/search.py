"""The search language: text to tree and back, and groups of chips to a tree."""

from __future__ import annotations

from dataclasses import dataclass, field

Node = dict


@dataclass
class Group:
    operator: str  # and, or, not
    tags: list[str] = field(default_factory=list)


def tag(value: str) -> Node:
    return {"type": "tag", "value": value}


def tokens(query: str) -> list[str]:
    """Cut at spaces and parentheses outside of double quotes; quotes stay on their token."""
    out, now, quoted = [], "", False
    for c in query:
        if c == '"':
            quoted = not quoted
            now += c
        elif not quoted and c in "( )":
            if now:
                out.append(now)
            now = ""
            if c != " ":
                out.append(c)
        else:
            now += c
    return out + [now] if now else out


def _joined(found: list[str]) -> list[str]:
    """AND between an operand and what begins the next one."""
    out: list[str] = []
    for t in found:
        ends = bool(out) and out[-1] not in ("(", "AND", "OR", "NOT")
        begins = t not in (")", "AND", "OR")
        if ends and begins:
            out.append("AND")
        out.append(t)
    return out


def parsed(query: str) -> Node | None:
    """NOT binds before AND before OR. Open parentheses end with the text, stray operators go."""
    todo = _joined(tokens(query.strip()))[::-1]

    def level(word: str, kind: str, below) -> Node | None:
        parts = [below()]
        while todo and todo[-1] == word:
            todo.pop()
            parts.append(below())
        parts = [p for p in parts if p]
        return {"type": kind, "children": parts} if len(parts) > 1 else parts[0] if parts else None

    def either() -> Node | None:
        return level("OR", "or", both)

    def both() -> Node | None:
        return level("AND", "and", one)

    def one() -> Node | None:
        if not todo or todo[-1] in (")", "AND", "OR"):
            return None
        t = todo.pop()
        if t == "NOT":
            inner = one()
            return {"type": "not", "child": inner} if inner else None
        if t == "(":
            inner = either()
            if todo and todo[-1] == ")":
                todo.pop()
            return inner
        value = t.removeprefix("#")
        if len(value) > 1 and value[0] == value[-1] == '"':
            value = value[1:-1]
        return tag(value.removeprefix("#"))

    parts = []
    while todo:
        got = either()
        if got:
            parts.append(got)
        elif todo:
            todo.pop()
    return parts[0] if parts else None


def from_groups(groups: list[Group]) -> Node | None:
    """Groups are ANDed; not means none of its tags. Single children stand alone."""
    nodes = []
    for g in groups:
        kids = [tag(t) for t in g.tags]
        if not kids:
            continue
        kind = "and" if g.operator == "and" else "or"
        node = kids[0] if len(kids) == 1 else {"type": kind, "children": kids}
        nodes.append({"type": "not", "child": node} if g.operator == "not" else node)
    return None if not nodes else nodes[0] if len(nodes) == 1 else {"type": "and", "children": nodes}


def text_of(node: Node) -> str:
    kind = node["type"]
    if kind == "tag":
        return "#" + node["value"]
    if kind == "not":
        inner = text_of(node["child"])
        return f"NOT ({inner})" if node["child"]["type"] in ("and", "or") else f"NOT {inner}"
    word = " AND " if kind == "and" else " OR "
    return word.join(f"({text_of(c)})" if kind == "and" and c["type"] == "or" else text_of(c) for c in node["children"])


def combined(query: str, tags: list[str]) -> str:
    """A query and more tags: those joined by AND, quoted if they have a space."""
    more = " AND ".join(f'"{t}"' if " " in t else f"#{t}" for t in tags)
    if not query.strip():
        return more
    return f"({query.strip()}) AND {more}" if more else query
