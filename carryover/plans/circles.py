"""The order of tables that refer to each other, circles included."""

from __future__ import annotations

from collections.abc import Collection, Mapping


def reachable_from(start: str, parents: Mapping[str, Collection[str]]) -> set[str]:
    seen, open_ = set(), [start]
    while open_:
        for parent in parents.get(open_.pop(), ()):
            if parent in parents and parent not in seen:
                seen.add(parent)
                open_.append(parent)
    return seen


def circles(parents: Mapping[str, Collection[str]]) -> list[list[str]]:
    """Groups of tables, parents first: two tables share a group if each can be reached from the other.

    ``parents`` names what each table refers to. Groups that do not depend on each other, and the
    tables within a group, keep the order given.
    """
    above = {name: reachable_from(name, parents) for name in parents}
    group_of = {name: [o for o in parents if o == name or (o in above[name] and name in above[o])] for name in parents}
    placed: list[list[str]] = []
    done: set[str] = set()
    waiting = list(parents)
    while waiting:
        for name in waiting:
            group = group_of[name]
            if all(above[member] - set(group) <= done for member in group):
                placed.append(group)
                done |= set(group)
                break
        waiting = [n for n in waiting if n not in done]
    return placed
