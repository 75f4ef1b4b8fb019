"""Registration of queries with their SQL twins, and shared SQL fragments."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

# name -> (names it needs, text)
_PARTS: dict[str, tuple[tuple[str, ...], str]] = {}


def part(name: str, text: str, *needs: str) -> None:
    _PARTS[name] = (needs, text)


def _ordered(names, seen):
    for name in names:
        needs, _ = _PARTS[name]
        _ordered(needs, seen)
        if name not in seen:
            seen.append(name)
    return seen


def sql(body: str, *needs: str, recursive: bool = False) -> str:
    """``body`` behind the named fragments it needs.

    A body may continue the WITH list by starting with a comma.
    """
    names = _ordered(needs, [])
    parts = ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][1]})" if n in _SHARED else f"{n} AS ({_PARTS[n][1]})"
                       for n in names)
    head = "WITH RECURSIVE " if recursive else "WITH "
    return (head + parts + "\n" + body) if names else body


_SHARED = {"panel", "prices", "ensured", "rets"}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, folder) -> DataFrame`` under ``name``."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add
