"""Folds over arrays, as SQL text."""

from __future__ import annotations

#: Entries that a running value is carried over at once: a fold copies what it has put together for each entry.
STRIDE = 128
SUM, MAXIMUM = "{a} + {b}", "greatest({a}, {b})"


def running(entries: str, value: str, join: str = SUM) -> str:
    """SQL: for each entry of the array ``entries`` the value joined over all before it, from 0, as bigint.

    ``entries`` is a column or a bound variable, ``value`` an expression of the entry
    ``e``, ``join`` of ``a`` and ``b``. Two levels of folds, so the work grows with the
    entries, not with their square.
    """

    def fold(many: str, var: str, own: str) -> str:
        return f"aggregate({many}, struct(0L as at, cast(array() as array<bigint>) as out), (s, {var}) -> struct(cast({join.format(a='s.at', b=own)} as bigint) as at, concat(s.out, array(s.at)) as out))"

    strides = f"transform(sequence(0, (size({entries}) - 1) div {STRIDE}), i -> slice({entries}, i * {STRIDE} + 1, {STRIDE}))"
    inner = f"transform({strides}, some -> {fold('some', 'e', value)})"
    whole = f"flatten(zip_with(inner, {fold('inner', 'c', 'c.at')}.out, (c, before) -> transform(c.out, own -> {join.format(a='before', b='own')})))"
    return f"element_at(transform(array({inner}), inner -> {whole}), 1)"
