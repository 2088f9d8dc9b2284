"""Leg-level signals: implied probabilities, crowd shares, tips and favourites.

Outcomes are always ordered home (``1``), draw (``N``), away (``2``); every
"best of three" takes the first of equal values. Expressions read the leg
columns ``odds_*``, ``share_*``, ``tip`` and ``result``.
"""

from __future__ import annotations

OUTCOMES = ("1", "N", "2")
ODDS = ("odds_1", "odds_n", "odds_2")
SHARES = ("share_1", "share_n", "share_2")
SUFFIXES = ("1", "n", "2")

# Long-run shares of home win, draw and away win.
PRIOR = (0.40, 0.29, 0.31)

# Tip weights for one named outcome, two named outcomes, and the rest.
TIP_SINGLE, TIP_DOUBLE, TIP_OTHER = 0.80, 0.45, 0.10

THIRD = "(1.0D / 3.0D)"


def positive(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} END"


ALL_ODDS = "(odds_1 > 0 AND odds_n > 0 AND odds_2 > 0)"
FAVOURITE = f"least({', '.join(positive(c) for c in ODDS)})"
OUTSIDER = f"greatest({', '.join(positive(c) for c in ODDS)})"
HAS_TIP = "(length(trim(coalesce(tip, ''))) > 0)"
RESULT_INDEX = "CASE result WHEN '1' THEN 1 WHEN 'N' THEN 2 WHEN '2' THEN 3 END"


def first_max_index(a: str, b: str, c: str) -> str:
    """1, 2 or 3: the first of three holding the largest value."""
    return f"CASE WHEN {a} >= {b} AND {a} >= {c} THEN 1 WHEN {b} >= {c} THEN 2 ELSE 3 END"


def first_index_of(values: tuple[str, str, str], wanted: str) -> str:
    a, b, c = values
    return f"CASE WHEN {a} = {wanted} THEN 1 WHEN {b} = {wanted} THEN 2 WHEN {c} = {wanted} THEN 3 END"


def pick(values: tuple[str, str, str], index: str) -> str:
    a, b, c = values
    return f"CASE {index} WHEN 1 THEN {a} WHEN 2 THEN {b} WHEN 3 THEN {c} END"


def outcome(index: str) -> str:
    return f"CASE {index} WHEN 1 THEN '1' WHEN 2 THEN 'N' ELSE '2' END"


def implied_probabilities() -> dict[str, str]:
    """Odds without the bookmaker margin; 1/3 each unless all three are positive."""
    raw = {c: f"CASE WHEN {c} > 0 THEN 1.0D / {c} ELSE 0.0D END" for c in ODDS}
    total = " + ".join(f"({x})" for x in raw.values())
    return {f"odds_p{k}": f"CASE WHEN {ALL_ODDS} THEN ({raw[c]}) / ({total}) ELSE {THIRD} END"
            for k, c in zip(SUFFIXES, ODDS)}


def crowd_probabilities() -> dict[str, str]:
    """Player shares scaled to one; 1/3 each when nobody played."""
    total = " + ".join(SHARES)
    return {f"crowd_p{k}": f"CASE WHEN {total} > 0 THEN {c} / ({total}) ELSE {THIRD} END"
            for k, c in zip(SUFFIXES, SHARES)}


def tip_probabilities() -> dict[str, str]:
    """A third-party tip (a subset of ``1N2``) as probabilities."""
    text = "upper(trim(coalesce(tip, '')))"
    named = {o: f"(instr({text}, '{o}') > 0)" for o in OUTCOMES}
    count = "(" + " + ".join(f"int({x})" for x in named.values()) + ")"
    return {
        f"tip_p{k}": f"CASE {count} WHEN 1 THEN IF({named[o]}, {TIP_SINGLE}D, {TIP_OTHER}D) "
                     f"WHEN 2 THEN IF({named[o]}, {TIP_DOUBLE}D, {TIP_OTHER}D) ELSE {THIRD} END"
        for k, o in zip(SUFFIXES, OUTCOMES)}


def leg_category(fav: str = "fav") -> str:
    """Class of a leg by its favourite's odds."""
    return f"CASE WHEN {fav} < 1.5D THEN 'sure' WHEN {fav} < 2.0D THEN 'medium' WHEN {fav} IS NOT NULL THEN 'tight' END"
