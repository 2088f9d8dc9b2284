"""Functions of a results string such as ``1N21121``, as Spark SQL text."""

from __future__ import annotations


def count_of(results: str, symbol: str) -> str:
    return f"(length({results}) - length(replace({results}, '{symbol}', '')))"


def profile(results: str = "results") -> str:
    """Counts of home wins, draws and away wins as ``a-b-c``."""
    return f"concat_ws('-', {', '.join(count_of(results, s) for s in ('1', 'N', '2'))})"


def _plogp(p: str) -> str:
    return f"(CASE WHEN {p} > 0 THEN -({p}) * log2({p}) ELSE 0.0D END)"


def entropy_1n2(results: str = "results") -> str:
    """Shannon entropy of the three outcomes over the full length; 0 when empty."""
    terms = " + ".join(_plogp(f"({count_of(results, s)} / length({results}))") for s in ("1", "N", "2"))
    return f"(CASE WHEN length({results}) > 0 THEN {terms} ELSE 0.0D END)"


def entropy(results: str = "results") -> str:
    """Shannon entropy over whatever symbols occur; 0 when empty."""
    p = f"((length({results}) - length(replace({results}, s, ''))) / length({results}))"
    return (f"(CASE WHEN length({results}) > 0 THEN aggregate(array_sort(array_distinct(split({results}, ''))), "
            f"0.0D, (acc, s) -> acc + {_plogp(p)}) ELSE 0.0D END)")


def _positions(n: str) -> str:
    return f"sequence(1, greatest({n}, 1))"


def alternation(results: str = "results") -> str:
    """Share of neighbouring symbols that differ; 0 below two symbols."""
    n = f"length({results})"
    changes = (f"size(filter({_positions(n)}, i -> i > 1 AND i <= {n} "
               f"AND substr({results}, i, 1) <> substr({results}, i - 1, 1)))")
    return f"(CASE WHEN {n} > 1 THEN {changes} / ({n} - 1) ELSE 0.0D END)"


def longest_run(results: str = "results") -> str:
    """Length of the longest block of one repeated symbol; 0 when empty.

    The text is cut into its runs, so the longest run is the longest piece.
    """
    return (f"coalesce(array_max(transform(regexp_extract_all({results}, r'((.)\\2*)', 1), "
            f"r -> length(r))), 0)")


def chaos_without_odds(results: str = "results") -> str:
    """Share of draws and away wins."""
    return (f"(CASE WHEN length({results}) > 0 THEN ({count_of(results, 'N')} + {count_of(results, '2')}) "
            f"/ length({results}) ELSE 0.0D END)")


def matching_positions(left: str, right: str) -> str:
    """Number of positions where two strings agree, up to the shorter one."""
    n = f"least(length({left}), length({right}))"
    return f"size(filter({_positions(n)}, i -> i <= {n} AND substr({left}, i, 1) = substr({right}, i, 1)))"
