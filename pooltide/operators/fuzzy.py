"""Filling missing odds from bookmaker events by team-name similarity.

Names are compared once per distinct pair, never per leg. Candidates come from
equi-joins that cannot miss a pair scoring at least the threshold: equal names, a
name inside another (joined on its substrings), and a prefix filter on characters.
Fixtures are compared by both names at once, at falling thresholds, and bounds of
both scores are held against the threshold before any match ratio is computed. No
candidate is dropped by a cap.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType

from pooltide.functions import odds as O
from pooltide.functions import text as X
from pooltide.operators.legs import with_exprs
from pooltide.operators.staging import spread, staged

# Score of a contained name, and the lowest accepted mean score.
CONTAINED, THRESHOLD = 0.85, 0.55

#: Mean scores searched for in turn; a fixture that found its best leaves before the next, wider search.
ROUNDS = (0.85, 0.7, THRESHOLD)
#: Events that one task joins by one character at most, about.
EVENTS_PER_KEY = 4096


@F.pandas_udf(DoubleType())
def _sequence_ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in batches:
        yield pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)])


def name_score(pairs: DataFrame, left: str, right: str, name: str = "score") -> DataFrame:
    """Similarity of two normalised names: 1 when equal, 0.85 when one contains the other, else the match ratio.

    Python sees only the pairs the two native rules leave open.
    """
    native = with_exprs(pairs, {name: f"""CASE WHEN {left} = {right} THEN 1.0D
        WHEN instr({left}, {right}) > 0 OR instr({right}, {left}) > 0 THEN {CONTAINED}D END"""})
    known = native.where(f"{name} IS NOT NULL")
    open_pairs = native.where(f"{name} IS NULL").withColumn(name, _sequence_ratio(F.col(left), F.col(right)))
    return known.unionByName(open_pairs)


def score_bound(left: str, right: str) -> str:
    """SQL: what ``name_score`` can reach at most. Matched characters form a common subsequence, of which
    names of distance d have (|a| + |b| - d) / 2 at most."""
    return f"""CASE WHEN {left} = {right} THEN 1.0D WHEN instr({left}, {right}) > 0 OR instr({right}, {left}) > 0 THEN {CONTAINED}D
        ELSE 1.0D - levenshtein({left}, {right}) / (length({left}) + length({right})) END"""


def _tokens(names: DataFrame, column: str) -> DataFrame:
    """Characters of a name, numbered by occurrence, so that a multiset becomes a set."""
    chars = names.selectExpr(column, f"posexplode(split({column}, '')) AS (at, ch)")
    return with_exprs(chars, {"nth": f"row_number() OVER (PARTITION BY {column}, ch ORDER BY at)"}).selectExpr(
        column, "concat(ch, nth) AS token", f"length({column}) AS size")


def contained_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b): pairs of which one contains the other, joined on the substrings of the longer one."""
    parts = "explode(array_distinct(flatten(transform(sequence(1, length({0})), i -> transform(sequence(1, length({0}) - i + 1), n -> substr({0}, i, n)))))) AS part"
    inside_b = b.selectExpr("b", parts.format("b")).join(a, F.expr("part = a")).select("a", "b")
    inside_a = a.selectExpr("a", parts.format("a")).join(b, F.expr("part = b")).where("a <> b").select("a", "b")
    return inside_b.unionByName(inside_a)


def similar_names(left: DataFrame, right: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """All pairs of distinct names (column ``name``) scoring at least ``threshold``.

    A match ratio of t needs at least t/2 (|a| + |b|) common characters, and no
    name is shorter than t/(2-t) of the other; so two such names share one of
    their rarest characters, counted up to the length of that prefix.
    """
    a, b = left.selectExpr("name AS a").distinct(), right.selectExpr("name AS b").distinct()
    common = threshold / 2 * (1 + threshold / (2 - threshold))
    tokens = _tokens(a, "a").selectExpr("a AS name", "token", "size", "0 AS side").unionByName(
        _tokens(b, "b").selectExpr("b AS name", "token", "size", "1 AS side"))
    rarity = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("seen"))
    ranked = with_exprs(tokens.join(rarity, "token"), {
        "place": "row_number() OVER (PARTITION BY side, name ORDER BY seen, token)"})
    prefix = ranked.where(f"place <= size - ceil(size * {common!r}D - 1e-9D) + 1")
    pa = prefix.where("side = 0").selectExpr("name AS a", "token", "size AS la")
    pb = prefix.where("side = 1").selectExpr("name AS b", "token", "size AS lb")
    by_ratio = pa.join(pb, "token").where(f"2 * least(la, lb) >= {threshold!r}D * (la + lb) - 1e-9D").select("a", "b")
    pairs = by_ratio.unionByName(contained_names(a, b)).distinct().where(f"{score_bound('a', 'b')} >= {threshold!r}D - 1e-9D")
    return name_score(pairs, "a", "b").where(f"score >= {threshold!r}D")


def _weighted(records: DataFrame, x: str, y: str) -> DataFrame:
    """The characters of both names of a record, numbered by occurrence; those of one name weigh 1 together."""
    def chars(name: str, side: str) -> str:
        letters = f"array_sort(split({name}, ''))"
        return (f"transform({letters}, (c, i) -> struct(concat('{side}', c, i + 2 - array_position({letters}, c)) AS token, "
                f"1.0D / length({name}) AS w))")

    return records.selectExpr("*", f"explode(concat({chars(x, 'x')}, {chars(y, 'y')})) AS t").selectExpr(*records.columns, "t.token", "t.w")


def _by_rarity(tokens: DataFrame, places: DataFrame, keys: list[str]) -> DataFrame:
    """One row a record: its characters as ranks, rarest first, and the weight left from each on."""
    listed = tokens.join(places, "token").groupBy(*keys).agg(F.expr("array_sort(collect_list(struct(place, w)))").alias("l"))
    return listed.selectExpr(*keys, "l.place AS ranks", "transform(l, (t, i) -> aggregate(slice(l, i + 1, size(l)), 0.0D, (s, z) -> s + z.w)) AS rests")


def fixture_candidates(wanted: DataFrame, events: DataFrame, threshold: float) -> DataFrame:
    """(h, a, eh, ea, event_no, token, salt), once a pair: fixtures and events whose characters allow a mean score of ``threshold``.

    Both inputs carry ``ranks`` and ``rests``. Of a name, let x be the share of characters that
    the other name has too. The match ratio is 2x / (1 + x) at most, a concave function, so two
    ratios of mean t need x + y >= 2t / (2 - t). Order characters by rarity: the rarest common
    one then stands, in both records, where at least that much weight is left. A pair is taken
    where this character joins it, so it is made once. Characters of many events are split.
    A few names mean many pairs, so both sides are spread over tasks: either may be broadcast.
    """
    left = 2 * threshold / (2 - threshold) - 1e-9

    def exploded(df: DataFrame) -> DataFrame:
        prefix = df.withColumn("prefix", F.expr(f"slice(ranks, 1, size(filter(rests, r -> r >= {left!r}D)))")).drop("ranks", "rests")
        return prefix.withColumn("token", F.explode("prefix"))

    own, feed = exploded(wanted), exploded(events)
    splits = feed.groupBy("token").agg(F.expr(f"1 + count(*) DIV {EVENTS_PER_KEY}").alias("splits"))
    own = own.join(splits, "token").withColumn("salt", F.explode(F.expr("sequence(0, splits - 1)"))).drop("splits")
    feed = feed.join(splits, "token").withColumn("salt", F.expr("pmod(xxhash64(eh, ea), splits)")).drop("splits").withColumnRenamed("prefix", "theirs")
    fits = "2.0D * least(length({0}), length({1})) / (length({0}) + length({1}))"
    own, feed = spread(own, "h", "a", "token", "salt"), spread(feed, "eh", "ea", "token", "salt")
    return own.join(feed, ["token", "salt"]).where(
        f"array_intersect(prefix, theirs)[0] = token AND {fits.format('h', 'eh')} + {fits.format('a', 'ea')} >= {2 * threshold - 1e-9!r}D"
    ).select("h", "a", "eh", "ea", "event_no", "token", "salt")


def fill_missing_odds(legs: DataFrame, events: DataFrame) -> DataFrame:
    """Legs with the odds of their best-matching event where one of theirs is missing.

    ``legs`` and ``events`` carry ``home``, ``away`` and odds; events also
    ``event_no`` (their order). The best event is the first with the highest mean
    score of the two names, at least 0.55; only then are its odds required to be
    complete. Names that normalise to nothing take no part.

    Runs jobs: events, distinct names, candidates and scores are stored, since several
    joins read them. They are as small as the fixture lists. Names are normalised once
    a pair of names, not once a leg; legs meet their odds by the names they have.
    """
    lacks = f"NOT coalesce({O.ALL_ODDS}, false)"
    names = staged(legs.groupBy("home", "away").agg(F.expr(f"bool_or({lacks})").alias("lacks")).selectExpr(
        "home", "away", "lacks", f"{X.normalized_team('home')} AS h", f"{X.normalized_team('away')} AS a"), "leg_names")
    feed = staged(events.selectExpr("event_no", f"{X.normalized_team('home')} AS eh", f"{X.normalized_team('away')} AS ea",
                                    *(f"{c} AS event_{c}" for c in O.ODDS)).where("eh <> '' AND ea <> ''"), "priced_events")
    wanted = staged(names.where("lacks AND h <> '' AND a <> ''").select("h", "a").distinct(), "wanted_names")
    # Equal pairs compare alike: the first event of each pair of names stands for it.
    first = staged(feed.groupBy("eh", "ea").agg(F.expr("min(event_no)").alias("event_no")), "event_names")
    best = best_events(wanted, first)
    matched = best.withColumnRenamed("score", "_mean").join(feed.drop("eh", "ea"), "event_no").where(" AND ".join(f"event_{c} > 0" for c in O.ODDS))
    joined = legs.join(names.drop("lacks").join(matched.drop("event_no"), ["h", "a"]).drop("h", "a"), ["home", "away"], "left")
    filled = f"{lacks} AND _mean IS NOT NULL"
    return joined.selectExpr(
        *(c for c in legs.columns if c not in O.ODDS),
        *(f"IF({filled}, event_{c}, {c}) AS {c}" for c in O.ODDS),
        f"IF({filled}, 'events', 'own') AS odds_source", f"IF({filled}, _mean, CAST(NULL AS DOUBLE)) AS match_score")


def best_events(wanted: DataFrame, events: DataFrame, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """(h, a, event_no, score): the first event of the highest mean score, for pairs of names that reach the last of ``rounds``.

    ``events`` has each pair of names once. A score of 1 cannot be beaten, so equal pairs are
    settled first. Each round then finds every event at or above its threshold: what it settles
    is final, and only the rest is searched more widely.
    """
    exact = wanted.join(events, F.expr("h = eh AND a = ea")).selectExpr("h", "a", "event_no", "1.0D AS score")
    rest = staged(wanted.join(exact, ["h", "a"], "left_anti"), "wanted_rest")
    out = exact
    own_chars, event_chars = _weighted(rest, "h", "a"), _weighted(events, "eh", "ea")
    places = with_exprs(own_chars.select("token").unionByName(event_chars.select("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("seen")), {"place": "row_number() OVER (ORDER BY seen, token)"}).select("token", "place")
    places = staged(places, "name_characters")  # one row a character, its occurrence in a name, and side
    own = staged(_by_rarity(own_chars, places, ["h", "a"]), "wanted_characters")
    feed = staged(_by_rarity(event_chars, places, ["eh", "ea", "event_no"]), "event_characters")
    homes = staged(contained_names(rest.selectExpr("h AS a").distinct(), events.selectExpr("eh AS b").distinct()).selectExpr("a AS h", "b AS eh"), "contained_homes")
    aways = staged(contained_names(rest.selectExpr("a").distinct(), events.selectExpr("ea AS b").distinct()).selectExpr("a", "b AS ea"), "contained_aways")
    for threshold in rounds:
        if rest.isEmpty():
            break
        near = f"{score_bound('h', 'eh')} + {score_bound('a', 'ea')} >= {2 * threshold - 1e-9!r}D"
        inside = rest.join(homes.where("h <> eh"), "h").join(events, "eh").select("h", "a", "eh", "ea", "event_no").unionByName(
            rest.join(aways.where("a <> ea"), "a").join(events, "ea").select("h", "a", "eh", "ea", "event_no"))
        pairs = staged(fixture_candidates(own, feed, threshold).drop("token", "salt").where(near).unionByName(inside.where(near)).distinct(), "name_candidates")
        # Each distinct pair of names is scored once.
        name_pairs = pairs.selectExpr("h AS x", "eh AS y").unionByName(pairs.selectExpr("a AS x", "ea AS y")).distinct()
        scores = staged(name_score(name_pairs, "x", "y"), "name_scores")
        both = (pairs.join(scores.selectExpr("x AS h", "y AS eh", "score AS home_score"), ["h", "eh"])
                .join(scores.selectExpr("x AS a", "y AS ea", "score AS away_score"), ["a", "ea"]))
        found = staged(both.groupBy("h", "a").agg(F.expr("min(struct(-(home_score + away_score) / 2 AS neg, event_no))").alias("m")).selectExpr(
            "h", "a", "m.event_no AS event_no", "-m.neg AS score").where(f"score >= {threshold!r}D"), "best_events")
        out = out.unionByName(found)
        if threshold != rounds[-1]:
            rest = staged(rest.join(found, ["h", "a"], "left_anti"), "wanted_rest")
            own = own.join(rest, ["h", "a"], "left_semi")
    return out
