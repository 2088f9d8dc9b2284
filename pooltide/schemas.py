"""Explicit schemas of the tables and documents the library reads."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

TEAMS = _struct(id=_L, name=_S, country=_S, competition=_S, logo_url=_S, api_id=_L)
COMPETITIONS = _struct(id=_L, name=_S, country=_S, season=_S, api_id=_L)
MATCHES = _struct(
    id=_L, date=T.TimestampType(), home_team_id=_L, away_team_id=_L, competition_id=_L,
    home_score=_I, away_score=_I, result=_S, season=_S, matchday=_I,
)
ODDS = _struct(
    id=_L, match_id=_L, odds_1=_D, odds_n=_D, odds_2=_D, bookmaker=_S, read_at=T.TimestampType(),
)
COUPONS = _struct(
    id=_L, date=T.DateType(), grid_type=_S, results=_S, top_amount=_D, top_winners=_I, total_stake=_D,
)
COUPON_LEGS = _struct(id=_L, coupon_id=_L, position=_I, match_id=_L, result=_S)
COUPON_STATS = _struct(
    id=_L, coupon_id=_L, n_1=_I, n_n=_I, n_2=_I, chaos=_D, entropy=_D, alternation=_D, profile=_S, longest_run=_I,
)

PAYOUT = _struct(winners=_L, amount=_D)
PAYOUTS = T.MapType(_S, PAYOUT)

# Field names of the stored coupon-history document.
HISTORY_LEG_DOC = _struct(
    position=_I, home=_S, away=_S, cote_1=_D, cote_n=_D, cote_2=_D,
    pct_1=_D, pct_n=_D, pct_2=_D, prono_cyborg=_S, score=_S, resultat=_S,
)
HISTORY_DOC = _struct(
    grid_number=_L, year=_I, season=_S, grid_type=_S, nb_matchs=_I,
    matches=T.ArrayType(HISTORY_LEG_DOC), difficulty=_D, nb_pronostics=_L,
    resultats=_S, profil=_S,
    rapports=T.MapType(_S, _struct(gagnants=_L, montant=_D)),
)

# Field names of the stored ledger document.
LEDGER_BET_DOC = _struct(resultats=_S, n_correct=_I, payout=_D)
LEDGER_ENTRY_DOC = _struct(
    id=_S, grid_number=_L, grid_type=_S, date=_S, status=_S,
    grids_submitted=T.ArrayType(LEDGER_BET_DOC),
    cost=_D, total_payout=_D, net=_D, bankroll_after=_D, actual_results=_S,
    rapports=T.MapType(_S, _struct(gagnants=_L, montant=_D)),
)
LEDGER_DOC = _struct(
    initial_bankroll=_D, cost_per_grid=_D, grids_per_draw=_I, entries=T.ArrayType(LEDGER_ENTRY_DOC),
)

RULE = _struct(metric=_S, threshold=_D, direction=_S, recommended=_S, accuracy=_D, support=_L)
RULES_DOC = _struct(rules=T.ArrayType(RULE), accuracy=_D, n_grids=_L)

BOOKMAKER_EVENT = _struct(
    id=_S, home_team=_S, away_team=_S, commence_time=_S,
    bookmakers=T.ArrayType(_struct(
        key=_S,
        markets=T.ArrayType(_struct(
            key=_S, outcomes=T.ArrayType(_struct(name=_S, price=_D)),
        )),
    )),
)
