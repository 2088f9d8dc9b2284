"""Readers, pages, maintenance, fuzzy matching on small fixtures."""

import datetime as dt
import json
from difflib import SequenceMatcher

import pytest

from pooltide.functions import text as X
from pooltide.operators import fuzzy as Z
from pooltide.sources import documents as D
from pooltide.sources import pages as P
from pooltide.sources import season_csv as CSV
from pooltide.sources import tables as T

CSV_A = """Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,FTR,HTHG,B365H,B365D,B365A,BWH,BWD,BWA
Q7,02/03/2024,Vertmont,Larcady,4,4,D,1,2.10,3.60,2.80,2.20,3.51,2.95
Q7,03/03/2024,Ostrelle,Pontaven,0,0,D,0,1.45,4.50,8.0,1.40,4.75,7.5
Q7,03/03/24,Brisecourt,Valombre,3,0,H,1,,,,bad,1.0,
Q7,,Tourdun,Quermel,1,5,A,1,3.3,3.4,2.0,3.3,3.4,2.0
Q7,04/03/2024,,Quermel,1,5,A,1,3.3,3.4,2.0,3.3,3.4,2.0
Q7,04/03/2024,Haudrey,Sermaize
Q7,05/03/2024,Ferrigny,Noirlac,0,2,A,1,2.7,3.1,2.6,2.7,3.1,2.6,7,7,7
"""


@pytest.fixture()
def season_dir(tmp_path):
    (tmp_path / "F1_2425.csv").write_bytes(("﻿" + CSV_A).encode("utf-8"))
    (tmp_path / "E0_9899.csv").write_bytes("Date,HomeTeam,AwayTeam,FTR\n21/11/98,Guéronde,\"Stoke, North\",A\n".encode("latin-1"))
    (tmp_path / "X1_2122.csv").write_text("Date,HomeTeam\n01/01/2021,Solo\n")
    return str(tmp_path)


def test_season_files_are_read_by_column_name(spark, season_dir):
    parsed = CSV.parse_season_files(CSV.read_season_files(spark, season_dir))
    rows = {(r.file, r.row_no): r for r in parsed.collect()}
    first = rows["F1_2425.csv", 1]
    assert (first.league_code, first.season, first.date, first.result) == ("F1", "2024/2025", dt.date(2024, 3, 2), "N")
    assert (first.odds_1, first.odds_n, first.odds_2) == (2.15, 3.56, 2.88)
    assert (first.home_score, first.away_score) == (4, 4)
    third = rows["F1_2425.csv", 3]
    assert third.date == dt.date(2024, 3, 3) and third.odds_1 is None and third.odds_n is None
    assert rows["E0_9899.csv", 1].home == "Guéronde" and rows["E0_9899.csv", 1].away == "Stoke, North"
    assert rows["E0_9899.csv", 1].season == "1998/1999"
    assert not rows["X1_2122.csv", 0].valid
    # The over-long line is gone; the short one is kept as an invalid row.
    assert sum(f == "F1_2425.csv" for f, _ in rows) == 6
    assert CSV.with_leagues(parsed.where("file LIKE 'F1%'")).first().league == "Ligue 1"


def test_import_twice_inserts_once(spark, season_dir):
    parsed = CSV.parse_season_files(CSV.read_season_files(spark, season_dir))
    order = ["file", "row_no"]
    new = T.new_rows(parsed.where("valid"), parsed.select(*CSV.MATCH_KEY).where("false"), CSV.MATCH_KEY, order)
    first = {r.file: (r.inserted, r.skipped, r.errors) for r in CSV.load_report(parsed, new).collect()}
    assert first == {"F1_2425.csv": (3, 0, 3), "E0_9899.csv": (1, 0, 0), "X1_2122.csv": (0, 0, 1)}
    again = T.new_rows(parsed.where("valid"), new, CSV.MATCH_KEY, order)
    assert again.count() == 0
    assert sum(r.skipped for r in CSV.load_report(parsed, again).collect()) == 4


def test_first_row_of_a_key_wins(spark):
    old = spark.createDataFrame([("a", 1, "old")], "k string, n int, v string")
    new = spark.createDataFrame([("a", 2, "x"), ("b", 3, "second"), ("b", 1, "first"), ("c", 1, None)], "k string, n int, v string")
    assert sorted(map(tuple, T.merge_first_wins(old, new, ["k"], ["n"]).collect()), key=str) == sorted(
        [("a", 1, "old"), ("b", 1, "first"), ("c", 1, None)], key=str)
    assert sorted(map(tuple, T.upsert(old, new.limit(1), ["k"]).collect())) == [("a", 2, "x")]


@pytest.mark.parametrize("results, kept", [
    (["a", "b", "b", "b", "c"], 3), (["a", "a", "b", "b"], 4), (["a", "", "", "", "b"], 2), (["x", "x", "x"], 2),
    (["a", "b", "a", "b", "b", "b", "b"], 5),
])
def test_season_cut(spark, results, kept):
    df = spark.createDataFrame([("LF7", "s", i, r, 7) for i, r in enumerate(results, 1)], "grid_type string, season string, number bigint, results string, n_legs int")
    assert T.season_cut(df, block_rows=3).count() == kept


def test_history_documents(spark, tmp_path):
    doc = [{"grid_number": 5, "year": 2026, "season": "2025-2026", "difficulty": 3.5, "resultats": "1N",
            "matches": [{"home": "A", "away": "B", "cote_1": 1.5, "cote_n": 3.0, "cote_2": 5, "pct_1": 60, "pct_n": 20, "pct_2": 20, "prono_cyborg": "1", "resultat": "1"},
                        {"home": "C", "away": "D", "resultat": "N"}],
            "rapports": {"2_sur_2": {"gagnants": 3, "montant": 10.5}}},
           {"grid_number": 6, "year": 2026, "matches": []}]
    path = tmp_path / "h.json"
    path.write_text(json.dumps(doc))
    history = D.read_history(spark, str(path))
    coupon = D.history_coupons(history).where("grid_number = 5").first()
    assert (coupon.grid_type, coupon.n_legs, coupon.payouts["2_sur_2"].amount) == ("LF2", 2, 10.5)
    assert D.history_coupons(history).where("grid_number = 6").first().season == "2025-2026"
    legs = D.history_legs(history).orderBy("position").collect()
    assert [(r.position, r.odds_1, r.tip, r.result) for r in legs] == [(1, 1.5, "1", "1"), (2, 0.0, "", "N")]
    out = str(tmp_path / "stored")
    D.write_history(D.history_coupons(history), out)
    assert spark.read.parquet(out).where("season = '2025-2026'").count() == 2
    assert D.read_history(spark, str(tmp_path / "absent.json")).count() == 0


def test_ledger_and_rules_documents(spark, tmp_path):
    default = D.read_ledger(spark, str(tmp_path / "none.json")).first()
    assert (default.initial_bankroll, default.grids_per_draw, default.entries) == (100.0, 5, [])
    broken = tmp_path / "broken.json"
    broken.write_text("{nope")
    assert D.read_ledger(spark, str(broken)).first().initial_bankroll == 100.0
    assert D.read_rules(spark, str(broken)).count() == 0
    good = tmp_path / "ledger.json"
    good.write_text(json.dumps({"initial_bankroll": 50.0, "cost_per_grid": 1.0, "grids_per_draw": 5, "entries": [
        {"id": "LF7-1", "grid_number": 1, "grid_type": "LF7", "date": "2026-01-02", "status": "resolved", "cost": 1.0, "total_payout": 0.0,
         "net": -1.0, "bankroll_after": 49.0, "actual_results": "1111111", "grids_submitted": [{"resultats": "1111112", "n_correct": 6, "payout": 0.0}],
         "rapports": {"7_sur_7": {"gagnants": 1, "montant": 9.0}}}]}))
    entry = D.ledger_entries(D.read_ledger(spark, str(good))).first()
    assert entry.entry_id == "LF7-1" and entry.bets == ["1111112"] and entry.entry_date == dt.date(2026, 1, 2)
    rules = tmp_path / "rules.json"
    rules.write_text(json.dumps({"rules": [{"metric": "difficulty", "threshold": 5.0, "direction": "low", "recommended": "bold", "accuracy": 0.5, "support": 9}]}))
    assert D.read_rules(spark, str(rules)).first().recommended == "bold"


def test_event_odds(spark):
    def market(key, **prices):
        return {"key": key, "outcomes": [{"name": k, "price": v} for k, v in prices.items()]}
    events = spark.createDataFrame([(
        "e", "H", "A", "", [{"key": "x", "markets": [market("h2h", H=2.0, Draw=3.0, A=4.0)]},
                            {"key": "y", "markets": [market("totals", H=9.0), market("h2h", H=2.1, A=4.1)]}]),
        ("none", "H", "A", "", [])], D.schemas.BOOKMAKER_EVENT)
    rows = {r.id: (r.odds_1, r.odds_n, r.odds_2) for r in D.mean_event_odds(events).collect()}
    assert rows == {"e": (2.05, 3.0, 4.05), "none": (0.0, 0.0, 0.0)}


DISTRIBUTION = """<html><body><h3>Indice de difficulté</h3><p>4,6</p><p>Répartition basée sur 12 305 pronostics</p>
<table class="autre"><tr><td class="match">Sans - Effet</td><td class="cote">2</td><td class="cote">2</td><td class="cote">2</td></tr></table>
<table class="prono-cyb-des large"><tr><th>Rencontre</th></tr>
<tr><td class="match">Vertmont - Larcady</td><td class="cote-bet">41.5%2.60</td><td class="cote-d">33.0%3.05</td><td class="cote-d">25.5%2.90</td><td class="prono_match">1N</td><td class="dev_desktop_td_score">0-0</td></tr>
<tr><td class="match">Une seule equipe</td><td class="cote-d">4</td><td class="cote-d">5</td><td class="cote-d">6</td></tr>
<tr><td class="match">Ostrelle – Pontaven</td><td class="cote-d">-</td><td class="cote-d">17%</td><td class="cote-d">8</td><td class="prono_match">2</td></tr>
<tr><td class="match">Tourdun - Quermel</td><td class="cote-d">55%</td><td class="cote-d">-4,20</td></tr></table></body></html>"""

RESULT = """<table class="hist"><tr><td>1</td><td><span class="res">2</span></td></tr><tr><td>2<td><span class="res">2</span></tr><tr><td>3</td><td><span class="res">N</span></td></tr><tr><td>4</td><td><span class="res">1</span></td></tr></table>
<table><tr><th>Rapport des gagnants</th></tr><tr><td>4 sur 4</td><td>7</td><td>30 415,60 €</td></tr><tr><td>3 / 4</td><td>1 108</td><td>8,05 €</td></tr></table>"""


def _elements(spark, html):
    return P.page_elements(spark.createDataFrame([(1, html)], "page_id bigint, html string"))


def test_distribution_page(spark):
    e = _elements(spark, DISTRIBUTION)
    legs = P.distribution_legs(e).orderBy("position").collect()
    assert [(r.position, r.home, r.away, r.tip, r.score) for r in legs] == [
        (1, "Vertmont", "Larcady", "1N", "0-0"), (2, "Ostrelle", "Pontaven", "2", "")]
    assert (legs[0].share_1, legs[0].odds_n, legs[0].share_2, legs[0].odds_2) == (41.5, 3.05, 25.5, 2.9)
    assert legs[1].odds_1 == 0.0 and legs[1].share_n == 0.0
    head = P.distribution_headers(e).first()
    assert (head.difficulty, head.n_tips) == (4.6, 12305)


def test_result_page(spark):
    e = _elements(spark, RESULT)
    assert tuple(P.result_pages(e).first())[1:] == ("22N1", "1-1-2")
    sizes = spark.createDataFrame([(1, 4)], "page_id bigint, n_legs int")
    assert {r.rank_key: (r.winners, r.amount) for r in P.payout_rows(e, sizes).collect()} == {
        "4_sur_4": (7, 30415.6), "3_sur_4": (1108, 8.05)}


def test_upcoming_page(spark):
    row = '<tr><td>{0}</td><td class="equipe home">H{0}</td><td>-</td><td class="equipe ext">A{0}</td></tr>'
    html = ('<table class="grilles-lf"><tbody><tr><th colspan="4">LF 7 - LF 12</th></tr><tr class="valid"><th colspan="4">Avant le '
            '<span data-date-utc="bad">Jeudi 23 Juillet à 18h55</span></th></tr>' + "".join(row.format(i) for i in range(1, 11)) + "</tbody></table>")
    got = {r.grid_type: r for r in P.upcoming_coupons(_elements(spark, html), 2026).collect()}
    assert {k: len(r.legs) for k, r in got.items()} == {"LF7": 7, "LF12": 10}
    assert got["LF7"].grid_number is None and got["LF7"].date == dt.date(2026, 7, 23)


def test_profile_page(spark):
    rows = [("1", "5", "2", "88 fois"), ("0", "0", "8", "4 fois"), ("4", "?", "0", "6 fois"), ("2", "2", "4", "jamais"), ("1", "5", "2", "91 fois")]
    body = "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows)
    html = ('<table class="stat_1n2 haut"><tr><th>Par jour</th></tr><tr><td>6</td><td>1</td><td>1</td><td>2 fois</td></tr></table><p>entre</p>'
            f'<table class="stat_1n2"><tr><th colspan="4">Combinaisons 1N2 depuis 2019</th></tr>{body}</table>')
    assert {r.profile: r.n for r in P.profile_counts(_elements(spark, html)).collect()} == {"1-5-2": 91, "0-0-8": 4}
    assert P.profile_counts(_elements(spark, "")).count() == 0


def test_elements_are_nested_sets(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_ROWS", 3)
    deep = "<div>" * 300 + "core" + "</div>" * 299
    html = f"<ul><li>a<li><b>b</b> <i>c</i><script>var x = '<p>no</p>'</script></ul><p>one<p>two &amp; <br/>three<h4>end</h4>{deep}"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id bigint, html string")
    rows = P.page_elements(pages).collect()
    own = sorted((r for r in rows if r.page_id == 1 and r.node >= 0), key=lambda r: r.node)
    assert [r.node for r in own] == list(range(len(own)))
    of = {t: [r for r in own if r.tag == t] for t in {r.tag for r in own}}
    assert [r.text for r in of["li"]] == ["a", "bc"] and [r.text for r in of["script"]] == [""] and len(of["div"]) == 300
    assert [r.text for r in of["p"]] == ["one", "two &threeendcore"] and of["br"][0].last == of["br"][0].node
    for r in own:
        assert all(r.node < x.node <= r.last for x in own if x.node > r.node and x.depth > r.depth and x.node <= r.last)
        assert r.last == max([x.node for x in own if r.node <= x.node <= r.last]) and r.last < len(own)
    assert {r.node: r.last for r in of["li"]} == {of["li"][0].node: of["li"][0].node, of["li"][1].node: of["li"][1].node + 3}
    assert sorted((r.page_id, r.text) for r in rows if r.tag == "#page" and r.page_id > 1) == [(2, ""), (3, "")]


NAMES_A = ["paris saint germain", "marseille", "lyon", "as monaco", "nice", "saint etienne", "stade rennais", "psg"]
NAMES_B = ["paris sg", "olympique marseille", "olympique lyonnais", "monaco", "nice", "st etienne", "rennes", "psg paris", "zzz", "l"]


def _score(a, b):
    return 1.0 if a == b else 0.85 if a in b or b in a else SequenceMatcher(None, a, b).ratio()


def test_similar_names_miss_nothing(spark):
    frame = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    got = {(r.a, r.b): r.score for r in Z.similar_names(frame(NAMES_A), frame(NAMES_B)).collect()}
    want = {(a, b): s for a in NAMES_A for b in NAMES_B if (s := _score(a, b)) >= 0.55}
    assert got == pytest.approx(want)


def test_missing_odds_take_the_best_event(spark):
    legs = spark.createDataFrame([
        (1, "Paris Saint Germain", "Olympique Lyon", 0.0, 0.0, 0.0), (2, "Nice", "Monaco", 0.0, 0.0, 0.0),
        (3, "Nice", "Monaco", 2.0, 3.0, 4.0), (4, "Zulte", "Xanthi", 0.0, 0.0, 0.0), (5, "FC", "Lyon", 0.0, 0.0, 0.0)],
        "leg bigint, home string, away string, odds_1 double, odds_n double, odds_2 double")
    events = spark.createDataFrame([
        (1, "Lille", "Lens", 1.5, 4.0, 6.0), (2, "Paris SG", "Lyon", 1.4, 5.0, 7.0), (3, "OGC Nice", "AS Monaco", 0.0, 3.0, 3.0),
        (4, "Nice", "Monaco FC", 0.0, 3.0, 3.0), (5, "Nice", "Monaco", 2.2, 3.1, 3.2)],
        "event_no bigint, home string, away string, odds_1 double, odds_n double, odds_2 double")
    got = {r.leg: (r.odds_1, r.odds_source) for r in Z.fill_missing_odds(legs, events).collect()}
    assert got[1] == (1.4, "events")
    # The best event is chosen before its odds are looked at, and here it has none.
    assert got[2] == (0.0, "own")
    assert got[3] == (2.0, "own") and got[4] == (0.0, "own") and got[5] == (0.0, "own")


def test_fuzzy_match_equals_brute_force(spark):
    legs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in NAMES_A for b in NAMES_A if a != b)]
    feed = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in NAMES_B for b in NAMES_B if a != b)]
    schema = "{} bigint, home string, away string, odds_1 double, odds_n double, odds_2 double"
    got = {r.leg: (r.odds_1, r.match_score) for r in Z.fill_missing_odds(
        spark.createDataFrame([(*x, 0.0, 0.0, 0.0) for x in legs], schema.format("leg")),
        spark.createDataFrame([(*x, 2.0 + x[0], 3.0, 3.0) for x in feed], schema.format("event_no"))).collect()}
    drop = lambda n: " ".join(w for w in n.split() if w not in X.TEAM_WORDS)
    for i, a, b in legs:
        best, at = 0.0, None
        for j, x, y in feed:
            s = (_score(drop(a), drop(x)) + _score(drop(b), drop(y))) / 2
            if s > best:
                best, at = s, j
        if best >= 0.55:
            assert got[i] == (2.0 + at, pytest.approx(best)), (a, b)
        else:
            assert got[i] == (0.0, None)


def test_odds_filled_exact_keeps_legs_without_an_event(spark, monkeypatch):
    from pooltide.catalog import ingest

    rows = [(1, 1, "Lyon", "Nantes", 2.0, 3.0, 4.0), (1, 2, "Lyon", "Nantes", 0.0, 0.0, 0.0), (1, 3, "Qwxzk", "Jjvvb", 0.0, 0.0, 0.0)]
    legs = spark.createDataFrame(rows, "coupon_id bigint, position int, home string, away string, odds_1 double, odds_n double, odds_2 double")
    monkeypatch.setattr(ingest, "_leagued", lambda spark, sf: legs)
    got = [tuple(r) for r in ingest.odds_filled_exact(spark, "").orderBy("position").collect()]
    assert got == [(1, 1, 2.0, 3.0, 4.0, "own"), (1, 2, 2.0, 3.0, 4.0, "events"), (1, 3, 0.0, 0.0, 0.0, "own")]


def test_sure_pages_are_walked_like_any_page(monkeypatch):
    """A page of plain tags is split, not parsed, with the parser's result; any other page is parsed."""
    def walked(html):
        return [(*e, text) for e, text in P._elements(html, {})]

    sure = ('<!DOCTYPE html><head><title>a &amp; b</title><script>x = "</p>"</script></head><table class="t"><tr><td>1<td colspan="2">2</tr><!-- no -->'
            '<TR><th>3</table><div class="a grid-item"><input checked value="x"/><p>one<p>two &copy; </b><div class="rapports"/><ul><li>i<li>j')
    unsure = ["<a href=x>y</a>", "1 < 2<b>c</b>", "<i t='1'>k</i>", "<title><b>t</b></title>", '<a t="&lt;">u</a>', "<p", "a<script>b"]
    want = {}
    with monkeypatch.context() as m:
        m.setattr(P, "_walk_sure", lambda html, known: None)
        want = {html: walked(html) for html in (sure, *unsure)}
    assert all(walked(html) == rows and P._walk_sure(html, {}) is None for html, rows in want.items() if html != sure)
    monkeypatch.setattr(P, "_Walk", None)
    assert walked(sure) == want[sure]
