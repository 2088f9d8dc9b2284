"""Readers, table maintenance and joins (A-*, B-*, C-2 ... C-4, E-7, E-8, E-12, F-4 ... F-7, K-2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from pooltide.catalog.base import COUPONS, FIXTURES, HEADERS, LEGS, VIEW, register, rnd, stored
from pooltide.catalog.features import SYMBOLS
from pooltide.catalog.legs import GRID_METRICS
from pooltide.functions import text as X
from pooltide.operators import coupon_stats as S
from pooltide.operators import coupons as C
from pooltide.operators import fuzzy as Z
from pooltide.operators.legs import with_exprs
from pooltide.operators.staging import spread, staged, staging_dir
from pooltide.sources import adapter as A
from pooltide.sources import documents as D
from pooltide.sources import pages as P
from pooltide.sources import season_csv as CSV
from pooltide.sources import tables as T

# ---- season files: one file per league and year, rendered from the fixtures ----

_LINE = """concat_ws(',', league, date_format(date, IF(position % 2 = 0, 'dd/MM/yyyy', 'dd/MM/yy')), home, away,
  CASE result WHEN '1' THEN 'H' WHEN 'N' THEN ' d' ELSE 'A' END, position, coupon_id % 4,
  IF(position % 3 = 0, '', format_string('%.2f', odds_1)), IF(position % 5 = 0, 'n/a', format_string('%.2f', odds_1 + 0.1D)),
  format_string('%.2f', odds_n), format_string('%.2f', odds_2))"""


def dated_fixtures(spark, sf):
    return A.fixtures(spark, sf).join(A.headers(spark, sf).select("coupon_id", "date", "season"), "coupon_id")


def season_files(spark, sf):
    lines = dated_fixtures(spark, sf).selectExpr(
        # 256 neighbouring coupons per file: a file stays small however much data there is.
        "concat(replace(league, 'NATION_', 'L'), '_', shiftright(coupon_id, 8), '_', "
        "date_format(date, 'yy'), lpad((year(date) + 1) % 100, 2, '0'), '.csv') AS file",
        "date", "coupon_id", "position", f"{_LINE} AS line")
    header = "'Div,Date,HomeTeam,AwayTeam,FTR,FTHG,FTAG,B365H,BWH,B365D,B365A'"
    return lines.groupBy("file").agg(F.expr(
        f"concat({header}, '\\n', array_join(transform(array_sort(collect_list(struct(date, coupon_id, position, line))), x -> x.line), '\\n'))").alias("content"))


CSV_SQL = f"""WITH {FIXTURES}, {HEADERS}, dated AS (
  SELECT f.*, h.date, h.season AS sn,
    replace(league, 'NATION_', 'L') AS league_code,
    strftime(h.date, '%y') || lpad(CAST((year(h.date) + 1) % 100 AS VARCHAR), 2, '0') AS code FROM fixtures f JOIN headers h USING (coupon_id)),
parsed AS (
  SELECT league_code, CAST(year(date) AS VARCHAR) || '/' || CAST(year(date) + 1 AS VARCHAR) AS season, date, home, away, result, position AS home_score,
    CAST(coupon_id % 4 AS INTEGER) AS away_score,
    {rnd("list_avg(list_filter([CASE WHEN position % 3 <> 0 THEN odds_1 END, CASE WHEN position % 5 <> 0 THEN round(odds_1 + 0.1e0, 2) END], lambda x: x > 1))", 2)} AS odds_1,
    CASE WHEN odds_n > 1 THEN odds_n END AS odds_n, CASE WHEN odds_2 > 1 THEN odds_2 END AS odds_2 FROM dated)"""


@register("season_csv_rows", f"{CSV_SQL} SELECT * FROM parsed", doubles="odds_1 odds_n odds_2")
def season_csv_rows(spark, sf):
    return CSV.parse_season_files(season_files(spark, sf)).where("valid").select(
        "league_code", "season", "date", "home", "away", "result", "home_score", "away_score", "odds_1", "odds_n", "odds_2")


# The same as files: of four kinds by file, whole; with other columns in another order, in Latin-1; with lines that
# lack a date, have too many fields or no home team; and without a required column.
_KIND = "(shiftright(coupon_id, 14) + int(substr(league, 8))) % 4"
_FTR = "CASE result WHEN '1' THEN 'H' WHEN 'N' THEN 'D' ELSE 'A' END"
_HEADERS = ("Div,Date,HomeTeam,AwayTeam,FTR,FTHG,FTAG", "FTR,Referee,AwayTeam,HomeTeam,Date", "Date,HomeTeam,AwayTeam,FTR", "Div,Date,HomeTeam,AwayTeam,Result")


def landed_season_files(spark, sf):
    """The folder of season files, written once."""
    lines = dated_fixtures(spark, sf).selectExpr(
        "concat(replace(league, 'NATION_', 'L'), '_', shiftright(coupon_id, 14), '_', date_format(date, 'yy'), lpad((year(date) + 1) % 100, 2, '0'), '.csv') AS file",
        f"int({_KIND}) AS kind", "date", "coupon_id", "position", f"""CASE {_KIND}
          WHEN 0 THEN concat_ws(',', league, date_format(date, 'dd/MM/yyyy'), home, away, {_FTR}, position, coupon_id % 4)
          WHEN 1 THEN concat_ws(',', {_FTR}, '"Dupont, J"', concat('"', away, '"'), concat(home, ' é'), date_format(date, 'dd/MM/yy'))
          WHEN 2 THEN concat_ws(',', IF(position = 1, '31/02/x', date_format(date, 'dd/MM/yyyy')), IF(position = 3, ' ', home), away, {_FTR}, IF(position = 2, 'more', NULL))
          ELSE concat_ws(',', league, date_format(date, 'dd/MM/yyyy'), home, away, {_FTR}) END AS line""")
    header = "array({})[kind]".format(", ".join(f"'{h}'" for h in _HEADERS))
    files = lines.groupBy("file", "kind").agg(F.expr("array_join(transform(array_sort(collect_list(struct(date, coupon_id, position, line))), x -> x.line), '\r\n')").alias("body"))
    # A string column is written byte by byte, so it may carry Latin-1.
    content = files.selectExpr("file", f"CAST(encode(concat({header}, '\r\n', body), IF(kind = 1, 'ISO-8859-1', 'UTF-8')) AS STRING) AS content")

    path = f"{staging_dir(spark)}/pooltide/season-files-{uuid.uuid4().hex}"
    _write_parts(content, "file", A.leg_tasks(spark, sf), path)
    return path


def _write_parts(rows, part, tasks, path):
    """One folder and file per row, named by column ``part``.

    A task moves its own files to their place: the driver would move them one by one. The folder is new and
    read only after the whole write succeeded. On a local or mounted disk no checksum file is put beside each
    file: it would be three more files' worth of setting permissions, each a process of its own.
    """
    spread(rows, part, tasks=tasks).write.options(**{
        "mapreduce.fileoutputcommitter.algorithm.version": "2",
        "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}).partitionBy(part).text(path)


LANDED_SQL = f"""WITH {FIXTURES}, {HEADERS}, landed AS (
  SELECT f.coupon_id, position, h.date, away, result, league, CASE kind WHEN 1 THEN home || ' é' ELSE home END AS home, kind,
    replace(league, 'NATION_', 'L') || '_' || (f.coupon_id >> 14) || '_' || strftime(h.date, '%y') || lpad(CAST((year(h.date) + 1) % 100 AS VARCHAR), 2, '0') || '.csv' AS file
  FROM (SELECT *, ((coupon_id >> 14) + CAST(substr(league, 8) AS INTEGER)) % 4 AS kind FROM fixtures) f JOIN headers h USING (coupon_id)
), sound AS (SELECT *, row_number() OVER (PARTITION BY date, home, away ORDER BY file, date, coupon_id, position) AS place FROM landed
  WHERE kind < 2 OR kind = 2 AND position > 3)"""


@register("season_file_rows", f"{LANDED_SQL} SELECT file, date, home, away, result, count(*) AS n FROM sound GROUP BY ALL")
def season_file_rows(spark, sf):
    parsed = CSV.parse_season_files(CSV.read_season_files(spark, landed_season_files(spark, sf)))
    return parsed.where("valid").groupBy("file", "date", "home", "away", "result").agg(F.count(F.lit(1)).alias("n"))


@register("season_file_report", f"""{LANDED_SQL}
SELECT file, count(s.file) FILTER (place = 1) AS inserted, count(s.file) FILTER (place > 1) AS skipped, any_value(errors) AS errors FROM (
  SELECT file, CASE WHEN any_value(kind) = 3 THEN 1 ELSE count(*) FILTER (kind = 2 AND position IN (1, 3)) END AS errors FROM landed GROUP BY file) e
LEFT JOIN sound s USING (file) GROUP BY file""")
def season_file_report(spark, sf):
    rows = CSV.parse_season_files(CSV.read_season_files(spark, landed_season_files(spark, sf)))
    parsed = staged(rows.select("file", "row_no", "valid", *CSV.MATCH_KEY), "season_rows")
    target = parsed.select(*CSV.MATCH_KEY).where("false")
    return CSV.load_report(parsed, T.new_rows(parsed.where("valid"), target, CSV.MATCH_KEY, ["file", "row_no"]))


# ---- documents: written as JSON files, read back ----

def _written_text(rows, name):
    """One file per row of ``content``, under a fresh folder."""
    path = f"{staging_dir(rows.sparkSession)}/pooltide/{name}-{uuid.uuid4().hex}"
    # JSON repeats its names in every record: compressed, it is a fraction of the bytes.
    rows.select("part", "content").write.option("compression", "gzip").partitionBy("part").text(path)
    return path


# Coupons of 4096 neighbouring ids and one year are a file; every fifth file is cut off.
_PART = "concat(shiftright(coupon_id, 12), '_', year(date))"
_CUT = "(shiftright(coupon_id, 12) + year(date)) % 5 = 0"


def history_files(spark, sf):
    match = ("struct(position, home, away, odds_1 AS cote_1, odds_n AS cote_n, odds_2 AS cote_2, share_1 AS pct_1, share_n AS pct_n, share_2 AS pct_2, "
             "tip AS prono_cyborg, CAST(NULL AS STRING) AS score, result AS resultat)")
    coupons = A.fixtures(spark, sf).groupBy("coupon_id").agg(F.expr(f"array_sort(collect_list({match}))").alias("matches")).join(A.headers(spark, sf), "coupon_id")
    docs = coupons.selectExpr(f"{_PART} AS part", f"{_CUT} AS cut", """struct(coupon_id AS grid_number, year(date) + 1 AS year, IF(coupon_id % 2 = 0, season, NULL) AS season,
      IF(coupon_id % 3 = 0, concat('LF', size(matches)), '') AS grid_type, matches, difficulty, n_tips AS nb_pronostics,
      array_join(transform(matches, m -> m.resultat), '') AS resultats, map('top', struct(top_winners AS gagnants, top_amount AS montant)) AS rapports) AS doc""")
    files = docs.groupBy("part", "cut").agg(F.expr("to_json(collect_list(doc))").alias("json"))
    return _written_text(files.selectExpr("part", "IF(cut, substr(json, 1, length(json) - 7), json) AS content"), "history")


HISTORY_SQL = f"""WITH {FIXTURES}, {HEADERS}, sized AS (SELECT coupon_id, count(*) AS n FROM legs GROUP BY coupon_id),
filed AS (SELECT h.*, n, (coupon_id >> 12) || '_' || year(date) AS part, ((coupon_id >> 12) + year(date)) % 5 = 0 AS cut FROM headers h JOIN sized USING (coupon_id))"""


@register("history_document_report", f"{HISTORY_SQL} SELECT part, CASE WHEN any_value(cut) THEN 0 ELSE count(*) END AS n_docs, any_value(cut) AS corrupt FROM filed GROUP BY part")
def history_document_report(spark, sf):
    found = D.document_report(D.read_documents(spark, history_files(spark, sf), D.schemas.HISTORY_DOC))
    return found.selectExpr("regexp_extract(file, 'part=([^/]+)/', 1) AS part", "n_docs", "corrupt")


@register("history_document_coupons", f"""{HISTORY_SQL} SELECT coupon_id AS grid_number, season, 'LF' || n AS grid_type, CAST(n AS INTEGER) AS n_legs, difficulty, n_tips,
  top_winners AS winners, top_amount AS amount FROM filed WHERE NOT cut""", doubles="difficulty amount")
def history_document_coupons(spark, sf):
    return D.history_coupons(D.read_history(spark, history_files(spark, sf))).selectExpr(
        "grid_number", "season", "grid_type", "n_legs", "difficulty", "n_tips", "payouts['top'].winners AS winners", "payouts['top'].amount AS amount")


@register("history_document_legs", f"""{HISTORY_SQL} SELECT coupon_id AS grid_number, position, home, away, odds_1, odds_n, odds_2, share_1, share_n, share_2, tip, result
FROM fixtures JOIN filed USING (coupon_id) WHERE NOT cut""", doubles="odds_1 odds_n odds_2 share_1 share_n share_2")
def history_document_legs(spark, sf):
    history = staged(D.read_history(spark, history_files(spark, sf)), "history_docs")
    numbers = D.history_coupons(history).select("coupon_id", "grid_number")
    return D.history_legs(history).join(numbers, "coupon_id").drop("coupon_id", "score")


@register("stored_history_of_a_type", f"""WITH {COUPONS} SELECT coupon_id, season, CASE WHEN season = '1997-1998' THEN difficulty + 1 ELSE difficulty END AS difficulty, results
FROM coupons WHERE grid_type = 'LF4'""", doubles="difficulty")
def stored_history_of_a_type(spark, sf):
    """All types and seasons are stored, one season is stored anew, one type is read back."""
    path = f"{staging_dir(spark)}/pooltide/stored-history-{uuid.uuid4().hex}"
    coupons = A.coupons(spark, sf).select("coupon_id", "season", "grid_type", "difficulty", "results")
    D.write_history(coupons, path)
    D.write_history(with_exprs(coupons.where("season = '1997-1998'"), {"difficulty": "difficulty + 1"}), path)
    return D.read_stored_history(spark, path, "LF4").select("coupon_id", "season", "difficulty", "results")


# A ledger document per account: its purchases as entries, stakes by number; every sixth document is cut off.
@register("ledger_document_entries", """WITH bought AS (
  SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, CAST(ts AS DATE) AS d FROM events WHERE event_type = 'purchase')
SELECT user_id AS account, CAST(seq - 1 AS INTEGER) AS seq, 'LF7-' || event_id AS entry_id, d AS entry_date, value AS cost, '1N' AS bet, 50e0 + user_id AS initial_bankroll
FROM bought WHERE user_id % 6 <> 0""", doubles="cost initial_bankroll")
def ledger_document_entries(spark, sf):
    entry = ("struct(concat('LF7-', event_id) AS id, event_id AS grid_number, 'LF7' AS grid_type, date_format(ts, 'yyyy-MM-dd') AS date, 'pending' AS status, "
             "array(struct('1N' AS resultats)) AS grids_submitted, value AS cost)")
    bought = A.table(spark, sf, "events").where("event_type = 'purchase'").groupBy("user_id").agg(
        F.expr(f"transform(array_sort(collect_list(struct(ts, event_id, {entry} AS e))), x -> x.e)").alias("entries"))
    docs = bought.selectExpr("user_id", "to_json(struct(50.0D + user_id AS initial_bankroll, 1.0D AS cost_per_grid, 5 AS grids_per_draw, entries)) AS json")
    path = _written_text(docs.selectExpr("user_id AS part", "IF(user_id % 6 = 0, substr(json, 1, length(json) - 3), json) AS content"), "ledgers")
    return D.ledger_entries(D.read_ledger(spark, path)).selectExpr(
        "bigint(initial_bankroll - 50) AS account", "seq", "entry_id", "entry_date", "cost", "bets[0] AS bet", "initial_bankroll")


@register("text_functions", f"""WITH {HEADERS}, coded AS (SELECT coupon_id, date, strftime(date, '%y') AS y, year(date) AS yr FROM headers)
SELECT coupon_id, CAST(yr AS VARCHAR) || '/' || CAST(yr + 1 AS VARCHAR) AS label, date AS long_date, date AS short_date,
  CASE coupon_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'N' ELSE '2' END AS result,
  CASE WHEN coupon_id % 3 = 2 THEN 0e0 ELSE CAST(coupon_id % 100 AS DOUBLE) + 0.5e0 END AS share,
  CASE WHEN coupon_id % 3 = 0 THEN 0e0 ELSE 1e0 + (coupon_id % 500) / 100e0 END AS odds,
  coupon_id * 7 + 1000 AS winners, round((coupon_id * 13 % 100000) / 10e0 + 1000, 1) AS amount, date AS spelled
FROM coded""", doubles="share odds amount")
def text_functions(spark, sf):
    months = ", ".join(f"'{m}'" for m in X.MONTHS)
    h = A.headers(spark, sf).selectExpr(
        "coupon_id", "year(date) AS y", "concat(date_format(date, 'yy'), lpad((year(date) + 1) % 100, 2, '0')) AS code",
        "date_format(date, 'dd/MM/yyyy') AS d4", "date_format(date, 'dd/MM/yy') AS d2",
        "CASE coupon_id % 3 WHEN 0 THEN 'h ' WHEN 1 THEN 'D' ELSE 'A' END AS ftr",
        "CASE coupon_id % 3 WHEN 0 THEN format_string('%.1f%%', coupon_id % 100 + 0.5D) "
        "WHEN 1 THEN replace(format_string('%.1f%%%.2f', coupon_id % 100 + 0.5D, 1 + (coupon_id % 500) / 100.0D), '.', ',') "
        "ELSE format_string('-%.2f', 1 + (coupon_id % 500) / 100.0D) END AS cell",
        "replace(format_number(coupon_id * 7 + 1000, 0), ',', ' ') AS people",
        "concat(translate(format_string('%,.1f', (coupon_id * 13 % 100000) / 10.0D + 1000), ',.', '\\u00a0,'), ' €') AS cash",
        f"concat(day(date), ' ', array({months})[month(date) - 1], ' à 18h55') AS said")
    share, odds = X.odds_cell("cell")
    return h.selectExpr(
        "coupon_id", f"{X.season_label('code')} AS label", f"{X.match_date('d4')} AS long_date", f"{X.match_date('d2')} AS short_date",
        f"{X.result_of('ftr')} AS result", f"{share} AS share", f"{odds} AS odds", f"{X.whole_number('people')} AS winners",
        f"{X.money('cash')} AS amount", f"{X.page_date('CAST(NULL AS STRING)', 'said', 'y')} AS spelled")


# ---- bookmaker events ----

def bookmaker_events(spark, sf):
    def book(key, market, names_prices):
        outcomes = ", ".join(f"named_struct('name', {n}, 'price', {p})" for n, p in names_prices)
        return f"named_struct('key', '{key}', 'markets', array(named_struct('key', '{market}', 'outcomes', array({outcomes}))))"

    books = ", ".join((
        book("one", "h2h", (("home", "odds_1"), ("'Draw'", "odds_n"), ("away", "odds_2"))),
        book("two", "h2h", (("home", "odds_1 + 0.2D"), ("away", "odds_2 + 0.4D"), ("'Other'", "9.0D"))),
        book("three", "totals", (("home", "50.0D"), ("'Draw'", "50.0D"), ("away", "50.0D")))))
    return A.fixtures(spark, sf).selectExpr(
        "coupon_id", "position", "home AS home_team", "away AS away_team",
        f"IF(odds_1 > 0, array({books}), array()) AS bookmakers")


@register("event_odds", f"""WITH {FIXTURES} SELECT coupon_id, position, CASE WHEN odds_1 > 0 THEN {rnd("(odds_1 + (odds_1 + 0.2e0)) / 2", 2)} ELSE 0e0 END AS odds_1,
  odds_n, CASE WHEN odds_2 > 0 THEN {rnd("(odds_2 + (odds_2 + 0.4e0)) / 2", 2)} ELSE 0e0 END AS odds_2 FROM fixtures""", doubles="odds_1 odds_n odds_2")
def event_odds(spark, sf):
    return D.mean_event_odds(bookmaker_events(spark, sf)).select("coupon_id", "position", "odds_1", "odds_n", "odds_2")


# ---- pages: rendered from coupons, then read back ----

# What the operators over pages of a kind read of their elements.
_READ = {
    "distribution_pages": "page_id node tag class text table_no table_class row_no",
    "result_page_html": "page_id node tag class text table_no table_class row_no cell_no in_payouts",
    "upcoming_pages": "page_id node tag class attrs text table_no table_class row_no row_class"}


def elements_of(pages):
    """Elements of rendered pages, stored once for the queries that share them."""
    return lambda spark, sf: stored(spark, sf, pages.__name__, lambda s, d: P.page_elements(pages(s, d), _READ[pages.__name__].split()))


_CELL = """CASE WHEN {s} > 0 AND {o} > 0 THEN format_string('%.1f%%%.2f', {s}, {o}) WHEN {s} > 0 THEN format_string('%.0f%%', {s})
  WHEN {o} > 0 THEN concat('-', replace(format_string('%.2f', {o}), '.', ',')) ELSE '0' END"""


def _packed(spark, sf):
    return spread(A.fixtures(spark, sf), "coupon_id").groupBy("coupon_id").agg(F.expr("""array_sort(collect_list(struct(position, home, away,
      odds_1, odds_n, odds_2, share_1, share_n, share_2, tip, result)))""").alias("legs"), F.expr("int(count(1))").alias("n"))


def distribution_pages(spark, sf):
    cells = "".join(f"'<td class=\"cote-{c}\">', {_CELL.format(s=f'l.share_{k}', o=f'l.odds_{k}')}, '</td>', " for k, c in (("1", "bet"), ("n", "d"), ("2", "d")))
    row = f"""concat('<tr><td class="match">', l.home, ' - ', l.away, '</td>', {cells}'<td class="prono_match">', l.tip, '</td><td class="dev_desktop_td_score">', l.position, '-0</td></tr>')"""
    return _packed(spark, sf).join(A.headers(spark, sf), "coupon_id").selectExpr("coupon_id AS page_id", f"""concat(
      '<html><body><h3>Indice de difficulté</h3><p>', replace(difficulty, '.', ','), '</p><p>Répartition basée sur ', n_tips, ' pronostics</p>',
      '<table class="prono-cyb-des">', array_join(transform(legs, l -> {row}), ''), '</table></body></html>') AS html""")


@register("distribution_page_legs", f"""WITH {FIXTURES} SELECT coupon_id AS page_id, position, home, away, odds_1, odds_2, odds_n, share_1, share_2, share_n, tip, position || '-0' AS score FROM fixtures""",
          doubles="odds_1 odds_n odds_2 share_1 share_n share_2")
def distribution_page_legs(spark, sf):
    return P.distribution_legs(elements_of(distribution_pages)(spark, sf))


@register("distribution_page_headers", f"""WITH {LEGS}, {HEADERS} SELECT coupon_id AS page_id, difficulty, n_tips FROM headers WHERE coupon_id IN (SELECT coupon_id FROM legs)""", doubles="difficulty")
def distribution_page_headers(spark, sf):
    return P.distribution_headers(elements_of(distribution_pages)(spark, sf))


def _in_cents(headers):
    """Amounts that pages show, cut to whole cents."""
    return with_exprs(headers, {c: f"floor({c} * 100) / 100" for c in ("top_amount", "near_amount")})


def result_page_html(spark, sf):
    row = """concat('<tr><td>', l.position, '</td><td>', l.home, ' - ', l.away, '</td><td><span class="res">', l.result, '</span></td></tr>')"""
    people = "replace(format_number({}, 0), ',', ' ')"
    cash = "concat(translate(format_string('%,.2f', {}), ',.', ' ,'), ' €')"
    block = ("concat('<div class=\"rapports\"><h2>Rapports Officiels</h2><table>', "
             "'<tr><td>', n, '</td><td>', {p1}, '</td><td>', {c1}, '</td></tr><tr><td>', n - 1, '</td><td>', {p2}, '</td><td>', {c2}, '</td></tr></table></div>')")
    plain = ("concat('<table><tr><th>Rapport des gagnants</th></tr>', "
             "'<tr><td>', n, ' sur ', n, '</td><td>', {p1}, '</td><td>', {c1}, '</td></tr><tr><td>', n - 1, ' sur ', n, '</td><td>', {p2}, '</td><td>', {c2}, '</td></tr></table>')")
    args = {"p1": people.format("top_winners"), "c1": cash.format("top_amount"), "p2": people.format("near_winners"), "c2": cash.format("near_amount")}
    return _packed(spark, sf).join(_in_cents(A.headers(spark, sf)), "coupon_id").selectExpr("coupon_id AS page_id", "n", f"""concat(
      '<html><body><table class="hist">', array_join(transform(legs, l -> {row}), ''), '</table>',
      IF(n % 2 = 0, {block.format(**args)}, {plain.format(**args)}),
      '<table class="rapports"><tr><td>Somme</td><td>', n, '</td></tr></table></body></html>') AS html""")


@register("result_page_results", f"WITH {COUPONS}, {SYMBOLS} SELECT coupon_id AS page_id, results, profile FROM coupons JOIN (SELECT coupon_id, profile FROM stats) USING (coupon_id)")
def result_page_results(spark, sf):
    return P.result_pages(elements_of(result_page_html)(spark, sf))


@register("result_page_payouts", f"""WITH {COUPONS}
SELECT coupon_id AS page_id, n_legs || '_sur_' || n_legs AS rank_key, top_winners AS winners, floor(top_amount * 100) / 100 AS amount FROM coupons
UNION ALL SELECT coupon_id, (n_legs - 1) || '_sur_' || n_legs, near_winners, floor(near_amount * 100) / 100 FROM coupons""", doubles="amount")
def result_page_payouts(spark, sf):
    pages = result_page_html(spark, sf)
    return P.payout_rows(elements_of(result_page_html)(spark, sf), pages.selectExpr("page_id", "n AS n_legs"))


@register("result_page_facts", f"WITH {COUPONS} SELECT coupon_id AS page_id, 'somme' AS fact, CAST(n_legs AS VARCHAR) AS value FROM coupons")
def result_page_facts(spark, sf):
    return P.combination_facts(elements_of(result_page_html)(spark, sf))


@register("page_results_joined", f"WITH {FIXTURES} SELECT coupon_id AS page_id, position, home, away, result FROM fixtures")
def page_results_joined(spark, sf):
    legs = P.distribution_legs(elements_of(distribution_pages)(spark, sf))
    results = P.result_pages(elements_of(result_page_html)(spark, sf))
    return P.assembled_legs(legs, results).select("page_id", "position", "home", "away", "result")


def upcoming_pages(spark, sf):
    row = """concat('<tr><td>', l.position, '</td><td class="equipe home">', l.home, '</td><td class="sep">-</td><td class="equipe ext">', l.away, '</td></tr>')"""
    title = "CASE n % 3 WHEN 0 THEN concat('LF 15 n&deg;', coupon_id) WHEN 1 THEN 'LF 7 - LF 12' ELSE concat('LF 8 n°', coupon_id) END"
    return _packed(spark, sf).join(A.headers(spark, sf), "coupon_id").selectExpr("coupon_id AS page_id", f"""concat(
      '<div><table class="grilles-lf"><tbody><tr><th colspan="4">', {title}, '</th></tr><tr class="valid"><th colspan="4">Avant le <span data-date-utc="',
      date, ' 16:55:00">Jeudi</span></th></tr>', array_join(transform(legs, l -> {row}), ''), '</tbody></table></div>') AS html""")


@register("upcoming_page_coupons", f"""WITH {FIXTURES}, {HEADERS}, packed AS (SELECT coupon_id, count(*) AS n FROM fixtures GROUP BY coupon_id),
kinds AS (SELECT * FROM (VALUES (0, 'LF15', 15, true), (1, 'LF7', 7, false), (1, 'LF12', 12, false), (2, 'LF8', 8, true)) v(k, grid_type, size, numbered)),
named AS (SELECT p.coupon_id, grid_type, size, CASE WHEN numbered THEN p.coupon_id END AS grid_number FROM packed p JOIN kinds ON n % 3 = k)
SELECT coupon_id AS page_id, grid_type, any_value(grid_number) AS grid_number, any_value(date) AS date,
  string_agg(home || '/' || away, ';' ORDER BY position) AS legs
FROM named JOIN headers USING (coupon_id) JOIN fixtures USING (coupon_id) WHERE position <= size GROUP BY coupon_id, grid_type""")
def upcoming_page_coupons(spark, sf):
    return P.upcoming_coupons(elements_of(upcoming_pages)(spark, sf), 2000).selectExpr(
        "page_id", "grid_type", "grid_number", "date", "array_join(transform(legs, l -> concat(l.home, '/', l.away)), ';') AS legs")


@register("upcoming_not_past", f"""WITH {FIXTURES}, {HEADERS} SELECT DISTINCT coupon_id AS page_id FROM headers JOIN fixtures USING (coupon_id) WHERE date >= DATE '2000-01-01'""")
def upcoming_not_past(spark, sf):
    found = P.upcoming_coupons(elements_of(upcoming_pages)(spark, sf), 2000)
    return found.where(T.not_past("date", "DATE'2000-01-01'")).select("page_id").distinct()


def profile_pages(spark, sf):
    from pooltide.operators.generate import profile_frequency
    rows = profile_frequency(A.coupons(spark, sf)).selectExpr(
        "int(substring(grid_type, 3)) AS page_id", "struct(n, profile, split(profile, '-') AS k) AS r")
    row = "concat('<tr><td>', r.k[0], '</td><td>', r.k[1], '</td><td>', r.k[2], '</td><td>', r.n, ' fois</td></tr>')"
    # A type has (n+1)(n+2)/2 profiles.
    return rows.groupBy("page_id").agg(F.expr(f"array_join(transform(array_sort(collect_list(r)), r -> {row}), '')").alias("rows")).selectExpr(
        "bigint(page_id) AS page_id", """concat('<table class="stat_1n2"><tr><th colspan="4">Combinaisons 1N2</th></tr><tr><th>1</th></tr>', rows,
        '</table><table class="stat_1n2 autre"><tr><th colspan="4">Tirages par saison</th></tr><tr><td>3</td><td>2</td><td>2</td><td>', page_id, ' fois</td></tr></table>') AS html""")


@register("profile_page_counts", f"WITH {COUPONS}, {SYMBOLS} SELECT CAST(n_legs AS BIGINT) AS page_id, profile, count(*) AS n FROM coupons JOIN (SELECT coupon_id, profile FROM stats) USING (coupon_id) GROUP BY ALL")
def profile_page_counts(spark, sf):
    return P.profile_counts(P.page_elements(profile_pages(spark, sf)))


def official_pages(spark, sf):
    mark = "CASE l.result WHEN '1' THEN 'one' WHEN 'N' THEN 'n' ELSE 'two' END"
    item = f"""concat('<div class="grid-item"><span class="grid-item-team">', l.home, '</span><span class="grid-item-team">', l.away, '</span>',
      '<label class="grid-item-label"><input type="radio" formcontrolname="x"/></label><label class="grid-item-label"><input type="radio" formcontrolname="', {mark}, '"', IF(n % 2 = 0, ' checked', ''), '/></label></div>')"""
    return _packed(spark, sf).join(_in_cents(A.headers(spark, sf)), "coupon_id").selectExpr("coupon_id AS page_id", f"""concat(
      '<h1 class="lotofoot-grid__title">Résultat N°', coupon_id, '</h1><span class="lotofoot-grid__date">fin de valid. ', date_format(date, 'dd/MM'), ' 17h55</span>',
      array_join(transform(legs, l -> {item}), ''),
      IF(n % 2 = 0, concat('<table class="lotosport-ranking-table"><tr><th>Gagnants</th></tr><tr><td>', replace(format_number(near_winners * 1000, 0), ',', ' '),
        ' gagnants</td><td>', replace(format_string('%.2f', top_amount), '.', ','), ' €</td></tr><tr><td>1</td><td>2 €</td></tr></table>'), '')) AS html""")


@register("official_page_coupons", f"""WITH {FIXTURES}, {HEADERS}, packed AS (
  SELECT coupon_id, count(*) AS n, string_agg(home || '/' || away || CASE WHEN c % 2 = 0 THEN '/' || result ELSE '' END, ';' ORDER BY position) AS legs
  FROM (SELECT *, count(*) OVER (PARTITION BY coupon_id) AS c FROM fixtures) GROUP BY coupon_id)
SELECT coupon_id AS page_id, coupon_id AS grid_number, make_date(2000, month(date), day(date)) AS date, legs,
  CASE WHEN n % 2 = 0 THEN near_winners * 1000 END AS top_winners, CASE WHEN n % 2 = 0 THEN floor(top_amount * 100) / 100 END AS top_amount, n % 2 <> 0 AS upcoming
FROM packed JOIN headers USING (coupon_id)""", doubles="top_amount")
def official_page_coupons(spark, sf):
    return P.official_coupons(P.page_elements(official_pages(spark, sf)), 2000).selectExpr(
        "page_id", "grid_number", "date",
        "array_join(transform(legs, l -> concat_ws('/', l.home, l.away, l.result)), ';') AS legs",
        "top_winners", "top_amount", f"{T.is_upcoming()} AS upcoming")


@register("page_elements", """SELECT page_id, len(regexp_extract_all(html, '<h1[ >]')) AS n_h1, len(regexp_extract_all(html, '<p>')) AS n_p,
  len(regexp_extract_all(html, '<div[ >]')) AS n_div, len(regexp_extract_all(html, '<nav>')) AS n_nav FROM pages""")
def page_elements(spark, sf):
    return P.page_elements(A.table(spark, sf, "pages")).groupBy("page_id").agg(*(
        F.expr(f"count_if(tag = '{t}')").alias(f"n_{t}") for t in ("h1", "p", "div", "nav")))


# Text of a paragraph: up to where it or the article ends, or the next paragraph begins; texts between tags without outer blanks.
def _plain(html: str) -> str:
    pieces = f"list_transform(regexp_split_to_array({html}, '<[^>]*>'), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)))"
    text = f"array_to_string({pieces}, '')"
    for name, sign in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{sign}')"
    return text


_TEXTS = {"a": ("<a [^>]*>", "</a>"), "li": ("<li>", "</li>"), "h1": ("<h1>", "</h1>"), "title": ("<title>", "</title>"), "footer": ("<footer>", "</footer>")}


@register("page_element_texts", f"""WITH texts AS (
  {" UNION ALL ".join(f"SELECT page_id, '{tag}' AS tag, unnest(regexp_extract_all(html, '(?s){opens}(.*?){ends}', 1)) AS html, generate_subscripts(regexp_extract_all(html, '(?s){opens}(.*?){ends}', 1), 1) AS i FROM pages" for tag, (opens, ends) in _TEXTS.items())}
  UNION ALL SELECT page_id, 'p', split_part(split_part(unnest(string_split(html, '<p>')[2:]), '</p>', 1), '</article>', 1), generate_subscripts(string_split(html, '<p>')[2:], 1) FROM pages
  UNION ALL SELECT page_id, 'article', unnest(regexp_extract_all(html, '(?s)<article>(.*?)</article>', 1)), 1 FROM pages
)
SELECT page_id, tag, count(*) AS n, md5(string_agg({_plain("html")}, chr(10) ORDER BY i)) AS texts_md5 FROM texts GROUP BY page_id, tag""")
def page_element_texts(spark, sf):
    kept = ", ".join(f"'{t}'" for t in (*_TEXTS, "p", "article"))
    return P.page_elements(A.table(spark, sf, "pages")).where(f"tag IN ({kept})").groupBy("page_id", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.expr("md5(array_join(transform(array_sort(collect_list(struct(node, text))), x -> x.text), '\n'))").alias("texts_md5"))


# Nested sets: links are inside exactly one list item, one list and one navigation.
@register("page_nesting", """SELECT page_id, len(regexp_extract_all(html, '<a [^>]*>')) AS links, len(regexp_extract_all(html, '<li>')) AS items,
  len(regexp_extract_all(html, '<a [^>]*>')) AS links_in_items, len(regexp_extract_all(html, '<a [^>]*>')) AS links_in_lists,
  len(regexp_extract_all(html, '<a [^>]*>')) AS links_in_navigations FROM pages""")
def page_nesting(spark, sf):
    elements = P.page_elements(A.table(spark, sf, "pages")).groupBy("page_id").agg(
        F.expr("collect_list(node) FILTER (WHERE tag = 'a')").alias("links"),
        *(F.expr(f"collect_list(struct(node, last)) FILTER (WHERE tag = '{t}')").alias(t) for t in ("li", "ul", "nav")))
    inside = "bigint(size(filter(links, l -> exists({0}, o -> l > o.node AND l <= o.last)))) AS links_in_{1}"
    return elements.selectExpr("page_id", "bigint(size(links)) AS links", "bigint(size(li)) AS items", *(
        inside.format(t, name) for t, name in (("li", "items"), ("ul", "lists"), ("nav", "navigations"))))


# ---- table maintenance ----

MATCH_ORDER = ["coupon_id", "position"]


@register("matches_inserted", f"""WITH {FIXTURES}, {HEADERS}, dated AS (SELECT f.*, h.date FROM fixtures f JOIN headers h USING (coupon_id)),
incoming AS (SELECT * FROM dated WHERE date >= DATE '1997-01-01'), existing AS (SELECT * FROM dated WHERE date < DATE '1998-01-01')
SELECT date, home, away, coupon_id, position, result FROM (
  SELECT *, row_number() OVER (PARTITION BY date, home, away ORDER BY coupon_id, position) AS place FROM incoming) i
WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.date = i.date AND e.home = i.home AND e.away = i.away)""")
def matches_inserted(spark, sf):
    dated = dated_fixtures(spark, sf).select("date", "home", "away", "coupon_id", "position", "result")
    return T.new_rows(dated.where("date >= DATE'1997-01-01'"), dated.where("date < DATE'1998-01-01'"), CSV.MATCH_KEY, MATCH_ORDER)


@register("load_report", f"""{CSV_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY date, home, away ORDER BY date) AS place FROM parsed)
SELECT count(*) FILTER (place = 1) AS inserted, count(*) FILTER (place > 1) AS skipped, CAST(0 AS BIGINT) AS errors FROM placed""")
def load_report(spark, sf):
    parsed = staged(CSV.parse_season_files(season_files(spark, sf)).select("file", "row_no", "valid", *CSV.MATCH_KEY), "season_csv_rows")
    target = parsed.select(*CSV.MATCH_KEY).where("false")
    report = CSV.load_report(parsed, T.new_rows(parsed.where("valid"), target, CSV.MATCH_KEY, ["file", "row_no"]))
    return report.agg(*(F.sum(c).alias(c) for c in ("inserted", "skipped", "errors")))


@register("team_dimension", f"""WITH {FIXTURES}, seen AS (SELECT home AS name, country, coupon_id, position, 0 AS side FROM fixtures UNION ALL SELECT away, country, coupon_id, position, 1 FROM fixtures)
SELECT name, country FROM seen QUALIFY row_number() OVER (PARTITION BY name ORDER BY coupon_id, position, side) = 1""")
def team_dimension(spark, sf):
    return T.team_dimension(A.fixtures(spark, sf), MATCH_ORDER).select("name", "country")


@register("competition_dimension", f"""WITH {FIXTURES}, {HEADERS} SELECT DISTINCT league AS name, season, country FROM fixtures JOIN headers USING (coupon_id)""")
def competition_dimension(spark, sf):
    return T.competition_dimension(dated_fixtures(spark, sf), MATCH_ORDER).select("name", "season", "country")


HISTORY_SPLIT = """existing AS (SELECT season, coupon_id AS number, difficulty, date FROM headers WHERE date < DATE '1999-01-01'),
incoming AS (SELECT season, coupon_id AS number, difficulty + 1 AS difficulty, date FROM headers WHERE date >= DATE '1997-01-01')"""


@register("history_merge", f"""WITH {HEADERS}, {HISTORY_SPLIT}
SELECT * FROM existing UNION ALL SELECT * FROM incoming i WHERE NOT EXISTS (SELECT 1 FROM existing e WHERE e.season = i.season AND e.number = i.number)""", doubles="difficulty")
def history_merge(spark, sf):
    h = A.headers(spark, sf).selectExpr("season", "coupon_id AS number", "difficulty", "date")
    incoming = with_exprs(h.where("date >= DATE'1997-01-01'"), {"difficulty": "difficulty + 1"})
    return T.merge_first_wins(h.where("date < DATE'1999-01-01'"), incoming, ["season", "number"], ["number"])


@register("stats_upsert", f"""WITH {COUPONS}, {SYMBOLS} SELECT coupon_id, profile, CASE WHEN date >= DATE '1997-01-01' THEN longest_run ELSE -1 END AS longest_run FROM stats JOIN coupons USING (coupon_id)""")
def stats_upsert(spark, sf):
    coupons = A.coupons(spark, sf).select("coupon_id", "date", "results")
    stats = S.string_stats(coupons)
    old = with_exprs(stats.where("date < DATE'1999-01-01'"), {"longest_run": "-1"}).select("coupon_id", "profile", "longest_run")
    return T.upsert(old, stats.where("date >= DATE'1997-01-01'").select("coupon_id", "profile", "longest_run"), ["coupon_id"])


def _assembled(spark, sf):
    open_legs = A.table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS coupon_id", f"struct(row_number() OVER (PARTITION BY l_orderkey ORDER BY {A.LEG_ORDER}) AS position, "
        "IF(l_linestatus = 'O', NULL, CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN 'N' ELSE '2' END) AS result) AS leg")
    return open_legs.groupBy("coupon_id").agg(F.expr("array_sort(collect_list(leg))").alias("legs"))


@register("coupon_inserts", f"""WITH {LEGS.replace("l_partkey AS part_id", "l_linestatus AS ls, l_partkey AS part_id")}
SELECT coupon_id, string_agg(CASE WHEN ls = 'O' THEN '?' ELSE result END, '' ORDER BY position) AS results FROM legs
WHERE coupon_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01') GROUP BY coupon_id""")
def coupon_inserts(spark, sf):
    known = A.headers(spark, sf).where("date < DATE'1998-01-01'").select("coupon_id")
    return T.coupon_rows(_assembled(spark, sf).join(known, "coupon_id", "left_anti"))


@register("coupon_leg_rows", f"""WITH {LEGS.replace("l_partkey AS part_id", "l_linestatus AS ls, l_partkey AS part_id")}
SELECT coupon_id, position, CASE WHEN ls <> 'O' THEN result END AS result FROM legs""")
def coupon_leg_rows(spark, sf):
    return T.coupon_leg_rows(_assembled(spark, sf))


@register("season_cut", f"""WITH {COUPONS}, lagged AS (
  SELECT *, row_number() OVER w AS seq, results = lag(results, 1) OVER w AND results = lag(results, 2) OVER w AS repeats
  FROM coupons WINDOW w AS (PARTITION BY grid_type, season ORDER BY coupon_id)),
ends AS (SELECT grid_type, season, min(seq) AS stop FROM lagged WHERE repeats GROUP BY ALL)
SELECT grid_type, season, coupon_id AS number, results FROM lagged LEFT JOIN ends USING (grid_type, season) WHERE stop IS NULL OR seq < stop""")
def season_cut(spark, sf):
    return T.season_cut(A.coupons(spark, sf).selectExpr("grid_type", "season", "coupon_id AS number", "results", "n_legs")).drop("n_legs")


@register("collection_summary", f"""WITH {FIXTURES}, {HEADERS}
SELECT 'period' AS table_name, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM headers
UNION ALL SELECT 'legs', count(*), NULL, NULL FROM lineitem
UNION ALL SELECT 'teams', count(*), NULL, NULL FROM (SELECT home FROM fixtures UNION SELECT away FROM fixtures)
UNION ALL SELECT 'competitions', count(*), NULL, NULL FROM (SELECT DISTINCT league, season FROM fixtures JOIN headers USING (coupon_id))
UNION ALL SELECT 'odds', count(*), NULL, NULL FROM lineitem WHERE l_partkey % 23 <> 0
UNION ALL SELECT 'coupons', count(*), NULL, NULL FROM orders""")
def collection_summary(spark, sf):
    dated = dated_fixtures(spark, sf)
    legs = A.legs(spark, sf)
    return T.collection_summary({
        "legs": legs, "teams": T.team_dimension(dated, MATCH_ORDER), "competitions": T.competition_dimension(dated, MATCH_ORDER),
        "odds": legs.where("odds_1 > 0"), "coupons": A.headers(spark, sf)}, A.headers(spark, sf))


# ---- joins ----

@register("coupon_legs_with_odds", f"""WITH {LEGS}, {HEADERS}
SELECT coupon_id, string_agg(CASE WHEN odds_1 > 0 THEN printf('%d=%.2f', position, odds_1) ELSE position || '=' END, ' ' ORDER BY position) AS odds
FROM legs GROUP BY coupon_id""")
def coupon_legs_with_odds(spark, sf):
    legs = A.legs(spark, sf)
    odds = legs.where("odds_1 > 0").select("coupon_id", "position", "odds_1")
    joined = legs.select("coupon_id", "position").join(odds, ["coupon_id", "position"], "left")
    return joined.groupBy("coupon_id").agg(F.expr(
        "array_join(transform(array_sort(collect_list(struct(position, odds_1))), x -> concat(x.position, '=', IF(x.odds_1 IS NULL, '', format_string('%.2f', x.odds_1)))), ' ')").alias("odds"))


@register("normalized_teams", f"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(p_name || ' FC (' || p_type || ')')),
  '\\b(fc|sc|ac|cf|rc|as|us|ss|sg|athletic|athletico|sporting)\\b', '', 'g'), '[^\\w\\s]', '', 'g'), '\\s+', ' ', 'g')) AS team FROM part""")
def normalized_teams(spark, sf):
    raw = A.table(spark, sf, "part").selectExpr("p_partkey", "concat(p_name, ' FC (', p_type, ')') AS n")
    return raw.selectExpr("p_partkey", f"{X.normalized_team('n')} AS team")


# Team names with a bounded vocabulary: products at home, nations away.
def _leagued(spark, sf):
    return A.fixtures(spark, sf).selectExpr("coupon_id", "position", "home", "league AS away", "odds_1", "odds_n", "odds_2")


def event_feed(spark, sf):
    """Priced fixtures under other spellings; the first of equal names has the lowest number."""
    priced = _leagued(spark, sf).where("odds_1 > 0").selectExpr("coupon_id * 32 + position AS event_no", "home", "away", "odds_1", "odds_n", "odds_2")
    # Spelled once a pair of names; two pairs may get one spelling, so the first is taken again.
    spelled = T.first_per_key(priced, ["home", "away"], ["event_no"]).selectExpr(
        "event_no", "concat(split(home, ' ')[1], ' ', split(home, ' ')[0], ' FC') AS home",
        "concat('The ', replace(away, 'NATION_', 'nation ')) AS away", "odds_1", "odds_n", "odds_2")
    return T.first_per_key(spelled, ["home", "away"], ["event_no"])


@register("similar_team_names")
def similar_team_names(spark, sf):
    return Z.similar_names(_leagued(spark, sf).selectExpr("lower(home) AS name"), event_feed(spark, sf).selectExpr(f"{X.normalized_team('home')} AS name"))


@register("odds_filled_from_events")
def odds_filled_from_events(spark, sf):
    return Z.fill_missing_odds(_leagued(spark, sf), event_feed(spark, sf))


# With the feed spelled like the fixtures, the best event is the first of the same two names. Home names of
# every seventh place are in an alphabet of their own, which no event shares: the away name alone gives a mean of 0.5.
_ALPHABET = "translate({}, 'abcdefghijklmnopqrstuvwxyz ', 'αβγδεζηθικλμνξοπρστυφχψωϊϋό')"
_HOME = f"CASE WHEN position % 7 = 0 THEN {_ALPHABET.format('home')} ELSE home END AS home"


@register("odds_filled_exact", f"""WITH {FIXTURES}, spelled AS (SELECT coupon_id, position, odds_1, odds_n, odds_2, league AS away, {_HOME} FROM fixtures),
priced AS (
  SELECT home, away, odds_1, odds_n, odds_2 FROM spelled WHERE odds_1 > 0 AND position % 7 <> 0
  QUALIFY row_number() OVER (PARTITION BY home, away ORDER BY coupon_id, position) = 1)
SELECT f.coupon_id, f.position, CASE WHEN f.odds_1 > 0 OR p.home IS NULL THEN f.odds_1 ELSE p.odds_1 END AS odds_1,
  CASE WHEN f.odds_1 > 0 OR p.home IS NULL THEN f.odds_n ELSE p.odds_n END AS odds_n,
  CASE WHEN f.odds_1 > 0 OR p.home IS NULL THEN f.odds_2 ELSE p.odds_2 END AS odds_2,
  CASE WHEN f.odds_1 > 0 OR p.home IS NULL THEN 'own' ELSE 'events' END AS odds_source
FROM spelled f LEFT JOIN priced p USING (home, away)""", doubles="odds_1 odds_n odds_2")
def odds_filled_exact(spark, sf):
    legs = _leagued(spark, sf).selectExpr("coupon_id", "position", _HOME, "away", "odds_1", "odds_n", "odds_2")
    feed = T.first_per_key(legs.where("odds_1 > 0 AND position % 7 <> 0").selectExpr(
        "coupon_id * 32 + position AS event_no", "home", "away", "odds_1", "odds_n", "odds_2"), ["home", "away"], ["event_no"])
    return Z.fill_missing_odds(legs, feed).select("coupon_id", "position", "odds_1", "odds_n", "odds_2", "odds_source")


# Every two teams have an event; its odds follow from their first fixture.
_FEED = ("120 + {n} % 300", "280 + {n} % 90", "150 + {n} % 410")


@register("assembled_metrics", f"""WITH {FIXTURES}, {HEADERS}, feed AS (
  SELECT home, away, {", ".join(f"({x.format(n='(min(coupon_id * 32 + position))')}) / 100e0 AS e{k}" for k, x in zip("1n2", _FEED))} FROM fixtures GROUP BY home, away
), filled AS (
  SELECT f.* REPLACE ({", ".join(f"CASE WHEN odds_1 > 0 THEN odds_{k} ELSE e{k} END AS odds_{k}" for k in "1n2")}), odds_1 <= 0 AS gap
  FROM fixtures f JOIN feed USING (home, away)
), {VIEW.replace("FROM legs", "FROM filled")}, {GRID_METRICS}
SELECT coupon_id AS page_id, h.difficulty, h.n_tips, m.* EXCLUDE (coupon_id), gaps FROM grid_metrics m JOIN headers h USING (coupon_id)
JOIN (SELECT coupon_id, count(*) FILTER (gap) AS gaps FROM filled GROUP BY coupon_id) USING (coupon_id)""",
          doubles="difficulty somme_cotes_fav moyenne_cote_fav mediane_cote_fav ecart_type_cotes std_cote_fav inv_spread_sum accord_cotes_joueurs coeff_variation_fav")
def assembled_metrics(spark, sf):
    """Page to metrics in one chain: cells, legs, results, odds for the gaps, coupon metrics, header."""
    elements = elements_of(distribution_pages)(spark, sf)
    legs = P.assembled_legs(P.distribution_legs(elements), P.result_pages(elements_of(result_page_html)(spark, sf)))
    feed = A.fixtures(spark, sf).groupBy("home", "away").agg(F.expr("min(coupon_id * 32 + position)").alias("event_no")).selectExpr(
        "event_no", "home", "away", *(f"({x.format(n='event_no')}) / 100.0D AS odds_{k}" for k, x in zip("1n2", _FEED)))
    return P.assembled_coupons(legs, feed, P.distribution_headers(elements))
