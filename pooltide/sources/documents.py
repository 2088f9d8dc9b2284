"""JSON documents: coupon history, ledger, rules, bookmaker events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException
from pyspark.sql import types as T
from pyspark.sql.types import StructType

from pooltide import schemas
from pooltide.functions.numeric import rounded
from pooltide.operators.legs import with_exprs


def read_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Every file under ``path`` as (file, corrupt, docs); an absent path gives no rows.

    A file holds one document or an array of them, and is read whole. One that is no JSON of
    that kind is marked ``corrupt`` and has no ``docs``; nothing is left out unseen.
    """
    kind = T.ArrayType(schema)
    try:
        files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType([T.StructField("file", T.StringType()), T.StructField("corrupt", T.BooleanType()), T.StructField("docs", kind)]))
    parsed = files.select(F.col("file_path").alias("file"), F.from_json("value", kind).alias("docs"))
    return parsed.selectExpr("file", "docs IS NULL AS corrupt", "docs")


def document_report(documents: DataFrame) -> DataFrame:
    """Documents and corruption per file of ``read_documents``."""
    return documents.selectExpr("file", "bigint(coalesce(size(docs), 0)) AS n_docs", "corrupt")


def _read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The documents of all readable files under ``path``; ``document_report`` names the others."""
    return read_documents(spark, path, schema).selectExpr("inline(docs)")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Coupon documents (one JSON array per file) as stored."""
    return _read_json(spark, path, schemas.HISTORY_DOC)


def history_coupons(history: DataFrame) -> DataFrame:
    """Coupons of history documents; the type is inferred from the size where it is missing."""
    return history.selectExpr(
        "grid_number", "coalesce(season, concat(year - 1, '-', year)) AS season",
        "coalesce(nullif(grid_type, ''), concat('LF', size(matches))) AS grid_type", "size(matches) AS n_legs",
        "difficulty", "nb_pronostics AS n_tips", "coalesce(resultats, '') AS results",
        "transform_values(rapports, (k, v) -> named_struct('winners', v.gagnants, 'amount', v.montant)) AS payouts",
    ).selectExpr("xxhash64(grid_type, season, grid_number) AS coupon_id", "*")


def history_legs(history: DataFrame) -> DataFrame:
    """Legs of history documents; a missing number counts as 0."""
    rows = history.selectExpr(
        "xxhash64(coalesce(nullif(grid_type, ''), concat('LF', size(matches))), coalesce(season, concat(year - 1, '-', year)), grid_number) AS coupon_id",
        "posexplode(matches) AS (i, m)")
    return rows.selectExpr(
        "coupon_id", "i + 1 AS position", "m.home AS home", "m.away AS away",
        *(f"coalesce(m.{src}, 0.0D) AS {dst}" for src, dst in (
            ("cote_1", "odds_1"), ("cote_n", "odds_n"), ("cote_2", "odds_2"),
            ("pct_1", "share_1"), ("pct_n", "share_n"), ("pct_2", "share_2"))),
        "coalesce(m.prono_cyborg, '') AS tip", "m.score AS score", "nullif(m.resultat, '') AS result")


def write_history(coupons: DataFrame, path: str) -> None:
    """Store coupons as Parquet, one folder per type and season; other types and seasons there stay (runs a job)."""
    coupons.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("grid_type", "season").parquet(path)


def read_stored_history(spark: SparkSession, path: str, grid_type: str | None = None, season: str | None = None) -> DataFrame:
    """Stored coupons, of one type or season if named; only the folders asked for are read."""
    stored = spark.read.parquet(path)
    for column, value in (("grid_type", grid_type), ("season", season)):
        stored = stored.where(F.col(column) == value) if value is not None else stored
    return stored


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger documents under ``path``; the default, empty ledger if none is there or readable. Runs a job."""
    found = _read_json(spark, path, schemas.LEDGER_DOC).where("entries IS NOT NULL OR initial_bankroll IS NOT NULL")
    default = spark.range(1).selectExpr(
        "100.0D AS initial_bankroll", "1.0D AS cost_per_grid", "5 AS grids_per_draw",
        f"CAST(array() AS {schemas.LEDGER_DOC['entries'].dataType.simpleString()}) AS entries")
    return default if found.isEmpty() else found


def ledger_entries(ledger: DataFrame) -> DataFrame:
    """Entries in stored order."""
    return ledger.selectExpr("initial_bankroll", "cost_per_grid", "posexplode(entries) AS (seq, e)").selectExpr(
        "seq", "initial_bankroll", "e.id AS entry_id", "e.grid_number AS grid_number", "e.grid_type AS grid_type",
        "to_date(e.date) AS entry_date", "e.status AS status", "transform(e.grids_submitted, g -> g.resultats) AS bets",
        "e.cost AS cost", "e.total_payout AS total_payout", "e.net AS net", "e.bankroll_after AS bankroll_after",
        "e.actual_results AS results",
        "transform_values(e.rapports, (k, v) -> named_struct('winners', v.gagnants, 'amount', v.montant)) AS payouts",
        "transform(e.grids_submitted, g -> g.n_correct) AS stored_correct")


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Strategy rules in stored order; none when the document is absent or corrupt."""
    return _read_json(spark, path, schemas.RULES_DOC).where("rules IS NOT NULL").selectExpr(
        "posexplode(rules) AS (i, r)").selectExpr("i + 1 AS rule_id", "r.*")


def write_document(df: DataFrame, path: str) -> None:
    """Store a small table (rules, ledger) as JSON (runs a job)."""
    df.write.mode("overwrite").json(path)


def rules_document(rules: DataFrame) -> DataFrame:
    """Mined rules (a handful) as one document, in order."""
    fields = ", ".join(schemas.RULE.fieldNames())
    return rules.agg(F.expr(f"transform(array_sort(collect_list(struct(rule_id, {fields}))), r -> struct({', '.join('r.' + f for f in schemas.RULE.fieldNames())}))").alias("rules"))


def mean_event_odds(events: DataFrame) -> DataFrame:
    """Mean home, draw and away odds over the bookmakers' ``h2h`` markets, to 2 decimals; 0 when none quotes it."""
    markets = with_exprs(events, {
        "h2h": "flatten(transform(bookmakers, b -> filter(b.markets, m -> m.key = 'h2h')))"})

    def mean(name: str) -> str:
        prices = f"filter(transform(h2h, m -> try_element_at(filter(m.outcomes, o -> o.name = {name}), -1).price), x -> x IS NOT NULL)"
        total = f"aggregate({prices}, 0.0D, (a, x) -> a + x)"
        return f"coalesce({rounded(f'try_divide({total}, size({prices}))', 2)}, 0.0D)"

    return with_exprs(markets, {
        "odds_1": mean("home_team"), "odds_n": mean("'Draw'"), "odds_2": mean("away_team"),
    }).drop("h2h", "bookmakers")
