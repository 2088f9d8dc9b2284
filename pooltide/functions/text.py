"""Text to values: season codes, dates, results, odds cells, money, team names.

Expressions are Spark SQL text over a column or expression name.
"""

from __future__ import annotations

# Full-time result codes.
FTR_CODES = {"H": "1", "D": "N", "A": "2"}

# Bookmaker column stems averaged into one odds.
BOOKMAKERS = ("B365", "BW", "IW", "PS", "WH", "VC")

# League code, competition and country.
LEAGUES = (
    ("F1", "Ligue 1", "France"), ("F2", "Ligue 2", "France"),
    ("E0", "Premier League", "Angleterre"), ("E1", "Championship", "Angleterre"),
    ("SP1", "La Liga", "Espagne"), ("SP2", "Segunda División", "Espagne"),
    ("I1", "Serie A", "Italie"), ("I2", "Serie B", "Italie"),
    ("D1", "Bundesliga", "Allemagne"), ("D2", "2. Bundesliga", "Allemagne"),
    ("N1", "Eredivisie", "Pays-Bas"), ("P1", "Primeira Liga", "Portugal"),
    ("B1", "Jupiler League", "Belgique"), ("T1", "Süper Lig", "Turquie"),
)

# Month names in page dates.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août",
          "septembre", "octobre", "novembre", "décembre")

# Whole words dropped from team names before comparing them.
TEAM_WORDS = ("fc", "sc", "ac", "cf", "rc", "as", "us", "ss", "sg", "athletic", "athletico", "sporting")


def season_code(filename: str) -> str:
    """Part after the last underscore of a file name, empty without one."""
    base = f"regexp_replace({filename}, '\\\\.[^.]*$', '')"
    return f"IF(instr({base}, '_') > 0, substring_index({base}, '_', -1), '')"


def league_code(filename: str) -> str:
    """Part before the first underscore of a file name."""
    return f"substring_index(regexp_replace({filename}, '\\\\.[^.]*$', ''), '_', 1)"


def season_label(code: str) -> str:
    """``2324`` to ``2023/2024``; years from 90 on belong to the last century; other lengths pass through."""
    year = lambda part: f"(int({part}) + IF(int({part}) < 90, 2000, 1900))"
    first, second = f"substr({code}, 1, 2)", f"substr({code}, 3, 2)"
    return f"CASE WHEN {code} RLIKE '^[0-9]{{4}}$' THEN concat({year(first)}, '/', {year(second)}) ELSE {code} END"


def match_date(text: str) -> str:
    """``dd/MM/yyyy``, else ``dd/MM/yy`` with years from 69 on in the last century, else null."""
    t = f"trim({text})"
    day, month, year = (f"split({t}, '/')[{k}]" for k in range(3))
    digits = f"regexp_extract({year}, '^[0-9]+', 0)"
    full = f"(int({digits}) + CASE WHEN length({digits}) = 4 THEN 0 WHEN int({digits}) >= 69 THEN 1900 ELSE 2000 END)"
    return (f"CASE WHEN {t} RLIKE '^\\\\d{{1,2}}/\\\\d{{1,2}}/(\\\\d{{4}}|\\\\d{{2}})$' "
            f"THEN try_to_date(concat_ws('-', lpad({full}, 4, '0'), lpad({month}, 2, '0'), lpad({day}, 2, '0')), 'yyyy-MM-dd') END")


def result_of(ftr: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FTR_CODES.items())
    return f"CASE upper(trim({ftr})) {cases} END"


def mean_odds(columns: list[str]) -> str:
    """Mean of the columns that hold a number above 1, to 2 decimals; null when none does."""
    values = f"filter(transform(array({', '.join(columns)}), x -> try_cast(x AS DOUBLE)), x -> x > 1.0D)"
    mean = f"aggregate({values}, 0.0D, (a, x) -> a + x) / size({values})"
    return f"CASE WHEN size({values}) > 0 THEN CAST(floor(({mean}) * 100 + (0.5D + 1e-7D)) AS DOUBLE) / 100 END"


def _number(text: str) -> str:
    return f"try_cast(replace({text}, ',', '.') AS DOUBLE)"


def odds_cell(text: str) -> tuple[str, str]:
    """(share, odds) of a cell such as ``45%1,52``, ``58%``, ``-1,77`` or ``2.25``; 0 where absent."""
    t = f"trim({text})"
    both = f"{t} RLIKE '^[0-9.,]+\\\\s*%\\\\s*[0-9.,]'"
    alone = f"{t} RLIKE '^[0-9.,]+\\\\s*%\\\\s*$'"
    shared = f"{t} RLIKE '^[0-9.,]+\\\\s*%\\\\s*([0-9.,]|$)'"
    dash = f"{t} RLIKE '^-\\\\s*[0-9.,]'"
    before = _number(f"substring_index({t}, '%', 1)")
    after = _number(f"regexp_extract({t}, '%\\\\s*([0-9.,]+)', 1)")
    dashed = _number(f"regexp_extract({t}, '^-\\\\s*([0-9.,]+)', 1)")
    # Without the sign the patterns that want it are not tried.
    share = f"coalesce(CASE WHEN instr({t}, '%') > 0 AND {shared} THEN {before} END, 0.0D)"
    odds = (f"coalesce(CASE WHEN instr({t}, '%') > 0 AND {both} THEN {after} WHEN instr({t}, '%') > 0 AND {alone} THEN 0.0D "
            f"WHEN startswith({t}, '-') AND {dash} THEN {dashed} ELSE {_number(t)} END, 0.0D)")
    return share, odds


def whole_number(text: str) -> str:
    """Digits of a text with plain or non-breaking spaces between them; null otherwise."""
    return f"try_cast(regexp_replace({text}, '[ \\u00a0]', '') AS BIGINT)"


def money(text: str) -> str:
    """Amount with a decimal comma or point somewhere in the text; 0 when there is none."""
    found = f"regexp_extract({text}, '([0-9\\\\s\\u00a0]+[.,][0-9]+)', 1)"
    return f"coalesce(try_cast(replace(regexp_replace({found}, '[\\\\s\\u00a0]', ''), ',', '.') AS DOUBLE), 0.0D)"


def day_month(text: str, year: str) -> str:
    """``dd/MM`` inside a text, in a given year."""
    day, month = (f"regexp_extract({text}, '([0-9][0-9])/([0-9][0-9])', {k})" for k in (1, 2))
    return f"try_to_date(concat({year}, '-', {month}, '-', {day}), 'yyyy-MM-dd')"


def page_date(utc: str, text: str, year: str) -> str:
    """Date of a UTC stamp, else of ``23 juillet à 18h55`` in a given year."""
    pattern = "'(\\\\d{1,2})\\\\s+([\\\\p{L}]+)\\\\s+.?\\\\s*\\\\d{1,2}h\\\\d{2}'"
    names = ", ".join(f"'{m}'" for m in MONTHS)
    month = f"array_position(array({names}), lower(regexp_extract({text}, {pattern}, 2)))"
    day = f"regexp_extract({text}, {pattern}, 1)"
    spelled = f"try_to_date(concat({year}, '-', lpad({month}, 2, '0'), '-', lpad({day}, 2, '0')), 'yyyy-MM-dd')"
    return f"coalesce(to_date(try_to_timestamp({utc}, 'yyyy-MM-dd HH:mm:ss')), {spelled})"


def normalized_team(name: str) -> str:
    """Lower case without the dropped words, punctuation and repeated spaces."""
    words = "|".join(TEAM_WORDS)
    bare = f"regexp_replace(lower(trim({name})), '(?U)\\\\b({words})\\\\b', '')"
    return f"trim(regexp_replace(regexp_replace({bare}, '(?U)[^\\\\w\\\\s]', ''), '(?U)\\\\s+', ' '))"
