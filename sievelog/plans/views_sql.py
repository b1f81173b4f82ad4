"""The derived log tables as SQL common table expressions, for the side-by-side checks."""

from sievelog.plans.views import DUCKDB_TIMES, ENTRY_SQL, LINE_SQL

ENTRIES = f"log_entries AS ({ENTRY_SQL.format(events='events')})"
LINES = f"{ENTRIES}, log_lines AS ({LINE_SQL.format(entries='log_entries', **DUCKDB_TIMES)})"
SCORED = (
    f"{ENTRIES}, scored AS (SELECT *, score AS anomaly_score, CAST(score > 0.7 AS INT) AS prediction, "
    "CAST(is_anomaly AS INT) AS label FROM log_entries)"
)

WALL = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"


def wall(column: str) -> str:
    return WALL.format(column)
