"""Builders for oracle SQL: the statements follow from short rule lists."""

from __future__ import annotations

# Cut-offs and labels of the bands (upper limit exclusive, then the
# label above the last limit).
SCORE_LEVEL = ([(600, "Very Low"), (650, "Low"), (700, "Medium"), (800, "High")], "Very High")
SCORE_RISK = ([(600, "Very High Risk"), (650, "High Risk"), (700, "Medium Risk"), (800, "Low Risk")], "Very Low Risk")
SCORE_RANGE = ([(600, "0-599"), (650, "600-649"), (700, "650-699"), (750, "700-749"), (800, "750-799")], "800+")
SCORE_MISLABELLED = ([(600, "<600"), (650, "650-699"), (700, "700-799")], "800+")
# inclusive limits
DELINQUENCY = ([("= 0", "No Delinquency"), ("<= 2", "LOW Delinquency"), ("<= 5", "Moderate Delinquency")], "Severe Delinquency")

# Metric, failing comparison, default bound, status; first match counts.
MONITOR_RULES = [("gini", "<", 0.30, "GINI_LOW"), ("ks", "<", 0.20, "KS_LOW"), ("psi", ">", 0.25, "PSI_HIGH")]
BOUND_COLUMN = {"gini": "gini_min", "ks": "ks_min", "psi": "psi_max"}


def bands(column: str, rule: tuple) -> str:
    """Label of the band of ``column``; NULL falls through to the last label."""
    limits, last = rule
    sql = f"'{last}'"
    for limit, label in reversed(limits):
        test = limit if isinstance(limit, str) else f"< {limit}"
        sql = f"IF({column} {test}, '{label}', {sql})"
    return sql


def any_of(rules: list[tuple]) -> str:
    """Disjunction of (column, comparison, bound)."""
    return " OR ".join(f"({c} {op} {v})" for c, op, v in rules)


def mean(column: str, name: str, digits: int = 2) -> str:
    return f"ROUND(AVG({column}), {digits}) AS {name}"


def monitor_status(own_bounds: bool = True) -> str:
    """First failing rule's status, by the row's own bounds or the defaults."""
    sql = "'OK'"
    for metric, op, default, status in reversed(MONITOR_RULES):
        sql = f"IF({metric} {op} {BOUND_COLUMN[metric] if own_bounds else default}, '{status}', {sql})"
    return sql


def monitor_passes(own_bounds: bool = True) -> str:
    """All rules hold (NULL if a metric is missing and no other rule fails)."""
    return " AND ".join(f"NOT ({m} {op} {BOUND_COLUMN[m] if own_bounds else d})" for m, op, d, _ in MONITOR_RULES)


def counted(table: str, keys: list[tuple[str, str]], name: str, extra: list[str] = (), share: str | None = None,
            where: str | None = None) -> str:
    """Rows per key, optionally with their share of all rows in percent.

    ``keys``: (expression, output name).  The total comes from its own subquery.
    """
    source = f"(SELECT * FROM {table}{f' WHERE {where}' if where else ''})"
    out = [f"{e} AS {n}" for e, n in keys] + [f"COUNT(*) AS {name}", *extra]
    if share:
        out.append(f"ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM {source}), 2) AS {share}")
    return f"SELECT {', '.join(out)} FROM {source} AS t GROUP BY {', '.join(str(i + 1) for i in range(len(keys)))}"


def count_if(condition: str, name: str) -> str:
    return f"CAST(SUM(IF({condition}, 1, 0)) AS BIGINT) AS {name}"
