"""Small builders for oracle SQL text (DuckDB dialect)."""

from __future__ import annotations


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def ratio0(num: str, den: str) -> str:
    """num/den, 0.0 when den = 0."""
    return f"(CASE WHEN ({den}) > 0 THEN CAST({num} AS DOUBLE) / ({den}) ELSE 0.0::DOUBLE END)"


def by_sel(by: list[str], prefix: str = "") -> str:
    return "".join(f"{prefix}{b}, " for b in by)


def confusion_cte(src: str, gt: str, pred: str, by: list[str]) -> str:
    return (f"SELECT {by_sel(by)}{gt} AS gt, {pred} AS pred, count(*) AS n FROM {src} "
            f"WHERE {gt} IS NOT NULL AND {pred} IS NOT NULL GROUP BY ALL")


def per_class_cte(cm: str, by: list[str]) -> str:
    b = by_sel(by)
    return (f"SELECT {b}label, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS support FROM ("
            f"SELECT {b}gt AS label, CASE WHEN gt = pred THEN n ELSE 0 END AS tp, 0 AS fp, "
            f"CASE WHEN gt = pred THEN 0 ELSE n END AS fn, n AS support FROM {cm} "
            f"UNION ALL SELECT {b}pred AS label, 0, CASE WHEN gt = pred THEN 0 ELSE n END, 0, 0 FROM {cm}"
            f") GROUP BY ALL")


def f1_expr(tp="tp", fp="fp", fn="fn") -> str:
    return ratio0(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
