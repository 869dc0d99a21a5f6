"""SQL twin of the Holt-Winters fits: one recursive step per observation, for every set of factors."""

from pantrylens.operators.holt_winters import FINER, FLOOR, GRID, MOST, SEASON, Z95

_FACTORS = "alpha, beta, gamma, phi"
_SEASONS = ", ".join(f"s{k}" for k in range(SEASON))


def _values(name: str, values) -> str:
    return f"(VALUES {', '.join(f'({v}::DOUBLE)' for v in values)}) {name}_({name})"


def _mean(start: int) -> str:
    return "(" + " + ".join(f"z[{start + k + 1}]" for k in range(SEASON)) + f") / {SEASON}"


def _fold(start: str, fold: str, grid: str) -> str:
    rotated = ", ".join(f"s{k}" for k in range(1, SEASON))
    return f"""
SELECT item_id, {_FACTORS}, 0 AS t, n, level0 AS level, trend0 AS trend, {", ".join(f"z[{k + 1}] - level0 AS s{k}" for k in range(SEASON))},
  0::DOUBLE AS error, 0::DOUBLE AS squares, 0::DOUBLE AS share
FROM {start} JOIN {grid}
UNION ALL
SELECT item_id, {_FACTORS}, t + 1, n, new_level, new_trend, {rotated}, newest, error + off, squares + off * off, share + off_share
FROM (SELECT f.*, greatest(y[t + 1], {FLOOR}::DOUBLE) AS v, phi * trend AS damped, level + damped AS before, v - (before + s0) AS off,
    alpha * (v - s0) + (1 - alpha) * before AS new_level, beta * (new_level - level) + (1 - beta) * damped AS new_trend,
    gamma * (v - before) + (1 - gamma) * s0 AS newest,
    CASE WHEN y[t + 1] <> 0 THEN abs((y[t + 1] - (before + s0)) / y[t + 1]) ELSE 0 END AS off_share
  FROM {fold} f JOIN (SELECT item_id, y FROM {start}) USING (item_id) WHERE t < n)"""


def _best(fold: str) -> str:
    return f"SELECT DISTINCT ON (item_id) * FROM {fold} WHERE t = n ORDER BY item_id, squares, {_FACTORS}"


def holt_winters_ctes(name: str, lists: str) -> dict[str, str]:
    """Tables ``<name>_fit`` and ``<name>_steps`` of the series in ``lists`` (item_id, y, last, n)."""
    grid = ", ".join(_values(f, v) for f, v in GRID.items())
    damping, damp = [], "0"
    for _ in range(SEASON):
        damp = f"phi * (1 + {damp})"
        damping.append(damp)
    return {
        f"{name}_start": f"""
SELECT item_id, n, last, y, list_transform(y[1:{2 * SEASON}], lambda v: greatest(v, {FLOOR}::DOUBLE)) AS z, {_mean(0)} AS level0,
  ({_mean(SEASON)} - level0) / {SEASON} AS trend0 FROM {lists} WHERE n >= {2 * SEASON}""",
        f"{name}_coarse": _fold(f"{name}_start", f"{name}_coarse", f"(SELECT * FROM {grid}) g ON true"),
        f"{name}_regrid": f"""
SELECT item_id, least(alpha * m_alpha, {MOST}::DOUBLE) AS alpha, beta, least(gamma * m_gamma, {MOST}::DOUBLE) AS gamma, phi
FROM (SELECT item_id, {_FACTORS} FROM ({_best(f"{name}_coarse")})), {_values("m_alpha", FINER)}, {_values("m_gamma", FINER)}""",
        f"{name}_fine": _fold(f"{name}_start", f"{name}_fine", f"{name}_regrid USING (item_id)"),
        f"{name}_fit": f"""
SELECT b.*, last, y, sqrt(greatest(squares / n - (error / n) * (error / n), 0)) AS spread, len(list_filter(y, lambda v: v <> 0)) AS sold
FROM ({_best(f"{name}_fine")}) b JOIN (SELECT item_id, last, y FROM {name}_start) USING (item_id)""",
        f"{name}_steps": f"""
SELECT item_id, (last + step::INTEGER)::DATE AS date, forecast, greatest(forecast - {Z95}::DOUBLE * spread, 0) AS lower,
  forecast + {Z95}::DOUBLE * spread AS upper
FROM (SELECT *, greatest(level + [{", ".join(damping)}][step] * trend + [{_SEASONS}][step], 0) AS forecast
  FROM {name}_fit, range(1, {SEASON + 1}) r(step))""",
    }
