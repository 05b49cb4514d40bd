"""SQL text for small-matrix work: rotations of a symmetric matrix, factor updates and neighbour counts."""

from __future__ import annotations

from collections.abc import Sequence


def eigen_sql(source: str, n: int, sweeps: int = 10) -> str:
    """Body with columns ``lam`` and ``load``: eigenvalues and unit eigenvectors of ``a``, a flat n x n list in the
    one row of ``source``. Every step turns one pair of axes so that their entry becomes zero."""
    pairs = [(p, q) for p in range(n) for q in range(p + 1, n)]
    ps, qs = ([str(x[k]) for x in pairs] for k in (0, 1))

    def turned(m: str) -> str:  # columns p and q
        i = f"(x // {n}) * {n}"
        return (f"[CASE x % {n} WHEN p THEN c * {m}[{i} + p + 1] - s * {m}[{i} + q + 1] "
                f"WHEN q THEN s * {m}[{i} + p + 1] + c * {m}[{i} + q + 1] ELSE {m}[x + 1] END for x in range({n * n})]")

    rows = (f"[CASE x // {n} WHEN p THEN c * b[p * {n} + x % {n} + 1] - s * b[q * {n} + x % {n} + 1] "
            f"WHEN q THEN s * b[p * {n} + x % {n} + 1] + c * b[q * {n} + x % {n} + 1] ELSE b[x + 1] END for x in range({n * n})]")
    return f"""
WITH RECURSIVE turns AS (
  SELECT 0 AS step, a::DOUBLE[] AS a, [(x // {n} = x % {n})::INT::DOUBLE for x in range({n * n})] AS v FROM {source}
  UNION ALL
  SELECT step + 1, {rows}, {turned('v')} FROM (
    SELECT *, {turned('a')} AS b FROM (SELECT *, t / sqrt(t * t + 1) AS s, 1 / sqrt(t * t + 1) AS c FROM (
      SELECT *, CASE WHEN abs(o) < 1e-200 THEN 0.0 WHEN h >= 0 THEN 1 / (h + sqrt(h * h + 1)) ELSE -1 / (sqrt(h * h + 1) - h) END AS t FROM (
        SELECT *, CASE WHEN abs(o) < 1e-200 THEN 0.0 ELSE (a[q * {n} + q + 1] - a[p * {n} + p + 1]) / (2 * o) END AS h FROM (
          SELECT *, a[p * {n} + q + 1] AS o FROM (
            SELECT *, [{', '.join(ps)}][step % {len(pairs)} + 1] AS p, [{', '.join(qs)}][step % {len(pairs)} + 1] AS q FROM turns
            WHERE step < {sweeps * len(pairs)}))))))
)
SELECT a[k * {n} + k + 1] AS lam, [v[i * {n} + k + 1] for i in range({n})] AS load
FROM turns, (SELECT unnest(range({n})) AS k) WHERE step = {sweeps * len(pairs)}"""


def factor_sql(rows: str, start: Sequence[Sequence[float]], rounds: int, steps: int, tiny: float) -> str:
    """Body with columns ``h`` (flat rank x m list) and ``g`` (flat rank x rank Gram list of the row factors) after
    ``rounds`` alternations over the lists ``x`` of the table ``rows``."""
    k, m = len(start), len(start[0])
    dot = lambda i: " + ".join(f"x[{j + 1}] * h[{i * m + j + 1}]" for j in range(m))
    hh = lambda i, l: " + ".join(f"h[{i * m + j + 1}] * h[{l * m + j + 1}]" for j in range(m))
    w = ", ".join(f"w[{i + 1}] * a[{i + 1}] / ({' + '.join(f'w[{l + 1}] * b[{i * k + l + 1}]' for l in range(k))} + {tiny!r})" for i in range(k))
    new = ", ".join(f"h[{i * m + j + 1}] * p[{i * m + j + 1}] / ({' + '.join(f'g[{i * k + l + 1}] * h[{l * m + j + 1}]' for l in range(k))} + {tiny!r})"
                    for i in range(k) for j in range(m))
    ones = f"[1.0 for i in range({k})]::DOUBLE[]"
    return f"""
WITH RECURSIVE rounds AS (
  SELECT 0 AS r, [{', '.join(repr(v) for row in start for v in row)}]::DOUBLE[] AS h, []::DOUBLE[] AS g
  UNION ALL
  SELECT r + 1, list_reduce(list_prepend(h, [h for i in range({steps})]), lambda h, i: [{new}]), g FROM (
    SELECT r, h, [{', '.join(f'sum(w[{i + 1}] * x[{j + 1}])' for i in range(k) for j in range(m))}] AS p,
           [{', '.join(f'sum(w[{i + 1}] * w[{l + 1}])' for i in range(k) for l in range(k))}] AS g
    FROM (SELECT r, h, x, list_reduce([{ones} for i in range({steps + 1})], lambda w, i: [{w}]) AS w
          FROM (SELECT r, h, x, [{', '.join(dot(i) for i in range(k))}] AS a, b FROM (
            SELECT r, h, [{', '.join(hh(i, l) for i in range(k) for l in range(k))}] AS b FROM rounds WHERE r < {rounds}), {rows}))
    GROUP BY r, h)
)
SELECT h, g FROM rounds WHERE r = {rounds}"""


def digamma_sql(n: str) -> str:
    x = f"({n})::DOUBLE"
    return (f"CASE WHEN {n} < 10 THEN -0.5772156649015329 + list_sum(list_prepend(0.0, [1.0 / q for q in range(1, ({n})::BIGINT)])) "
            f"ELSE ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) + 1 / (240 * {x} ** 8) END")


def information_sql(source: str, key: str, target: str, cols: Sequence[str], k: int, jitter: float, hair: float) -> str:
    """Body (feature, mi): the k-nearest-neighbour estimate from all pairs of rows."""
    def part(c: str) -> str:
        sd = f"(SELECT coalesce(nullif(stddev_pop({c}), 0), 1) FROM {source})"
        size = f"{jitter!r} * greatest(1.0, (SELECT avg(abs({c})) FROM {source}) / {sd})"
        return f"{c} / {sd} + {size} * (('0x' || substr(md5({key}::VARCHAR || '|{c}'), 1, 8))::BIGINT / 2147483647.5 - 1.0)"

    points = " UNION ALL ".join(f"SELECT '{c}' AS feature, {key} AS id, {part(c)} AS x, {part(target)} AS y FROM {source} "
                                f"WHERE {c} IS NOT NULL AND {target} IS NOT NULL" for c in cols)
    return f"""
WITH points AS MATERIALIZED ({points}),
radii AS MATERIALIZED (
  SELECT a.feature, a.id, a.x, a.y, list_sort(min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k}))[{k}] - {hair!r} AS r
  FROM points a JOIN points b ON a.feature = b.feature AND a.id <> b.id GROUP BY ALL),
counts AS (
  SELECT a.feature, a.id, greatest(count(*) FILTER (WHERE abs(a.x - b.x) < r), 1) AS nx, greatest(count(*) FILTER (WHERE abs(a.y - b.y) < r), 1) AS ny
  FROM radii a JOIN points b ON a.feature = b.feature GROUP BY 1, 2)
SELECT feature, greatest({digamma_sql('n')} + {digamma_sql(str(k))} - near, 0.0) AS mi
FROM (SELECT feature, count(*) AS n, avg({digamma_sql('nx')} + {digamma_sql('ny')}) AS near FROM counts GROUP BY 1)"""


def lloyd_sql(rows: str, key: str, dims: int, ks: Sequence[int], starts: int, rounds: int) -> str:
    """Body (k, start, cost, c): flat centres of every run after ``rounds`` over the lists ``v`` of ``rows``."""
    flat = lambda k: ", ".join(
        f"coalesce(avg(v[{j + 1}]) FILTER (WHERE own = {i}), any_value(c)[{i * dims + j + 1}])" for i in range(k) for j in range(dims))
    most = max(ks)
    far = f"[list_distance(v, c[i * {dims} + 1: (i + 1) * {dims}]) for i in range(k)]"
    return f"""
WITH RECURSIVE firsts AS MATERIALIZED (
  SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY md5({key}::VARCHAR || '|' || s::VARCHAR), {key}) AS r
  FROM {rows}, (SELECT unnest(range({starts})) AS s)),
runs AS (
  SELECT 0 AS r, k, s AS start, flatten(list(v ORDER BY f.r)) AS c FROM firsts f, (SELECT unnest({list(ks)}) AS k) WHERE f.r <= k GROUP BY k, s
  UNION ALL
  SELECT any_value(r) + 1, k, start, [{flat(most)}][1: k * {dims}]
  FROM (SELECT r, k, start, c, v, list_position(d, list_min(d)) - 1 AS own FROM (SELECT *, {far} AS d FROM runs, {rows} WHERE r < {rounds}))
  GROUP BY k, start
)
SELECT k, start, c, sum(list_min(d) ** 2) AS cost FROM (SELECT *, {far} AS d FROM runs, {rows} WHERE r = {rounds}) GROUP BY k, start, c"""
