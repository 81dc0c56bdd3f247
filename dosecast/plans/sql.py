"""Pieces of DuckDB SQL for the registered queries' expected results."""

from __future__ import annotations

from dosecast.functions.hashing import ALPHABET
from dosecast.plans.views import duckdb_with

WITH = duckdb_with


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def double(value: float) -> str:
    return f"CAST('{float(value)!r}' AS DOUBLE)"


def md5(*parts: str) -> str:
    """md5 of SQL expressions joined by ':'."""
    return "md5(" + " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def md5_long(*parts: str) -> str:
    return f"('0x' || substr({md5(*parts)}, 1, 15))::BIGINT"


def md5_unit(*parts: str) -> str:
    return f"(CAST({md5_long(*parts)} AS DOUBLE) / {double(1 << 60)})"


def token(*parts: str, length: int = 5) -> str:
    digest = md5(*parts)
    letters = [
        f"substr('{ALPHABET}', (('0x' || substr({digest}, {1 + 4 * i}, 4))::INT % {len(ALPHABET)}) + 1, 1)"
        for i in range(length)
    ]
    return "(" + " || ".join(letters) + ")"


def split(source: str, key: str, test: float, val: float, seed: int = 42, group: str | None = None) -> str:
    """A SELECT of ``source`` with its ``split`` column."""
    over = f"PARTITION BY {group}" if group else ""
    relative = val / (1.0 - test)
    return f"""
        SELECT * EXCLUDE (_rn, _n, _t, _v),
               CASE WHEN _rn <= _t THEN 'test' WHEN _rn <= _t + _v THEN 'val' ELSE 'train' END AS split
        FROM (SELECT *, ceil({double(relative)} * (_n - _t)) AS _v
              FROM (SELECT *, ceil({double(test)} * _n) AS _t
                    FROM (SELECT *, row_number() OVER ({over} ORDER BY md5('{seed}:' || {key}), {key}) AS _rn,
                                 count(*) OVER ({over}) AS _n
                          FROM {source})))"""


def average_rank(value: str, group: str = "") -> str:
    by = f"PARTITION BY {group}" if group else ""
    ties = f"PARTITION BY {group}, {value}" if group else f"PARTITION BY {value}"
    return f"(rank() OVER ({by} ORDER BY {value}) + (count(*) OVER ({ties}) - 1) / 2.0)"


def spearman(source: str, group: str) -> str:
    """SELECT group, n, spearman; a constant side gives NULL."""
    return f"""
        SELECT {group}, count(*) AS n,
               covar_pop(ry, rp) / nullif(stddev_pop(ry) * stddev_pop(rp), 0) AS spearman
        FROM (SELECT {group}, {average_rank('y', group)} AS ry, {average_rank('p', group)} AS rp FROM {source})
        GROUP BY {group}"""


MSE = "avg((y - p) * (y - p))"
R2 = (
    "CASE WHEN count(*) < 2 THEN NULL WHEN var_pop(y) > 0 THEN 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) "
    "WHEN sum((y - p) * (y - p)) = 0 THEN 1.0 ELSE 0.0 END"
)

_PANELS = 4000


def spearman_p(source: str, group: str) -> str:
    """SELECT group, n, spearman, spearman_p: the tail of the t density by Simpson's rule.

    With t = r sqrt((n-2)/(1-r^2)) the two-sided tail is the share of the integral of
    cos(u)^(n-3) over [0, pi/2] that lies above asin|r|.
    """
    return f"""
        SELECT {group}, any_value(n) AS n, any_value(spearman) AS spearman,
               CASE WHEN any_value(n) > 2 THEN
                   sum(CASE WHEN i = 0 OR i = {_PANELS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
                       * pow(cos(asin(abs(spearman)) + (pi() / 2 - asin(abs(spearman))) * i / {_PANELS}.0), n - 3))
                   * any_value(pi() / 2 - asin(abs(spearman))) / {_PANELS} / 3
                   / any_value(sqrt(pi()) / 2 * exp(lgamma((n - 2) / 2.0) - lgamma((n - 1) / 2.0)))
               END AS spearman_p
        FROM {source} CROSS JOIN (SELECT unnest(range({_PANELS} + 1)) AS i)
        GROUP BY {group}"""


def linear_two(train: str, rows: str, group: str | None = None) -> str:
    """Rows of ``rows`` with ``p`` from the least-squares fit of y on x1, x2 over ``train``."""
    by = "_g"
    label = f"{group} AS _g" if group else "1 AS _g"
    on = f"_g = r.{group}" if group else "_g = 1"
    return f"""
        SELECT r.*, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS p
        FROM {rows} r JOIN (
            SELECT _g, m1, m2, my, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1,
                   (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2
            FROM (SELECT {label}, avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my, var_pop(x1) AS s11, var_pop(x2) AS s22,
                         covar_pop(x1, x2) AS s12, covar_pop(x1, y) AS s1y, covar_pop(x2, y) AS s2y
                  FROM {train} GROUP BY {by})) ON {on}"""


def linear_groups(train: str, rows: str, width: int, group: str) -> str:
    """CTEs ending in ``scored``: ``rows`` with ``p`` from least squares of y on all of ``x`` inside each group.

    Groups of at most ``width`` rows take the minimum-norm fit: with centred rows X, (X X' + J / n) a = y - mean(y)
    is eliminated and X' a are the coefficients. Larger groups solve the normal equations.
    """
    return f"""
    numbered AS (SELECT {group} AS _g, y, x, row_number() OVER (PARTITION BY {group} ORDER BY row_id) AS r,
                        count(*) OVER (PARTITION BY {group}) AS n FROM {train}),
    cells AS (SELECT _g, r, n, unnest(range(1, {width + 1})) AS i, CAST(unnest(x) AS DOUBLE) AS v FROM numbered),
    centres AS (SELECT _g, i, avg(v) AS m FROM cells GROUP BY _g, i),
    centred AS (SELECT _g, r, n, i, v - m AS v FROM cells JOIN centres USING (_g, i)),
    means AS (SELECT _g, avg(y) AS my FROM numbered GROUP BY _g),
    targets AS (SELECT _g, r, n, y - my AS t FROM numbered JOIN means USING (_g)),
    gram AS (SELECT a._g AS _g, a.r AS i, b.r AS j, sum(a.v * b.v) + 1.0 / any_value(a.n) AS s
             FROM centred a JOIN centred b ON a._g = b._g AND a.i = b.i WHERE a.n <= {width} GROUP BY a._g, a.r, b.r
             UNION ALL SELECT _g, r, n + 1, t FROM targets WHERE n <= {width}
             UNION ALL SELECT a._g, a.i, b.i, sum(a.v * b.v)
             FROM centred a JOIN centred b ON a._g = b._g AND a.r = b.r WHERE a.n > {width} GROUP BY a._g, a.i, b.i
             UNION ALL SELECT c._g, c.i, {width + 1}, sum(c.v * t.t)
             FROM centred c JOIN targets t ON c._g = t._g AND c.r = t.r WHERE c.n > {width} GROUP BY c._g, c.i),
    lines AS (SELECT _g, i, list(s ORDER BY j) AS line FROM gram GROUP BY _g, i),
    system AS (SELECT _g, list(line ORDER BY i) AS m FROM lines GROUP BY _g),
    steps AS (SELECT _g, 0 AS k, m FROM system
              UNION ALL
              SELECT _g, k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1
                  THEN list_transform(line, lambda v: v / m[k + 1][k + 1])
                  ELSE list_transform(line, lambda v, j: v - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
              FROM steps WHERE k < len(m)),
    solved AS (SELECT _g, list_transform(m, lambda line: line[-1]) AS a FROM steps WHERE k = len(m)),
    slopes AS (SELECT _g, i, sum(v * a[r]) AS b FROM centred JOIN solved USING (_g) WHERE n <= {width} GROUP BY _g, i
               UNION ALL SELECT _g, unnest(range(1, {width + 1})), unnest(a) FROM solved
               WHERE _g IN (SELECT _g FROM numbered WHERE n > {width})),
    fitted AS (SELECT _g, any_value(my) - sum(b * m) AS b0, list(b ORDER BY i) AS b
               FROM slopes JOIN centres USING (_g, i) JOIN means USING (_g) GROUP BY _g),
    scored AS (SELECT r.*, b0 + list_dot_product(b, CAST(x AS DOUBLE[])) AS p
               FROM {rows} r JOIN fitted ON _g = r.{group})"""


def linear_all(train: str, rows: str, width: int) -> str:
    """CTEs ending in ``scored``: ``rows`` with ``p`` from least squares of y on all of ``x``.

    The normal equations of the centred rows are eliminated column by column.
    """
    return f"""
    cells AS (SELECT row_id, unnest(range(1, {width + 1})) AS i, CAST(unnest(x) AS DOUBLE) AS v FROM {train}),
    centres AS (SELECT i, avg(v) AS m FROM cells GROUP BY i),
    centred AS (SELECT row_id, i, v - m AS v FROM cells JOIN centres USING (i)
                UNION ALL SELECT row_id, {width + 1}, y - (SELECT avg(y) FROM {train}) FROM {train}),
    gram AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS s FROM centred a JOIN centred b USING (row_id)
             WHERE a.i <= {width} GROUP BY ALL),
    system AS (SELECT list(line ORDER BY i) AS m FROM (SELECT i, list(s ORDER BY j) AS line FROM gram GROUP BY i)),
    steps AS (SELECT 0 AS k, m FROM system
              UNION ALL
              SELECT k + 1, list_transform(m, lambda line, i: CASE WHEN i = k + 1
                  THEN list_transform(line, lambda v: v / m[k + 1][k + 1])
                  ELSE list_transform(line, lambda v, j: v - line[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END)
              FROM steps WHERE k < {width}),
    solved AS (SELECT list_transform(m, lambda line: line[{width + 1}]) AS b FROM steps WHERE k = {width}),
    fitted AS (SELECT b, (SELECT avg(y) FROM {train})
                         - list_dot_product(b, (SELECT list(m ORDER BY i) FROM centres)) AS b0 FROM solved),
    scored AS (SELECT r.*, b0 + list_dot_product(b, CAST(x AS DOUBLE[])) AS p FROM {rows} r CROSS JOIN fitted)"""


def boosted(rows: str, width: int, group: str, rounds: int, depth: int, bins: int, step: float, bits: int) -> str:
    """CTEs of second-order boosted trees inside each group, grown on the ``train`` rows of ``rows``.

    ``boosted_splits`` has the inner nodes, ``boosted_scored`` all rows with ``p`` after the last round. Gradients are
    whole numbers of ``unit``, so sums are exact and equal gains are equal here as anywhere.
    """
    made = [
        f"""
    b_rows AS MATERIALIZED (
      SELECT row_id, {group} AS _g, y, x, split = 'train' AS train, avg(y) FILTER (split = 'train') OVER (PARTITION BY {group}) AS base,
             count(*) FILTER (split = 'train') OVER (PARTITION BY {group}) AS n FROM {rows}),
    b_units AS MATERIALIZED (
      SELECT _g, CASE WHEN max(abs(y - base)) > 0 THEN pow(2.0, ceil(log2(max(abs(y - base)))) - {bits}) ELSE 1.0 END AS unit
      FROM b_rows WHERE train GROUP BY _g),
    b_cells AS MATERIALIZED (SELECT row_id, _g, train, n, unnest(range({width})) AS f, unnest(x)::DOUBLE AS v FROM b_rows),
    b_ranked AS (
      SELECT _g, f, v, n, row_number() OVER (PARTITION BY _g, f ORDER BY v) AS rn, min(v) OVER (PARTITION BY _g, f) AS low
      FROM b_cells WHERE train),
    b_cuts AS MATERIALIZED (
      SELECT _g, f, v, row_number() OVER (PARTITION BY _g, f ORDER BY v) - 1 AS cut
      FROM (SELECT DISTINCT _g, f, v FROM b_ranked WHERE v > low AND least(rn * {bins} // n, {bins - 1}) > (rn - 1) * {bins} // n)),
    b_bins AS MATERIALIZED (
      SELECT c.row_id, c.f, count(k.v) AS bin FROM b_cells c LEFT JOIN b_cuts k ON k._g = c._g AND k.f = c.f AND k.v <= c.v
      GROUP BY c.row_id, c.f),
    b_p1 AS (SELECT row_id, base AS p FROM b_rows)"""
    ]
    for r in range(1, rounds + 1):
        made.append(f"""
    b_g{r} AS MATERIALIZED (
      SELECT row_id, _g, train, CAST(floor((p - y) / unit + 0.5) AS BIGINT) AS g FROM b_rows JOIN b_p{r} USING (row_id) JOIN b_units USING (_g)),
    b_n{r}_0 AS (SELECT row_id, _g, train, g, 1 AS node FROM b_g{r})""")
        for level in range(depth):
            now = f"{r}_{level}"
            made.append(f"""
    b_c{now} AS (
      SELECT _g, node, f, bin, sum(g) OVER upto * unit AS gl, sum(n) OVER upto AS hl,
             sum(g) OVER (PARTITION BY _g, node, f) * unit AS tg, sum(n) OVER (PARTITION BY _g, node, f) AS th
      FROM (SELECT _g, node, f, bin, sum(g) AS g, count(*) AS n FROM b_n{now} JOIN b_bins USING (row_id) WHERE train GROUP BY ALL)
      JOIN b_units USING (_g) WINDOW upto AS (PARTITION BY _g, node, f ORDER BY bin)),
    b_s{now} AS MATERIALIZED (
      SELECT _g, node, f, bin, gain FROM (
        SELECT *, gl * gl / (hl + 1) + (tg - gl) * (tg - gl) / (th - hl + 1) - tg * tg / (th + 1) AS gain FROM b_c{now} WHERE hl < th)
      WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY _g, node ORDER BY gain DESC, f, bin) = 1),
    b_n{r}_{level + 1} AS MATERIALIZED (
      SELECT n.row_id, n._g, train, g, 2 * node + CASE WHEN c.bin > s.bin THEN 1 ELSE 0 END AS node
      FROM b_n{now} n JOIN b_s{now} s USING (_g, node) JOIN b_bins c ON c.row_id = n.row_id AND c.f = s.f)""")
        ends = [f"SELECT * FROM b_n{r}_{level} ANTI JOIN b_s{r}_{level} USING (_g, node)" for level in range(depth)]
        made.append(f"""
    b_l{r} AS MATERIALIZED ({' UNION ALL BY NAME '.join([*ends, f'SELECT * FROM b_n{r}_{depth}'])}),
    b_v{r} AS (SELECT _g, node, -(sum(g) * any_value(unit)) / (count(*) + 1) * {double(step)} AS v
               FROM b_l{r} JOIN b_units USING (_g) WHERE train GROUP BY _g, node),
    b_p{r + 1} AS MATERIALIZED (SELECT row_id, p + v AS p FROM b_p{r} JOIN b_l{r} USING (row_id) JOIN b_v{r} USING (_g, node))""")
    found = [f"SELECT {r} AS round, * FROM b_s{r}_{level}" for r in range(1, rounds + 1) for level in range(depth)]
    made.append(f"""
    boosted_splits AS (
      SELECT s._g AS {group}, round, node, s.f + 1 AS feature, k.v AS threshold, gain
      FROM ({' UNION ALL '.join(found)}) s JOIN b_cuts k ON k._g = s._g AND k.f = s.f AND k.cut = s.bin),
    boosted_scored AS (SELECT r.*, p FROM {rows} r JOIN b_p{rounds + 1} USING (row_id))""")
    return ",".join(made)
