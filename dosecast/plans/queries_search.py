"""Registered queries: what the sequential sampler proposes."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from dosecast.plans import sampler
from dosecast.plans import sql as q
from dosecast.plans.catalog import query
from dosecast.plans.queries_scores import SEED, space_text
from dosecast.plans.search import search_space
from dosecast.plans.space import Space
from dosecast.plans.views import load

FIRST, WAVE = 1_000_000_000, 10  # numbers of the proposed trials
_SPACE = Space()


def _draw(what: str) -> str:
    return q.md5_unit(str(SEED), f"'{what}'", "parameter", "trial_number", "candidate")


def _integer(unit: str, bounds: tuple[int, int]) -> str:
    low, high = bounds
    return f"CAST(least({low} + floor({unit} * {high - low + 1}), {high}) AS INT)"


def _unit(value: str, bounds: tuple[int, int]) -> str:
    low, high = bounds
    return f"({value} - {low} + 0.5) / {high - low + 1}"


def _density(part: str) -> str:
    far = lambda d: f"exp(-0.5 * pow(({d}) / h, 2))"
    kernel = f"({far('c.x - s.x')} + {far('c.x + s.x')} + {far('2 - c.x - s.x')}) / (h * {q.double(math.sqrt(2 * math.pi))})"
    return f"""
        SELECT c.trial_number, c.parameter, c.candidate,
               (coalesce(sum(CASE WHEN s.x IS NULL THEN 0 WHEN c.parameter = 'batch_size' THEN CASE WHEN c.x = s.x THEN 1 ELSE 0 END ELSE {kernel} END), 0)
                + CASE WHEN c.parameter = 'batch_size' THEN {q.double(1 / 3)} ELSE 1 END) / (count(s.x) + 1) AS density
        FROM candidates c LEFT JOIN (SELECT * FROM part_rows JOIN widths USING (good, parameter) WHERE good = {part}) s USING (parameter)
        GROUP BY c.trial_number, c.parameter, c.candidate"""


_LOW, _HIGH = _SPACE.learning_rates
_PROPOSALS = f"""{q.WITH('v_trials')},
    drawn AS (
      SELECT trial_number, val_spearman, {q.md5_long(str(SEED), "'batch_size'", 'trial_number')} % 3 AS category,
             {q.double(_LOW)} * pow({q.double(_HIGH / _LOW)}, {q.md5_unit(str(SEED), "'learning_rate'", 'trial_number')}) AS rate,
             2 + {q.md5_long(str(SEED), "'n_layers'", 'trial_number')} % 4 AS layers,
             row_number() OVER (ORDER BY CASE WHEN isnan(val_spearman) THEN NULL ELSE val_spearman END DESC NULLS LAST, trial_number) AS place,
             least({sampler.MOST_GOOD}, ceil({q.double(sampler.GOOD_SHARE)} * count(*) OVER ())) AS top
      FROM v_trials),
    part_rows AS (
      SELECT place <= top AS good, place, 'batch_size' AS parameter, CAST(category AS DOUBLE) AS x FROM drawn
      UNION ALL SELECT place <= top, place, 'learning_rate', (ln(rate) - {q.double(math.log(_LOW))}) / {q.double(math.log(_HIGH / _LOW))} FROM drawn
      UNION ALL SELECT place <= top, place, 'n_layers', {_unit('layers', _SPACE.layer_counts)} FROM drawn
      UNION ALL SELECT place <= top, place, 'n_units_l' || i, {_unit(f"(64 + {q.md5_long(str(SEED), chr(39) + 'n_units' + chr(39), 'i', 'trial_number')} % 961)", _SPACE.layer_widths)}
      FROM drawn, range(5) t(i) WHERE i < layers),
    widths AS (
      SELECT good, parameter, count(*) AS n, least(greatest({q.double(1.06)} * stddev_pop(x) * pow(count(*), {q.double(-0.2)}), 1.0 / (1 + count(*))), 0.5) AS h
      FROM part_rows GROUP BY ALL),
    centres AS (SELECT parameter, x AS centre, row_number() OVER (PARTITION BY parameter ORDER BY place) - 1 AS pick FROM part_rows WHERE good),
    asked AS (
      SELECT {FIRST} + t AS trial_number, parameter, candidate
      FROM range({WAVE}) a(t), (SELECT unnest([{', '.join(q.quoted(p) for p in sampler.parameters(_SPACE))}]) AS parameter), range({sampler.CANDIDATES}) c(candidate)),
    picked AS (
      SELECT a.*, h, coalesce(n, 0) AS n, CAST(floor({_draw('pick')} * (coalesce(n, 0) + 1)) AS INT) AS pick
      FROM asked a LEFT JOIN (SELECT * FROM widths WHERE good) USING (parameter)),
    near AS (
      SELECT p.*, centre, centre + h * sqrt(-2 * ln(1 - {_draw('radius')})) * cos({q.double(2 * math.pi)} * {_draw('angle')}) AS near
      FROM picked p LEFT JOIN centres USING (parameter, pick)),
    candidates AS (
      SELECT trial_number, parameter, candidate,
             CASE WHEN centre IS NULL AND parameter = 'batch_size' THEN floor({_draw('flat')} * 3) WHEN centre IS NULL THEN {_draw('flat')}
                  WHEN parameter = 'batch_size' THEN centre
                  ELSE greatest(least(CASE WHEN near < 0 THEN -near WHEN near > 1 THEN 2 - near ELSE near END, 1.0), 0.0) END AS x
      FROM near),
    judged AS (
      SELECT trial_number, parameter, x,
             row_number() OVER (PARTITION BY trial_number, parameter ORDER BY ln(g.density) - ln(r.density) DESC, candidate) AS choice
      FROM candidates JOIN ({_density('true')}) g USING (trial_number, parameter, candidate)
      JOIN ({_density('false')}) r USING (trial_number, parameter, candidate)),
    chosen AS (SELECT trial_number, map_from_entries(list((parameter, x))) AS chosen FROM judged WHERE choice = 1 GROUP BY trial_number)
    SELECT trial_number, list_extract([64, 128, 256], CAST(chosen['batch_size'] AS INT) + 1) AS batch_size,
           round({q.double(_LOW)} * pow({q.double(_HIGH / _LOW)}, chosen['learning_rate']), 9) AS learning_rate,
           array_to_string(list_transform(range({_integer("chosen['n_layers']", _SPACE.layer_counts)}),
                                          lambda i: {_integer("chosen['n_units_l' || i]", _SPACE.layer_widths)}), '-') AS hidden_dims
    FROM chosen"""


@query("search_proposals", _PROPOSALS)
def proposals(spark, sf):
    """The next wave after a history of one trial for every vector."""
    scored = load(spark, sf, "v_trials")
    drawn = search_space(scored.select("trial_number"), SEED)
    asked = spark.range(FIRST, FIRST + WAVE).select(F.col("id").alias("trial_number"))
    return space_text(sampler.propose(drawn.join(scored, "trial_number"), asked, SEED))
