"""All registered queries by operator id, each with its SQL where SQL can say it.

Every query reads whole tables. Vectors are compared element by element, so results
hold plain columns only; doubles that come from sums are rounded to six digits.
"""

from dosecast.plans import (  # noqa: F401  (importing registers the queries)
    queries_embed,
    queries_models,
    queries_prompts,
    queries_scores,
    queries_search,
    queries_sources,
)
from dosecast.plans.catalog import ORACLES, QUERIES  # noqa: F401
