"""Registered queries: embedding jobs and feature tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from dosecast.functions.vectors import fill_empty, json_to_vector, vector_to_json, wide_columns
from dosecast.operators import embed, features
from dosecast.plans import sql as q
from dosecast.plans.queries_scores import SEED, r6, rounded
from dosecast.plans.catalog import query
from dosecast.plans.views import load
from dosecast.session import materialize, scratch_path

DIMS = 64
LONG_TEXT = 300
PROJECTED = 16
SPACES_SQL = r"'[ \t\n\x0B\f\r]+'"


def _token_list(text: str, limit: int | None = None) -> str:
    words = f"list_filter(string_split_regex(lower({text}), {SPACES_SQL}), lambda w: w <> '')"
    return words if limit is None else f"{words}[1:{limit}]"


def hashed_sql(rows: str, key: str) -> str:
    """(key, position, value): the token-hash vectors of ``rows`` (key, text), without zeros."""
    return f"""
        SELECT {key}, position, round(CAST(count / sqrt(sum(count * count) OVER (PARTITION BY {key})) AS FLOAT), 6)
               AS value
        FROM (SELECT {key}, CAST(('0x' || substr(md5(word), 1, 15))::BIGINT % {DIMS} AS INT) AS position,
                     CAST(count(*) AS DOUBLE) AS count
              FROM (SELECT {key}, unnest({_token_list('text')}) AS word FROM {rows}) GROUP BY ALL)"""


def non_zero(vectors: DataFrame, *keys: str) -> DataFrame:
    # The outer form keeps the planner from computing every vector twice to see if it is empty.
    cells = vectors.select(*keys, F.posexplode_outer("vector").alias("position", "value")).filter("value <> 0")
    return cells.withColumn("value", F.round(F.col("value").cast("double"), 6))


_LONG_DOCS = """long_docs AS (
    SELECT doc_id || '|text' AS id, coalesce(text, '') AS text FROM v_docs
    UNION ALL SELECT doc_id || '|source', coalesce(source, '') FROM v_docs)"""


_LONG_SQL = f"""{q.WITH('v_docs')}, {_LONG_DOCS}
    SELECT CAST(split_part(id, '|', 1) AS BIGINT) AS doc_id, split_part(id, '|', 2) AS variant, position,
           round(CAST(value AS DOUBLE), 6) AS value
    FROM ({hashed_sql('long_docs', 'id')})"""


@query("embed_columns", _LONG_SQL)
def embed_columns(spark, sf):
    encoder = partial(embed.TokenHashEncoder, DIMS)
    rows = embed.embed_columns(load(spark, sf, "v_docs"), "doc_id", ["text", "source"], encoder, batch_size=256)
    return non_zero(rows, "doc_id", "variant")


@query("embed_columns_sql", _LONG_SQL)
def embed_columns_sql(spark, sf):
    prompts = embed.long_prompts(load(spark, sf, "v_docs"), "doc_id", ["text", "source"])
    return non_zero(
        embed.hash_embed_sql(prompts, ["doc_id", "variant"], "prompt", DIMS), "doc_id", "variant"
    )


@query(
    "embed_batch",
    f"""{q.WITH('v_docs')}
    SELECT doc_id, position, round(CAST(value AS DOUBLE), 6) AS value FROM ({hashed_sql('v_docs', 'doc_id')})""",
)
def embed_batch(spark, sf):
    encoder = partial(embed.TokenHashEncoder, DIMS)
    return non_zero(embed.embed_prompts(load(spark, sf, "v_docs"), encoder, "text", embed.BATCH_SIZE), "doc_id")


@query(
    "embed_distinct",
    f"""{q.WITH('v_docs')}
    SELECT doc_id, position, round(CAST(value AS DOUBLE), 6) AS value FROM ({hashed_sql('v_docs', 'doc_id')})""",
)
def embed_distinct(spark, sf):
    encoder = partial(embed.TokenHashEncoder, DIMS)
    rows = embed.embed_prompts(load(spark, sf, "v_docs"), encoder, "text", embed.BATCH_SIZE, distinct=True)
    return non_zero(rows, "doc_id")


@query(
    "emb_fill_empty",
    f"{q.WITH('v_response_nulls')} SELECT drug_name, coalesce(drug_desc, '') AS prompt FROM v_response_nulls",
)
def emb_fill_empty(spark, sf):
    rows = load(spark, sf, "v_response_nulls")
    return rows.select("drug_name", fill_empty(F.col("drug_desc")).alias("prompt"))


_WIDE_SQL = ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i + 1}" for i in range(DIMS))
_FAILED = "vec_id % 50 = 0"


@query(
    "emb_to_json",
    f"""{q.WITH('v_features')}, failing AS (
        SELECT vec_id, CASE WHEN {_FAILED} THEN NULL ELSE embedding END AS embedding FROM v_features)
    SELECT vec_id, embedding IS NULL AS failed, {_WIDE_SQL} FROM failing""",
)
def emb_to_json(spark, sf):
    rows = load(spark, sf, "v_features").withColumn("embedding", F.expr(f"if({_FAILED}, NULL, embedding)"))
    cells = rows.select("vec_id", vector_to_json(F.col("embedding")).alias("cell"))
    back = cells.select("vec_id", (F.col("cell") == "").alias("failed"), json_to_vector(F.col("cell")).alias("v"))
    return back.select("vec_id", "failed", *wide_columns("v", DIMS))


@query(
    "embed_truncate",
    f"""SELECT doc_id, len({_token_list('text', 16)}) AS n_tokens,
        array_to_string({_token_list('text', 16)}, ' ') AS kept FROM documents""",
)
def embed_truncate(spark, sf):
    kept = embed.tokens(F.col("text"), 16)
    return load(spark, sf, "v_docs").select(
        "doc_id", F.size(kept).cast("bigint").alias("n_tokens"), F.array_join(kept, " ").alias("kept")
    )


def _projection_sql() -> str:
    prime = 2147483647
    return f"""
        m0 AS (SELECT i, j, {SEED * 1299709 + 1} + i * 7919 + j * 104729 AS m
               FROM (SELECT unnest(range({DIMS + 1})) AS i), (SELECT unnest(range({PROJECTED})) AS j)),
        m1 AS (SELECT i, j, ((m % {prime}) * (m % {prime}) + 48271) % {prime} AS m FROM m0),
        m2 AS (SELECT i, j, (m * m + 48271) % {prime} AS m FROM m1),
        m3 AS (SELECT i, j, (m * m + 48271) % {prime} AS m FROM m2),
        w AS (SELECT i, j, (2 * CAST(m AS DOUBLE) / {prime} - 1) / sqrt(CAST({DIMS} AS DOUBLE)) AS w FROM m3)"""


@query(
    "embed_project",
    f"""{q.WITH('v_features')}, {_projection_sql()},
    cells AS (SELECT vec_id, unnest(range({DIMS})) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM v_features),
    summed AS (SELECT vec_id, j, sum(x * w) AS s FROM cells JOIN w USING (i) GROUP BY ALL)
    SELECT vec_id, CAST(summed.j AS INT) AS position, {r6('s + w')} AS value
    FROM summed JOIN w ON w.i = {DIMS} AND w.j = summed.j""",
)
def embed_project(spark, sf):
    rows = embed.project_vectors(load(spark, sf, "v_features"), "embedding", DIMS, PROJECTED, SEED)
    return rounded(rows.select("vec_id", F.posexplode("projected").alias("position", "value")), "value")


def _half_sql(x: str) -> str:
    """Round a double to half precision: 11 significant bits, steps of 2^-24 near zero."""
    step = f"pow(2.0, greatest(floor(log2(abs({x}))), -14) - 10)"
    return f"CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / {step}, 0) * {step} END"


@query(
    "embed_half",
    f"""{q.WITH('v_docs')}, vectors AS (
        SELECT doc_id, position, CAST(count / sqrt(sum(count * count) OVER (PARTITION BY doc_id)) AS FLOAT)::DOUBLE AS x
        FROM (SELECT doc_id, CAST(('0x' || substr(md5(word), 1, 15))::BIGINT % {DIMS} AS INT) AS position,
                     CAST(count(*) AS DOUBLE) AS count
              FROM (SELECT doc_id, unnest({_token_list('text')}) AS word FROM v_docs) GROUP BY ALL))
    SELECT doc_id, position, round({_half_sql('x')}, 6) AS value FROM vectors""",
)
def embed_half(spark, sf):
    encoder = partial(embed.TokenHashEncoder, DIMS)
    rows = embed.embed_prompts(load(spark, sf, "v_docs"), encoder, "text", batch_size=256, half=True)
    return non_zero(rows, "doc_id")


class ShortTextEncoder(embed.TokenHashEncoder):
    """An encoder that refuses long texts, to show what a failure costs."""

    def encode(self, texts):
        for text in texts:
            if len(self._spaces.sub(" ", text).split(" ")) > LONG_TEXT:
                raise ValueError("text too long")
        return super().encode(texts)


@query(
    "embed_error_policy",
    f"""{q.WITH('v_docs')}, counted AS (
        SELECT doc_id, len(string_split_regex(text, {SPACES_SQL})) > {LONG_TEXT} AS failed FROM v_docs)
    SELECT doc_id, NOT failed AS embedded, CASE WHEN failed THEN 'ValueError: text too long' END AS error,
           count(*) OVER () AS texts, count(*) FILTER (failed) OVER () AS failures
    FROM counted""",
)
def embed_error_policy(spark, sf):
    """Failures and their number, which the write itself counts."""
    watch = Observation("embedding")
    rows = embed.embed_prompts(load(spark, sf, "v_docs"), ShortTextEncoder, "text", embed.BATCH_SIZE, watch=watch)
    written = materialize(rows.select("doc_id", F.col("vector").isNotNull().alias("embedded"), "error"), "embedded")
    counts = watch.get
    return written.withColumns({"texts": F.lit(counts["rows"]).cast("long"), "failures": F.lit(counts["failures"]).cast("long")})


_CHUNK, _DEVICES = 100, 4
_CHUNKED = f"""
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_no,
           (row_number() OVER (ORDER BY doc_id) - 1) // {_CHUNK} AS chunk,
           CAST(((row_number() OVER (ORDER BY doc_id) - 1) // {_CHUNK}) % {_DEVICES} AS INT) AS device
    FROM documents"""


@query("embed_chunks", _CHUNKED)
def embed_chunks(spark, sf):
    return embed.embed_chunks(load(spark, sf, "v_docs").select("doc_id"), "doc_id", _CHUNK, _DEVICES)


@query("union_chunks", f"SELECT doc_id, row_no, chunk, lang FROM ({_CHUNKED}) JOIN documents USING (doc_id)")
def union_chunks(spark, sf):
    """Every device's chunks go to a folder of their own in one write; together they are one scan."""
    rows = embed.embed_chunks(load(spark, sf, "v_docs").select("doc_id", "lang"), "doc_id", _CHUNK, _DEVICES)
    path = scratch_path(spark, "processed")
    rows.write.partitionBy("device").parquet(path)
    return spark.read.schema(rows.schema).parquet(path).drop("device")


@query(
    "emb_from_json",
    f"""{q.WITH('v_features')}
    SELECT vec_id, vec_id % 10 < 4 AS bad_vector,
           {_WIDE_SQL}
    FROM (SELECT vec_id, CASE WHEN vec_id % 10 >= 4 THEN embedding END AS embedding FROM v_features)""",
)
def emb_from_json(spark, sf):
    bad = {0: "", 1: "[0.5, NaN]", 2: "[0.5, Infinity]", 3: "not a vector"}
    text = vector_to_json(F.col("embedding"))
    for digit, cell in bad.items():
        text = F.when(F.col("vec_id") % 10 == digit, F.lit(cell)).otherwise(text)
    parsed = features.parse_vectors(load(spark, sf, "v_features").withColumn("text", text), "text")
    good, quarantined = features.quarantine(parsed)
    rows = good.withColumn("bad_vector", F.lit(False)).unionByName(quarantined)
    return rows.select("vec_id", "bad_vector", *wide_columns("features", DIMS))


@query(
    "emb_to_wide",
    f"""{q.WITH('v_features')}, ragged AS (
        SELECT vec_id, embedding[1:{DIMS} - CAST(vec_id % 4 AS INT)] AS embedding FROM v_features)
    SELECT vec_id, {_WIDE_SQL} FROM ragged""",
)
def emb_to_wide(spark, sf):
    rows = load(spark, sf, "v_features")
    ragged = rows.select("vec_id", F.expr(f"slice(embedding, 1, CAST({DIMS} - vec_id % 4 AS INT))").alias("embedding"))
    return ragged.select("vec_id", *wide_columns("embedding", DIMS))


def embedded_wide(rows: DataFrame) -> DataFrame:
    """A wide embedded table: the vectors of all prompt columns, each one turned by one cell more."""
    turned = {
        f"emb_{column}": F.concat(F.slice("embedding", i + 1, DIMS), F.slice("embedding", 1, i))
        for i, column in enumerate(features.VARIANTS)
    }
    return rows.withColumns(turned)


def variant_rows(source: str) -> str:
    """The rows of ``source`` once for every variant, as ``embedded_wide`` makes them."""
    return "variants AS (" + " UNION ALL ".join(
        f"SELECT '{v}' AS variant, * REPLACE (list_concat(embedding[{i + 1}:], embedding[1:{i}]) AS embedding) FROM {source}"
        for i, v in enumerate(features.VARIANTS.values())
    ) + ")"


_VARIANT_ROWS = variant_rows("v_features")


@query(
    "feature_variants",
    f"""{q.WITH('v_features')}, {_VARIANT_ROWS}
    SELECT 'study' AS dataset, variant, vec_id, AUC, label, cancer_type, {_WIDE_SQL} FROM variants""",
)
def feature_variants(spark, sf):
    long = features.feature_variants(embedded_wide(load(spark, sf, "v_features")), "study", ["vec_id"])
    return long.select(
        "dataset", "variant", "vec_id", "AUC", "label", "cancer_type", *wide_columns("features", DIMS)
    )
