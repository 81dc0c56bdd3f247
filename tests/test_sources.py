import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dosecast.session import scratch_path
from dosecast.sources import tables


def test_text_round_trip(spark):
    cells = ['quote " inside', "tab\there", "line\nbreak", " lead and trail ", "back\\slash", "a,b", 'ends with "', "\n"]
    rows = spark.createDataFrame(list(enumerate(cells)), "id long, cell string")
    for sep in ("\t", ","):
        path = scratch_path(spark, "round")
        tables.write_text_table(rows, path, sep)
        back = tables.read_text_table(spark, path, rows.schema, sep)
        assert {r["id"]: r["cell"] for r in back.collect()} == dict(enumerate(cells))


def test_missing_texts_become_null(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("AUC\tname\n" + "".join(f"1.5\t{t}\n" for t in tables.MISSING_TEXTS) + "NA\tx\n")
    schema = T.StructType([T.StructField("AUC", T.DoubleType()), T.StructField("name", T.StringType())])
    rows = tables.read_text_table(spark, str(tmp_path / "in.tsv"), schema).collect()
    assert [r["name"] for r in rows] == [None] * len(tables.MISSING_TEXTS) + ["x"]
    assert rows[-1]["AUC"] is None and rows[0]["AUC"] == 1.5


def test_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("extra\tname\tAUC\nz\tx\t0.25\n")
    schema = T.StructType([T.StructField("AUC", T.DoubleType()), T.StructField("name", T.StringType())])
    assert tables.read_text_table(spark, str(tmp_path / "in.tsv"), schema).first() == (0.25, "x")
    with pytest.raises(ValueError, match="label"):
        tables.read_text_table(spark, str(tmp_path / "in.tsv"), T.StructType([T.StructField("label", T.StringType())]))


def test_a_wrong_number_fails_the_read(spark, tmp_path):
    (tmp_path / "in.tsv").write_text("AUC\nhigh\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        tables.read_text_table(spark, str(tmp_path / "in.tsv"), T.StructType([T.StructField("AUC", T.DoubleType())])).collect()


def test_response_context_is_optional(spark, tmp_path):
    names = [f.name for f in tables.RESPONSE_SCHEMA]
    (tmp_path / "in.tsv").write_text("\t".join(names[:-1]) + "\n" + "\t".join(["0.5", *"abcdef"]) + "\n")
    assert tables.read_response(spark, str(tmp_path / "in.tsv")).columns == names[:-1]
    with pytest.raises(ValueError):
        tables.read_response(spark, str(tmp_path / "in.tsv"), with_context=True)


def test_variants_are_read_by_folder(spark):
    path = scratch_path(spark, "variants")
    rows = spark.range(20).select("id", F.lit("study").alias("dataset"), F.concat(F.lit("v"), F.col("id") % 2).alias("variant"))
    tables.write_features_variants(rows, path)
    one = tables.read_features_variant(spark, path, rows.schema, "v1", "study")
    assert sorted(r["id"] for r in one.collect()) == list(range(1, 20, 2))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(variant" in plan


def test_scratch_is_dropped_on_request(spark, monkeypatch):
    from dosecast import session

    monkeypatch.setattr(session, "_scratch", [])
    table = session.materialize(spark.range(3), "small")
    assert table.count() == 3 and session.drop_scratch(spark) == 1 and session.drop_scratch(spark) == 0


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    from dosecast import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda key, default: default)})
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())


def test_prompts_are_written_packed_and_read_whole(spark, monkeypatch):
    from pathlib import Path

    from dosecast.operators.prompts import prompt_table

    monkeypatch.setattr(tables, "PACKED_ROWS", 50)
    names = ["AUC", "label", "cell_line_name", "cancer_type", "Cellline_desc", "drug_name", "drug_desc"]
    rows = [(i / 8, "Resistant", f"cell {i}", 'a "type"', "first\nsecond", None if i % 7 == 0 else f"drug\t{i}", "NA") for i in range(160)]
    prompts = prompt_table(spark.createDataFrame(rows, "AUC double, " + ", ".join(f"{n} string" for n in names[1:]))).coalesce(1)
    plain, path = scratch_path(spark, "plain.tsv"), scratch_path(spark, "prompts.tsv")
    tables.write_text_table(prompts, plain)
    tables.write_prompts(prompts, path)
    files = [f for f in Path(path.removeprefix("file:")).iterdir() if f.name.endswith(".csv.gz")]
    assert len(files) == 4  # each of at most 50 rows, so that tasks share them
    texts = [f for f in Path(plain.removeprefix("file:")).iterdir() if f.name.endswith(".csv")]
    assert 5 * sum(f.stat().st_size for f in files) < sum(f.stat().st_size for f in texts)
    found, wanted = ({tuple(r) for r in tables.read_prompts(spark, p).collect()} for p in (path, plain))
    assert found == wanted and len(found) == 160


def test_variants_are_written_without_a_sort(spark):
    rows = spark.range(200).selectExpr("id", "'study' AS dataset", "concat('v', id % 20) AS variant")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    path = scratch_path(spark, "variants")
    seen = []
    watch = type("Writer", (), {"partitionBy": lambda self, *by: self, "parquet": lambda self, path: seen.append(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters"))})
    tables.write_features_variants(type("Rows", (), {"sparkSession": spark, "write": watch()})(), path)
    assert seen == [str(tables.OPEN_FILES)] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    tables.write_features_variants(rows, path)  # more variants than a task keeps open
    assert spark.read.parquet(path).count() == 200 and spark.read.parquet(path).select("variant").distinct().count() == 20


def test_like_prompts_are_neighbours_in_less_room(spark):
    from pathlib import Path

    from dosecast.operators.prompts import prompt_table

    names = ["label", "cell_line_name", "cancer_type", "Cellline_desc", "drug_name", "drug_desc"]
    rows = [(i % 97 / 8, "Resistant", f"cell {i * 7 % 60}", "type", "tissue", None if i % 40 == 0 else f"drug {i % 40}", "NA") for i in range(3000)]
    response = spark.createDataFrame(rows, "AUC double, " + ", ".join(f"{n} string" for n in names)).coalesce(1)
    sizes, found = [], []
    for alike in (False, True):
        path = scratch_path(spark, "prompts.tsv")
        tables.write_prompts(prompt_table(response, alike=alike), path)
        sizes.append(sum(f.stat().st_size for f in Path(path.removeprefix("file:")).iterdir() if f.name.endswith(".csv.gz")))
        found.append({tuple(r) for r in tables.read_prompts(spark, path).collect()})
    assert found[0] == found[1] and 5 * sizes[1] < 4 * sizes[0]
    with_context = prompt_table(response.withColumn("CONTEXT", response["label"]), alike=True)
    assert with_context.count() == len(found[0])
