"""Reading and writing traces, datasets, labels, scores, manifests, pairs and corpora."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..vocabularies import AXES

TRACE = (
    "ts string, run_id string, item_id string, turn_idx int, role string, content string, tool_calls array<struct<name:string,arguments:string>>, retrieved_chunk_ids array<string>, latency_ms double, "
    "prompt_tokens bigint, completion_tokens bigint, reasoning_tokens bigint, usd_cost double, cached boolean, error string, format_violation string, budget_induced boolean, infrastructure_failed boolean, "
    "tool_error_reason string, guardrail_action string, guardrail_stage string, usage string"
)
ITEM = (
    "id string, axis string, subcategory string, turns array<string>, expected_behavior string, must_include array<string>, expected_tool string, answerable boolean, counterfactual_id string, "
    "counterfactual_variant string, counterfactual_attribute string, attack_type string, notes string"
)
LABEL = "item_id string, run_id string, dataset_sha256 string, response_sha256 string, label_space string, annotator string, labelled_at string, label string, score int, seconds_spent double, notes string"
SCORE = "pair_id string, scores map<string,double>, overall double, rationale string, parse_ok boolean, repaired boolean, evidence array<string>, axis string, rubric string, run_id string, judge_model string, error string, usd_cost double"
MANIFEST = (
    "run_id string, started_at string, run_kind string, model_name string, provider string, temperature double, max_tokens int, top_k int, chunk_size int, max_tool_calls int, max_tool_errors int, max_model_calls int, "
    "dataset_path string, dataset_sha256 string, guardrails boolean, guardrails_sha256 string, seeds array<int>, pairs_path string, judge_model string, git_sha string, git_dirty boolean, usd_cost double"
)
# Names that external pair files use, in order of preference.
ALIASES = {"prompt": ["prompt", "question", "input", "query"], "response": ["response", "answer", "output", "completion"], "human_score": ["human_score", "label", "gold", "score", "rating"], "pair_id": ["pair_id", "id"]}
# End of fixed values.


def fields(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file and seq of each line that isn't blank; seq grows along a file. Attached in the scan, before any shuffle."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("seq")).where(F.trim("value") != "")


def parsed(rows: DataFrame, schema: str) -> DataFrame:
    """lines with parsed columns and _corrupt: the line, where it is no object of the schema."""
    return rows.select("file", "seq", "value", F.from_json("value", schema + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r")).select("file", "seq", "value", "r.*")


def _or_fail(rows: DataFrame, bad: Column, message: Column) -> DataFrame:
    return rows.where(F.assert_true(~F.coalesce(bad, F.lit(False)), message).isNull())


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace rows with seq; a malformed line fails the read and is named by file and text. Fields that older files lack are null: unknown, not false.

    malformed_lines() gives such lines with their numbers, which only a read of whole files knows.
    """
    rows = parsed(lines(spark, path), TRACE)
    return _or_fail(rows, F.col("_corrupt").isNotNull(), F.concat(F.lit("malformed line in "), F.col("file"), F.lit(": "), F.left(F.col("value"), F.lit(80)))).drop("_corrupt", "value", "file")


def malformed_lines(spark: SparkSession, path: str, schema: str = TRACE) -> DataFrame:
    """file, line (from 1) and value of each line that is no object of the schema.

    Splits of a file count their lines first, and only files with a malformed line are counted.
    """
    numbered = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"))
    bad = parsed(numbered.where(F.trim("value") != ""), schema).where("_corrupt is not null").select("file", "seq", "value")
    own = numbered.join(bad.select("file").distinct(), "file", "left_semi")
    blocks = own.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("seq").alias("begins"))
    before = blocks.alias("a").join(blocks.alias("b"), (F.col("a.file") == F.col("b.file")) & (F.col("b.block") < F.col("a.block")), "left").groupBy("a.file", "a.block", "a.n", "a.begins").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    inside = (F.col("bad.file") == F.col("at.file")) & (F.col("bad.seq") >= F.col("at.begins")) & (F.col("bad.seq") < F.col("at.begins") + F.col("at.n"))
    return bad.alias("bad").join(before.alias("at"), inside).select("bad.file", (F.col("before") + F.col("seq") - F.col("begins") + 1).alias("line"), "value")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Dataset items; an unknown field or a malformed line fails the read, as does an empty file."""
    rows = parsed(lines(spark, path), ITEM)
    unknown = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, fields(ITEM))))
    checked = _or_fail(rows, F.col("_corrupt").isNotNull() | (F.size(unknown) > 0), F.concat(F.lit("bad item in "), F.col("file"), F.lit(": "), F.concat_ws(", ", unknown), F.lit(" "), F.left(F.col("value"), F.lit(80)))).drop("_corrupt", "value", "file")
    none = rows.agg(F.assert_true(F.count("*") > 0, F.lit("the dataset is empty")).alias("ok"))
    return checked.crossJoin(F.broadcast(none)).where("ok is null").drop("ok")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Human labels; lines that aren't valid records are skipped. Exactly one of label and score is set."""
    return parsed(lines(spark, path), LABEL).where("_corrupt is null").drop("_corrupt", "value", "file").where(valid_label())


def valid_label() -> Column:
    """Whether a parsed label record can be used."""
    valid = F.col("item_id").isNotNull() & F.col("run_id").isNotNull() & (F.col("label").isNull() != F.col("score").isNull()) & (F.coalesce("seconds_spent", F.lit(0.0)) >= 0)
    return valid & (F.col("label").isNull() | F.col("label").isin("pass", "fail")) & (F.col("score").isNull() | F.col("score").between(1, 5))


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Judge scores, one a pair; a pair that occurs twice fails the read."""
    rows = parsed(lines(spark, path), SCORE).where("_corrupt is null").drop("_corrupt", "value", "file")
    n = rows.groupBy("pair_id").agg(F.count("*").alias("n"), F.first(F.struct(*[c for c in rows.columns if c != "pair_id"])).alias("r"))
    return _or_fail(n, F.col("n") > 1, F.concat(F.lit("pair scored twice: "), F.col("pair_id"))).select("pair_id", "r.*")


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Manifests under a folder, newest first, and problems (file, reason) of files that aren't any."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.manifest.json").text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"), F.lit(0).alias("seq"))
    rows = parsed(raw, MANIFEST)
    bad = F.col("_corrupt").isNotNull() | F.col("run_id").isNull()
    return rows.where(~bad).drop("_corrupt", "value", "seq").orderBy(F.desc("started_at"), F.desc("run_id")), rows.where(bad).select("file", F.when(F.col("_corrupt").isNotNull(), "not a manifest").otherwise("no run id").alias("reason"))


def read_external(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """External pairs as strings: kind json (lines), array (one array, one object, or one object that wraps a list of objects), csv or tsv. Header names are trimmed and lower-cased, a byte order mark is dropped."""
    if kind in ("csv", "tsv"):
        rows = spark.read.option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("multiLine", True).csv(path)
    else:
        rows = spark.read.option("multiLine", kind == "array").option("primitivesAsString", True).json(path)
        lists = [f.name for f in rows.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
        if kind == "array" and len(lists) == 1:
            rows = rows.select(F.inline(lists[0]))
    return rows.toDF(*[c.lstrip("﻿").strip().lower() for c in rows.columns])


def mapped_columns(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename external columns to internal ones ({internal: external}); an unknown internal name is an error."""
    unknown = set(names) - set(ALIASES) - {"axis", "label_space", "annotator", "notes", "item_id", "run_id", "reference"}
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return rows.withColumnsRenamed({external.lower(): internal for internal, external in names.items()})


def first_alias(rows: DataFrame, aliases: list[str]) -> Column:
    """Per row the first alias, in order, that is present and not blank."""
    present = [F.when(F.trim(F.col(a)) != "", F.col(a)) for a in aliases if a in rows.columns]
    return F.coalesce(*present, F.lit(None).cast("string"))


def with_aliases(rows: DataFrame) -> DataFrame:
    """Internal columns by alias, and the rest as a metadata map."""
    used = {a for names in ALIASES.values() for a in names}
    rest = [c for c in rows.columns if c not in used]
    meta = F.map_from_arrays(F.array(*map(F.lit, rest)), F.array(*[F.col(c).cast("string") for c in rest])) if rest else F.lit(None).cast("map<string,string>")
    return rows.select(*[first_alias(rows, names).alias(k) for k, names in ALIASES.items()], *[c for c in ("axis",) if c in rows.columns], meta.alias("metadata"))


def labelled_pairs(rows: DataFrame) -> DataFrame:
    """Pairs with human_score as a number and errors: why a row can't be used, empty if it can."""
    score = F.expr("try_cast(human_score as double)")
    axis = F.col("axis") if "axis" in rows.columns else F.lit(None).cast("string")
    twice = rows.groupBy("pair_id").agg(F.count("*").alias("times")).where("times > 1 and pair_id is not null")
    errors = F.array_compact(
        F.array(
            F.when(F.col("prompt").isNull(), F.lit("no prompt")), F.when(F.col("response").isNull(), F.lit("no response")), F.when(score.isNull(), F.lit("no score")),
            F.when(score.isNotNull() & ~(score.between(1, 5) & (score == F.floor(score))), F.lit("score isn't whole from 1 to 5")), F.when(axis.isNotNull() & ~axis.isin(AXES), F.lit("unknown axis")), F.when(F.col("times").isNotNull(), F.lit("repeated id")),
        )
    )
    return rows.join(twice, "pair_id", "left").withColumns({"errors": errors, "human_score": score}).drop("times")


def read_corpus(spark: SparkSession, path: str, exclude: list[str] = ()) -> DataFrame:
    """name and text of each Markdown file but the excluded ones."""
    files = spark.read.option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))
    return files.where(~F.col("name").isin(list(exclude))) if exclude else files


def judge_runs(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evaluation runs with their judge run, and runs of which several judge runs speak."""
    runs = manifests.where("run_kind = 'eval'").select("run_id", F.concat(F.col("run_id"), F.lit(".jsonl")).alias("trace"))
    judges = manifests.where("run_kind = 'judge'").select(F.col("run_id").alias("judge_run_id"), F.element_at(F.split("pairs_path", "/"), -1).alias("trace"))
    found = runs.join(judges, "trace").groupBy("run_id").agg(F.count("*").alias("n"), F.min("judge_run_id").alias("judge_run_id"))
    return found.where("n = 1").drop("n"), found.where("n > 1").select("run_id", "n")


#: Order of a metric table on its way out: sections, then metrics within them.
METRIC_ORDER = ["section_ord", "row_ord", "conditioning", "metric"]


def write_metrics(metrics: DataFrame, path: str, kind: str = "parquet") -> None:
    """Long metric rows, a partition a run, ordered within it by what METRIC_ORDER names. Runs that are written again replace their own partition; other runs stay."""
    order = [c for c in METRIC_ORDER if c in metrics.columns]
    rows = metrics.withColumn("run_id", F.col("run_id").cast("string")).repartition("run_id").sortWithinPartitions("run_id", *order)
    rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("run_id").format(kind).save(path)


def read_metrics(spark: SparkSession, path: str, runs: list[str] | None = None, kind: str = "parquet") -> DataFrame:
    """Written metric rows, of some runs only if they are named; run_id is a string whatever it looks like."""
    reader = spark.read.format(kind)
    if kind == "csv":
        reader = reader.option("header", True)
    folders = [path] if runs is None else [f"{path}/run_id={r}" for r in runs]
    first = reader.option("basePath", path).load(folders)
    fields = [f if f.name != "run_id" else T.StructField("run_id", T.StringType()) for f in first.schema.fields]
    return reader.schema(T.StructType(fields)).option("basePath", path).load(folders)


def write_agreement(reports: DataFrame, path: str) -> None:
    """Agreement reports as nested JSON, one a line."""
    reports.select(F.to_json(F.struct(*reports.columns)).alias("value")).write.text(path)
