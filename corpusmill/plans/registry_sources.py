"""Registered queries of readers and writers: each writes a sample table in one of the layouts and reads it back."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import hashing
from corpusmill.functions.lineage import cut, scratch
from corpusmill.operators import labels, results, splits
from corpusmill.plans import experiment
from corpusmill.plans.inputs import PREDICTIONS_SQL, labelled, predictions, table, with_label
from corpusmill.plans.registered import S, query
from corpusmill.plans.registry import FIRST_SQL, GREEDY_SQL, STRATIFIED_SQL, near_sql
from corpusmill.sources import corpora, snapshots, tables


def folder(spark: SparkSession) -> str:
    """A new folder of its own in the shared one."""
    return f"{scratch(spark)}/source-{uuid.uuid4().hex}"


def local(path: str) -> str:
    return path.removeprefix("file://")


def one_file(df: DataFrame, path: str, **options) -> None:
    """``df`` as a single CSV file of that name: readers of raw corpora look for files by name."""
    parts = path + ".parts"
    df.coalesce(1).write.csv(parts, escape='"', **options)
    made = next(f for f in sorted(os.listdir(local(parts))) if f.startswith("part-"))
    os.makedirs(os.path.dirname(local(path)), exist_ok=True)
    os.rename(os.path.join(local(parts), made), local(path))


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text", "lang", "source")


# --- tables (A16-A23, A25-A27, B11, B12, G4, H1) --------------------------------------------------
@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE lang = 'fr'")
def source_versions(spark, d):
    """One version out of several, found by its directory."""
    root = folder(spark)
    tables.write_version(documents(spark, d).select(F.lit("DOC").alias("dataset_id"), F.col("lang").alias("version"), "doc_id", "text"), root)
    return tables.read_version(spark, root, "DOC", "fr").select("doc_id", hashing.sha256(F.col("text")).alias("sha"))


@query("SELECT doc_id, sha256(text) AS sha, source FROM documents")
def source_csv(spark, d):
    """Texts with line ends, quotes and commas through CSV."""
    root = folder(spark)
    tables.write_csv(documents(spark, d).select("doc_id", "text", "source"), root)
    return tables.read_csv(spark, root, "doc_id long, text string, source string").select("doc_id", hashing.sha256(F.coalesce("text", F.lit(""))).alias("sha"), "source")


@query("SELECT n_nationkey, n_name, 3 AS n FROM nation")
def source_csv_appended(spark, d):
    root = folder(spark)
    rows = table(spark, d, "nation").select("n_nationkey", "n_name")
    for _ in range(3):
        tables.append_csv(rows, root)
    return tables.read_csv(spark, root, "n_nationkey long, n_name string").groupBy("n_nationkey", "n_name").agg(F.count(F.lit(1)).cast("int").alias("n"))


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def source_json(spark, d):
    root = folder(spark)
    tables.write_json_rows(documents(spark, d).select("doc_id", "text"), root)
    return spark.read.schema("doc_id long, text string").json(root).select("doc_id", hashing.sha256(F.col("text")).alias("sha"))


@query("SELECT r_name AS name, r_regionkey::BIGINT AS key FROM region")
def source_json_value(spark, d):
    """A configuration value: one JSON document with sorted keys."""
    path = f"{folder(spark)}/value.json"
    tables.write_json({r["r_name"]: r["r_regionkey"] for r in table(spark, d, "region").collect()}, local(path))  # five regions
    return spark.createDataFrame(list(tables.read_json(local(path)).items()), "name string, key long")


@query("SELECT l.doc_id AS row_pos, quality FROM labels l")
def source_indices(spark, d):
    """An index file and the rows that it picks."""
    root = folder(spark)
    rows = table(spark, d, "labels").select(F.col("doc_id").alias("row_pos"), "quality")
    tables.write_indices(rows, root)
    return tables.read_indices(spark, root).join(rows, "row_pos").select("row_pos", "quality")


@query(f"{STRATIFIED_SQL} SELECT row_pos, part FROM split")
def source_splits(spark, d):
    root = folder(spark)
    made = splits.stratified(with_label(spark, d), 13, "row_pos").select(F.lit("DOC").alias("dataset_id"), F.lit("S-RAND").alias("regime"), F.lit(13).alias("seed"), "part", "row_pos")
    tables.write_splits(made.unionByName(made.withColumn("seed", F.lit(42))), root)
    return tables.read_split(spark, root, "DOC", "S-RAND", 13).select("row_pos", "part")


@query(f"{STRATIFIED_SQL} SELECT row_pos FROM split WHERE part = 'val'")
def source_split_files(spark, d):
    """One part of a split by the name of its file."""
    root = folder(spark)
    made = splits.stratified(with_label(spark, d), 13, "row_pos").select(F.lit("DOC").alias("dataset_id"), F.lit("S-RAND").alias("regime"), F.lit(13).alias("seed"), "part", "row_pos")
    tables.write_splits(made, root)
    return spark.read.parquet(tables.split_path(root, "DOC", "S-RAND", 13, "val")).select("row_pos")


@query("SELECT doc_id AS row_pos FROM documents WHERE lang = 'de'")
def source_pairs(spark, d):
    """Kept test rows of one transfer pair by the name of its file."""
    root = folder(spark)
    tables.write_pairs(documents(spark, d).select(F.lit("en").alias("train_id"), F.col("lang").alias("test_id"), F.col("doc_id").alias("row_pos")), root)
    return spark.read.parquet(tables.pair_path(root, "en", "de")).select("row_pos")


@query("SELECT n_name AS model_id, s::INTEGER AS seed, n_nationkey / 100.0::DOUBLE AS macro_f1, CASE WHEN s = 2 THEN 'x' END AS note FROM nation, (VALUES (1), (2)) v(s)")
def source_results(spark, d):
    """Result rows appended in two goes, the second with one more column."""
    root = folder(spark)
    rows = table(spark, d, "nation").select(F.col("n_name").alias("model_id"), (F.col("n_nationkey") / 100.0).alias("macro_f1"))
    common = {"experiment_id": "EXP-1", "run_id": "r", "dataset_id": "N", "train_version": "v", "test_version": "v", "split_regime": "S-RAND"}
    for seed in (1, 2):
        made = results.result_rows(rows.withColumn("seed", F.lit(seed)), **common)
        tables.append_results(made.withColumn("note", F.lit("x")) if seed == 2 else made, root)
    return tables.read_results(spark, root).select("model_id", "seed", "macro_f1", "note")


@query(f"SELECT seed, row_pos, y_pred, y_prob FROM ({PREDICTIONS_SQL}) WHERE model_id = 'M2'")
def source_predictions(spark, d):
    """Predictions of one model out of two; other directories are not read."""
    root = folder(spark)
    tables.write_predictions(predictions(spark, d), root)
    return tables.read_predictions(spark, root, ["M2"]).select("seed", "row_pos", "y_pred", "y_prob")


# --- raw corpora (A9-A15, B1, B2, B6-B9) --------------------------------------------------------


def read_back(spark: SparkSession, dataset_id: str, root: str, entry: dict) -> DataFrame:
    """(row_pos, uid, title, sha, label) of what a reader gives, standardised and mapped."""
    rows = labels.standardise(corpora.load_raw(spark, dataset_id, entry, local(root)), dataset_id, "order")
    mapped = labels.binarize(rows, labels.mapping_spec(dataset_id, entry), "row_pos")
    return mapped.select("row_pos", "uid", "title", hashing.sha256(F.coalesce("text", F.lit(""))).alias("sha"), "label")


def numbered_sql(dataset_id: str, rows: str) -> str:
    """``rows`` (place, title, text, label) in order, as ``read_back`` gives them."""
    return f"SELECT n AS row_pos, '{dataset_id}_' || n AS uid, title, sha256(coalesce(text, '')) AS sha, label::INTEGER AS label FROM (SELECT *, row_number() OVER (ORDER BY place) - 1 AS n FROM ({rows}))"


@query(numbered_sql("DS1", "SELECT doc_id AS place, source AS title, text, 1 - quality AS label FROM documents JOIN labels USING (doc_id)"))
def source_articles(spark, d):
    """One CSV with titles and an explicit label map."""
    root = folder(spark)
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id").orderBy("doc_id").select(F.col("source").alias("Title"), F.col("text").alias("Text"), F.col("quality").alias("Label"))
    one_file(rows, f"{root}/articles.csv", header=True)
    return read_back(spark, "DS1", root, {"source_binary_map": {"fake": [0], "real": [1]}})


def two_files(spark: SparkSession, d: str, root: str, real: str, fake: str, title, text) -> None:
    rows = documents(spark, d).join(table(spark, d, "labels"), "doc_id").orderBy("doc_id")
    for quality, name in ((1, real), (0, fake)):
        one_file(rows.where(F.col("quality") == quality).select(title.alias("title"), text.alias("text")), f"{root}/{name}", header=True)


@query("SELECT title, sha256(text) AS sha, label::INTEGER AS label FROM (SELECT source AS title, text, 1 - quality AS label FROM documents JOIN labels USING (doc_id))")
def source_true_fake(spark, d):
    """Two CSVs whose names say the class."""
    root = folder(spark)
    two_files(spark, d, root, "True.csv", "Fake.csv", F.col("source"), F.col("text"))
    return read_back(spark, "DS2", root, {}).select("title", "sha", "label")


@query(f"SELECT title, sha256(CASE WHEN doc_id % 3 = 0 THEN title ELSE text END) AS sha, label::INTEGER AS label FROM (SELECT doc_id, source AS title, text, 1 - quality AS label FROM documents JOIN labels USING (doc_id))")
def source_named_classes(spark, d):
    """CSVs named by class; where the body is blank the title stands for it."""
    root = folder(spark)
    two_files(spark, d, f"{root}/in", "wire_real.csv", "wire_fake.csv", F.col("source"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).otherwise(" "))
    return read_back(spark, "DS3", root, {"source_files": ["missing/in/wire_fake.csv", "in/wire_real.csv"]}).select("title", "sha", "label")


@query(numbered_sql("DS4", "SELECT conv_id * 1000 + turn AS place, NULL::VARCHAR AS title, text, CASE WHEN role = 'user' THEN 1 ELSE 0 END AS label FROM conversations"))
def source_posts(spark, d):
    """Posts without a title."""
    root = folder(spark)
    rows = table(spark, d, "conversations").orderBy("conv_id", "turn").select(F.col("text").alias("tweet"), F.when(F.col("role") == "user", "Fake").otherwise("REAL").alias("label"))
    one_file(rows, f"{root}/posts.csv", header=True)
    return read_back(spark, "DS4", root, {"source_files": ["posts.csv"]})


@query(numbered_sql("DS5", """SELECT p_partkey AS place, NULL::VARCHAR AS title, 'a "' || p_name AS text, CASE WHEN p_size % 7 IN (1, 2, 3) THEN 1 ELSE 0 END AS label FROM part WHERE p_size % 7 <> 0"""))
def source_statements(spark, d):
    """Tab-separated statements with quotes taken as they are, an empty file beside them, and grades out of the map."""
    root = folder(spark)
    grades = F.array(*[F.lit(g) for g in ("unknown", "pants-fire", "FALSE", "barely_true", "half-true", "Mostly True", "true")])
    rows = table(spark, d, "part").orderBy("p_partkey").select(
        F.col("p_partkey").cast("string").alias("id"), F.element_at(grades, (F.col("p_size") % 7 + 1).cast("int")).alias("label"), F.concat(F.lit('a "'), F.col("p_name")).alias("statement"),
        *[F.lit("x").alias(f"c{k}") for k in range(11)],
    )
    one_file(rows, f"{root}/train.tsv", header=False, sep="\t", quote="")
    with open(f"{local(root)}/valid.tsv", "w"):
        pass
    six = {"liar_binary_map": {"fake": ["pants-fire", "false", "barely-true"], "real": ["half-true", "mostly-true", "true"]}}
    return read_back(spark, "DS5", root, six)


@query(f"SELECT doc_id AS row_pos, sha256(regexp_replace(coalesce(source, '') || ' ' || coalesce(text, ''), '^{S}+|{S}+$', '', 'g')) AS sha FROM documents")
def source_combined_text(spark, d):
    """Title and body as one text."""
    from corpusmill.functions.text import combined_text

    return documents(spark, d).select(F.col("doc_id").alias("row_pos"), hashing.sha256(combined_text(F.col("source"), F.col("text"))).alias("sha"))


# --- snapshots (A1-A8, C19, E14) -----------------------------------------------------------------
FILES_SQL = "SELECT r_regionkey AS k, 'r' || r_regionkey || '/' || lower(r_name) || '.txt' AS path, r_name AS content FROM region"


def files(spark: SparkSession, d: str) -> str:
    """A folder with one small file for each region, below a directory of its own, and hidden ones beside."""
    root = local(folder(spark))
    for r in table(spark, d, "region").collect():  # five regions
        for name in (f"{r['r_name'].lower()}.txt", ".hidden"):
            path = f"{root}/r{r['r_regionkey']}/{name}"
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(r["r_name"])
    return root


def shots(spark: SparkSession, d: str) -> DataFrame:
    root = files(spark, d)
    attached = snapshots.list_inputs(root)
    found = {name: snapshots.resolve(name, {"input_dirname": name.lower()}, root, attached) for name in ("R0", "R1", "R2", "R3", "R4", "R9")}
    return snapshots.snapshots(spark, found)


SHOTS_SQL = f"""SELECT v.id AS dataset_id, CASE WHEN k IS NULL THEN 'missing' ELSE 'ok' END AS status, CASE WHEN k IS NOT NULL THEN sha256(split_part(path, '/', 2) || chr(9) || sha256(content)) END AS digest,
  CASE WHEN k IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_files, coalesce(length(content), 0)::BIGINT AS n_bytes FROM (VALUES ('R0'), ('R1'), ('R2'), ('R3'), ('R4'), ('R9')) v(id) LEFT JOIN ({FILES_SQL}) ON 'R' || k = v.id"""


@query(SHOTS_SQL)
def source_snapshots(spark, d):
    """Content hashes of five corpora, and one that is missing."""
    return shots(spark, d).fillna(0, ["n_files", "n_bytes"])


@query(f"SELECT count_if(status = 'ok')::BIGINT AS n_ok, count_if(status = 'missing')::BIGINT AS n_missing FROM ({SHOTS_SQL})")
def source_manifest(spark, d):
    root = folder(spark)
    tables.write_json_rows(snapshots.manifest(shots(spark, d)), root)
    return spark.read.json(root).select("n_ok", "n_missing")


@query(f"SELECT dataset_id || chr(9) || coalesce(digest, '-') || chr(9) || coalesce(n_files, 0) || chr(9) || coalesce(n_bytes, 0) || chr(9) || status AS value FROM ({SHOTS_SQL})")
def source_ledger(spark, d):
    root = folder(spark)
    snapshots.ledger_lines(shots(spark, d)).write.text(root)
    return spark.read.text(root)


@query(f"SELECT split_part(path, '/', 1) AS folder, 1::BIGINT AS n_files, length(content)::BIGINT AS n_bytes FROM ({FILES_SQL})")
def source_listing(spark, d):
    """Files and bytes of each folder; hidden files stay out."""
    report = snapshots.folder_report(snapshots.input_files(spark, files(spark, d)))
    return report.select(F.regexp_extract("folder", "[^/]*$", 0).alias("folder"), "n_files", "n_bytes")


@query(f"SELECT count(*)::BIGINT AS n_files, sum(length(content))::BIGINT AS n_bytes, sha256(string_agg(path || chr(9) || sha256(content), chr(10) ORDER BY path)) AS digest FROM ({FILES_SQL})")
def source_directory_hash(spark, d):
    root = files(spark, d)
    return hashing.directory_hash(snapshots.input_files(spark, root), root).select("n_files", F.col("n_bytes").cast("long").alias("n_bytes"), "digest")


@query("""SELECT sha256('{' || string_agg('"' || r_name || '":' || r_regionkey, ',' ORDER BY r_name) || '}') AS digest FROM region""")
def hash_json(spark, d):
    """The hash of a value's canonical JSON."""
    value = {r["r_name"]: r["r_regionkey"] for r in table(spark, d, "region").collect()}  # five regions
    return spark.createDataFrame([(hashing.sha256_json(json.loads(json.dumps(value))),)], "digest string")


# --- stages and the sweep (I7, Q3, Q6, Q7) ---------------------------------------------------------


@query(f"""{near_sql(FIRST_SQL, 0.95)}{GREEDY_SQL}, n0 AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM rows) AS k, (SELECT count(*) FROM dropped) AS g)
SELECT 'DOC' AS dataset_id, n AS n_before, n - k AS n_exact_removed, g AS n_near_removed, k - g AS n_kept, round(100 * (n - k + g) / n, 4) AS pct_removed, k - g AS n_written,
  (SELECT sum(pos)::BIGINT FROM rows WHERE pos NOT IN (SELECT row_pos FROM dropped)) AS places FROM n0""")
def stage_dedup(spark, d):
    """The dedup stage from a written version of all documents: its report, and what it has written."""
    root = folder(spark)
    tables.write_version(labelled(spark, d).withColumn("version", F.lit("vCLEAN-C")), root)
    config = experiment.PipelineConfig.load({"datasets": [{"dataset_id": "DOC", "entry": {}}]})
    report = cut(experiment.dedup_stage(spark, config, root))
    kept = tables.read_version(spark, root, "DOC", "vDEDUP").agg(F.count(F.lit(1)).alias("n_written"), F.sum("pre_dedup_index").alias("places"))
    return report.crossJoin(kept)  # one row each


@query(f"""{STRATIFIED_SQL}, tests AS (SELECT count(*) AS n FROM split WHERE part = 'test')
SELECT model_id, seed, n AS n_predictions, 'ok' AS outcome, 0::BIGINT AS n_again FROM tests, (VALUES ('LR', 13)) m(model_id, seed)""")
def sweep_cells(spark, d):
    """A sweep of logistic regression over its grid on the documents: cells run, their predictions and records; a second call runs none."""
    root = folder(spark)
    rows = with_label(spark, d)
    bundle = cut(rows.join(splits.stratified(rows, 13, "row_pos").select("row_pos", "part"), "row_pos").select("row_pos", "part", "text", "label"))
    cell = dict(experiment_id="EXP-1", dataset_id="DOC", train_version="vRAW", test_version="vRAW", split_regime="S-RAND")
    run = experiment.start_run(spark, cell | {"model_id": "LR", "seed": 13}, hashing.sha256_json(cell))
    paths = (f"{root}/results", f"{root}/predictions")
    done = experiment.run_sweep(spark, {13: bundle}, ["LR"], *paths, cell)
    experiment.finish_run(spark, run, f"{root}/runs")
    again = experiment.run_sweep(spark, {13: bundle}, ["LR"], *paths, cell)
    counts = tables.read_predictions(spark, f"{root}/predictions", ["LR"]).groupBy("model_id", "seed").agg(F.count(F.lit(1)).alias("n_predictions"))
    cells = spark.createDataFrame(done, "model_id string, seed int").join(counts, ["model_id", "seed"])
    record = spark.read.parquet(f"{root}/runs").select(F.col("cell")["model_id"].alias("model_id"), "outcome")
    return cells.join(record, "model_id").select("model_id", "seed", "n_predictions", "outcome", F.lit(len(again)).cast("long").alias("n_again"))
