"""Workspaces and jobs as tables: sources, manifests, stages, artifacts, claims, failures, discovery."""

from __future__ import annotations

import os
import time
import tomllib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import STAGES, STATUSES

# Versions that are read, states of stages, and the order in which folders of jobs are looked through.
VERSIONS, STATES, FOLDERS = ("0.1.0",), ("pending", "completed", "degraded"), ("queued", "running", "finished")
#: What a failure in each stage counts as.
STAGE_ISSUES = {"ingest": "PHYSICAL_EXTRACTION", "physical": "PHYSICAL_EXTRACTION", "evidence": "LAYOUT_REGION", "layout": "LAYOUT_REGION", "semantic": "SECTION_STRUCTURE", "translate": "TRANSLATION", "render": "RENDERING", "index": "RENDER_MAPPING"}
#: Capabilities that stay with the engine itself.
INTERNAL = ("layout.reading_order", "layout.column_detection", "semantic.document")
SUFFIXES = (".json", ".tei.xml", ".xml")


def sources(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as bytes, with the SHA-256 that identifies each."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "modificationTime", "length", "content", F.sha2("content", 256).alias("fingerprint"))


def load_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Canonical documents of one kind; a file that does not fit the schema is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def dump_documents(rows: DataFrame) -> DataFrame:
    """json of each row without fields that are not set."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("json"))


def registry(text: str) -> dict[str, dict[str, str]]:
    """capability -> slot -> provider of a TOML text. Internal capabilities must be there and stay internal, and no provider may hold two slots of one."""
    out = {f"{domain}.{name}": dict(slots) for domain, names in tomllib.loads(text).items() for name, slots in names.items()}
    if missing := sorted(set(INTERNAL) - out.keys()):
        raise ValueError(f"registry misses internal capabilities: {missing}")
    for name in INTERNAL:
        if out[name].get("primary") != "internal":
            raise ValueError(f"capability {name} must stay internal")
    for name, slots in out.items():
        owners = [p for p in (slots.get("primary"), slots.get("challenger"), slots.get("fallback")) if p]
        if "primary" not in slots or len(owners) != len(set(owners)):
            raise ValueError(f"capability {name} needs a primary, and each provider once")
    return out


def registry_rows(spark: SparkSession, held: dict[str, dict[str, str]]) -> DataFrame:
    rows = [(name, slot, slots[slot], i) for name, slots in held.items() for i, slot in enumerate(("primary", "challenger", "fallback")) if slots.get(slot)]
    return spark.createDataFrame(rows, "capability string, slot string, provider string, rank int")


def dump_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted: provider, fingerprint, explicit; files: provider, fingerprint, suffix, path. The explicit path, else the first there is by suffix, else none; with where it came from."""
    order = F.array_position(F.array(*[F.lit(s) for s in SUFFIXES]), F.col("suffix"))
    best = files.where(F.col("suffix").isin(*SUFFIXES)).groupBy("provider", "fingerprint").agg(F.min_by("path", F.struct(order, "path")).alias("path"))
    rows = wanted.join(best, ["provider", "fingerprint"], "left")
    return rows.select("provider", "fingerprint", F.coalesce("explicit", "path").alias("path"), F.when(F.col("explicit").isNotNull(), "explicit").when(F.col("path").isNotNull(), "folder").otherwise("missing").alias("found"))


def config_digests(wanted: DataFrame, contents: DataFrame) -> DataFrame:
    """wanted: key, path (null if not configured); contents: path, content (null if unreadable). key, value: none, unreadable, or the SHA-256 of the file."""
    rows = wanted.join(contents, "path", "left")
    return rows.select("key", F.when(F.col("path").isNull(), "none").when(F.col("content").isNull(), "unreadable").otherwise(F.sha2("content", 256)).alias("value"))


def _ordinal(stage: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage)


def fingerprints(records: DataFrame, artifacts: DataFrame, config: DataFrame) -> DataFrame:
    """records: workspace, stage, producer_version; artifacts: workspace, stage, name, sha; config: stage, value. The key of each stage: its version, all artifacts of stages before it, and its configuration."""
    upstream = artifacts.select("workspace", "name", "sha", _ordinal(F.col("stage")).alias("_n"))
    rows = records.withColumn("_s", _ordinal(F.col("stage")))
    inputs = rows.join(upstream, "workspace").where("_n < _s").groupBy("workspace", "stage").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "name", "sha"))), ",").alias("inputs"))
    made = rows.join(inputs, ["workspace", "stage"], "left").join(config, "stage", "left")
    key = F.to_json(F.struct(F.coalesce("value", F.lit("")).alias("config"), F.coalesce("inputs", F.lit("")).alias("inputs"), F.col("producer_version").alias("producerVersion")))
    return made.select("workspace", "stage", F.sha2(key, 256).alias("fingerprint"))


def intact(records: DataFrame, artifacts: DataFrame, files: DataFrame) -> DataFrame:
    """workspace, stage, intact: completed, and every artifact's bytes are as recorded. files: workspace, name, now."""
    held = artifacts.join(files, ["workspace", "name"], "left").groupBy("workspace", "stage").agg(F.bool_and(F.coalesce(F.col("now") == F.col("sha"), F.lit(False))).alias("same"))
    return records.join(held, ["workspace", "stage"], "left").select("workspace", "stage", ((F.col("status") == "completed") & F.coalesce("same", F.lit(True))).alias("intact"))


def current(records: DataFrame, artifacts: DataFrame, files: DataFrame, config: DataFrame, versions: DataFrame) -> DataFrame:
    """workspace, stage, current: intact, of the version that would run now (stage, version), and with the key that it would have. A degraded stage never is."""
    keys = fingerprints(records, artifacts, config).withColumnRenamed("fingerprint", "_key")
    rows = records.join(intact(records, artifacts, files), ["workspace", "stage"]).join(keys, ["workspace", "stage"]).join(versions, "stage")
    return rows.select("workspace", "stage", (F.col("intact") & (F.col("producer_version") == F.col("version")) & (F.col("fingerprint") == F.col("_key"))).alias("current"))


def invalidated(records: DataFrame, from_stage: Column) -> DataFrame:
    """Records before a stage; it and all after it are forgotten."""
    return records.where(_ordinal(F.col("stage")) < _ordinal(from_stage))


def commit(spark: SparkSession, rows: DataFrame, root: str, stage: str, producer_version: str, degraded: bool = False) -> str:
    """Writes a stage's rows to a folder of its own, and only then a manifest row that names it; a failure before leaves the stage as it was."""
    target = f"{root.rstrip('/')}/{stage}/{uuid.uuid4().hex}"
    rows.write.parquet(target)
    record = [(stage, "degraded" if degraded else "completed", producer_version, target, time.time())]
    spark.createDataFrame(record, "stage string, status string, producer_version string, path string, at double").coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/manifest")
    return target


def committed(spark: SparkSession, root: str, stage: str) -> DataFrame | None:
    """The rows of the last commit of a stage, or None."""
    last = spark.read.parquet(f"{root.rstrip('/')}/manifest").where(F.col("stage") == stage).agg(F.max_by("path", "at").alias("path")).first()
    return spark.read.parquet(last["path"]) if last and last["path"] else None


def publish(spark: SparkSession, parts: dict[str, DataFrame], root: str, expected: int | None) -> int:
    """Writes all tables of a new revision, then a pointer row to it; refused when the last revision is not the expected one (None: none yet).
    Until the pointer is there, readers see the revision before; the tables of that one stay."""
    root = root.rstrip("/")
    if revision(spark, root) != expected:
        raise ValueError(f"not the expected revision: {expected}")
    number, target = (expected or 0) + 1, f"{root}/revisions/{uuid.uuid4().hex}"
    for name, rows in parts.items():
        rows.write.parquet(f"{target}/{name}")
    spark.createDataFrame([(target, time.time())], "path string, at double").coalesce(1).write.mode("errorifexists").parquet(f"{root}/pointers/revision={number}")
    return number


def _pointers(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{root.rstrip('/')}/pointers")
    except AnalysisException:
        return None


def revision(spark: SparkSession, root: str) -> int | None:
    """The last published revision, or None."""
    rows = _pointers(spark, root)
    return rows.agg(F.max("revision")).first()[0] if rows is not None else None


def published(spark: SparkSession, root: str, name: str, back: int = 0) -> DataFrame:
    """A table of the last revision, or of one further back."""
    last = _pointers(spark, root).where(F.col("revision") == revision(spark, root) - back).select("path").first()
    return spark.read.parquet(f"{last['path']}/{name}")


def bindings(manifests: DataFrame, accept: bool = False) -> DataFrame:
    """manifests: workspace, version, recorded, actual, stages (array). workspace, action: refused with why, rebind (all records go) or keep."""
    strange = F.exists("stages", lambda s: ~s.isin(*STAGES))
    foreign = ~F.col("recorded").eqNullSafe(F.col("actual"))
    action = F.when(~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False)), "refused: version").when(strange, "refused: unknown stage").when(foreign, "rebind" if accept else "refused: other source").otherwise("keep")
    return manifests.select("workspace", action.alias("action"))


def discovered(manifests: DataFrame) -> DataFrame:
    """manifests: path, mtime, json. A row for each path, the newest first, then by name; one that cannot be read says so and is not complete."""
    schema = "struct<workspaceVersion:string,stages:map<string,struct<status:string>>>"
    rows = manifests.groupBy("path").agg(F.max_by(F.struct("mtime", "json"), "mtime").alias("m")).select("path", "m.*").withColumn("r", F.from_json("json", schema))
    name = F.element_at(F.split("path", "/"), -1)
    bad = F.when(F.try_parse_json("json").isNull() | F.col("r.stages").isNull(), "unreadable").when(~F.coalesce(F.col("r.workspaceVersion").isin(*VERSIONS), F.lit(False)), "version")
    needed = [s for s in STAGES if s != "index"]
    state = lambda s: F.coalesce(F.try_element_at("r.stages", F.lit(s))["status"], F.lit("pending"))
    done = state(needed[0]) == "completed"
    for s in needed[1:]:
        done = done & (state(s) == "completed")
    order = Window.orderBy(F.desc("mtime"), name, "path")
    return rows.select("path", name.alias("name"), bad.alias("error"), (bad.isNull() & F.coalesce(done, F.lit(False))).alias("complete"), F.row_number().over(order).cast("long").alias("position"))


def listed(jobs: DataFrame) -> DataFrame:
    """jobs: job_id, folder, created. One record a job, from the earliest folder that holds it, oldest first; ids that are not 32 hex digits are no jobs."""
    order = F.array_position(F.array(*[F.lit(f) for f in FOLDERS]), F.col("folder"))
    rows = jobs.where(F.col("job_id").rlike("^[0-9a-f]{32}$") & (order > 0))
    first = rows.groupBy("job_id").agg(F.min_by(F.struct("folder", "created"), order).alias("r")).select("job_id", "r.*")
    return first.withColumn("position", F.row_number().over(Window.orderBy("created", "job_id")).cast("long"))


def claims(jobs: DataFrame) -> DataFrame:
    """jobs: job_id, workspace, status, created, attempt. The oldest queued job of each workspace where none runs, as it then is."""
    busy = jobs.where("status = 'running'").select("workspace").distinct()
    free = jobs.where("status = 'queued'").join(busy, "workspace", "left_anti")
    first = free.groupBy("workspace").agg(F.min_by(F.struct("job_id", "attempt"), F.struct("created", "job_id")).alias("j"))
    return first.select("workspace", "j.job_id", "j.attempt", F.lit("running").alias("status"))


def retries(jobs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Failed jobs that are asked for, queued once more; asking for another is an error."""
    rows = jobs.join(wanted, "job_id")
    status = F.when(F.col("status") == "failed", "queued").otherwise(F.raise_error(F.concat(F.lit("not failed: "), F.col("job_id").cast("string"))).cast("string"))
    return rows.select("job_id", status.alias("status"), (F.col("attempt") + 1).alias("attempt"))


def recovered(jobs: DataFrame, locks: DataFrame) -> DataFrame:
    """jobs as records, locks: workspace, of those still held. Running jobs whose workspace nobody holds, queued again as they were."""
    lost = jobs.where("status = 'running'").join(locks.select("workspace").distinct(), "workspace", "left_anti")
    return lost.select("job_id", "workspace", "attempt", F.lit("queued").alias("status"))


def failure_issues(failures: DataFrame) -> DataFrame:
    """failures: job_id, stage (null before any), error. Recoverable errors of the stage's category, or fatal ones."""
    table = F.create_map(*[F.lit(x) for kv in STAGE_ISSUES.items() for x in kv])
    known = F.col("stage").isNotNull()
    return failures.select(
        "job_id", F.when(known, F.element_at(table, F.col("stage"))).otherwise("PHYSICAL_EXTRACTION").alias("category"), F.when(known, "ERROR").otherwise("FATAL").alias("severity"),
        F.when(known, F.concat(F.lit("pagemill."), "stage")).otherwise("pagemill.orchestrator").alias("producer"), F.col("error").alias("message"), known.alias("recoverable"),
    )


def status_row(jobs: DataFrame, beats: DataFrame, now: Column, alive_seconds: int = 15) -> DataFrame:
    """One row: whether a worker lives, jobs by status, the oldest queued one. beats: at (null where malformed)."""
    counts = jobs.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in STATUSES], F.min(F.when(F.col("status") == "queued", F.col("created"))).alias("oldest_queued"))
    last = beats.agg(F.max("at").alias("last_beat"))
    return counts.crossJoin(F.broadcast(last)).withColumn("alive", F.coalesce(now - F.col("last_beat") <= alive_seconds, F.lit(False)))  # one row each


def resources(images: DataFrame, suffix: Column) -> tuple[DataFrame, DataFrame]:
    """images: resource, page, n, media_type, content, stage, reason. Records of what was extracted, and warnings for what was not."""
    ok = F.coalesce(F.length("content") > 0, F.lit(False)) & F.col("reason").isNull()
    records = images.where(ok).select("resource", F.concat(F.col("resource").cast("string"), suffix).alias("path"), "media_type", F.length("content").cast("long").alias("byte_length"), F.sha2("content", 256).alias("sha256"))
    said = F.concat(F.lit("embedded image on page "), F.col("page").cast("string"), F.lit(" could not be extracted ("), F.coalesce("stage", F.lit("empty")), F.lit(": "), F.coalesce("reason", F.lit("empty image bytes")), F.lit(")"))
    issues = images.where(~ok).select("resource", F.lit("WARNING").alias("severity"), said.alias("message"), F.lit("empty figure box").alias("fallback"))
    return records, issues


_ULID = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


class Ulids:
    """26 characters: milliseconds, then random bits; within one millisecond each is greater than the one before."""

    def __init__(self) -> None:
        self.last, self.bits = -1, 0

    def __call__(self, milliseconds: int | None = None) -> str:
        at = int(time.time() * 1000) if milliseconds is None else milliseconds
        if at <= self.last:
            at, self.bits = self.last, self.bits + 1
        else:
            self.bits = int.from_bytes(os.urandom(10), "big")
        if self.bits >> 80:
            at, self.bits = at + 1, 0
        self.last = at
        value = at << 80 | self.bits
        return "".join(_ULID[value >> 5 * i & 31] for i in reversed(range(26)))
