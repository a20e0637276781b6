"""Run bundles: what an experiment was given and what came of it, with checksums; and reading them again."""

from __future__ import annotations

import hashlib
import json
import platform
import resource
import threading
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from importlib.metadata import PackageNotFoundError, version
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partyframe.operators.audit import row_digest
from partyframe.sources.files import file_manifest

# Fixed members of a run bundle.
DOCUMENTS = ("config", "dataset_provenance", "linkage_manifest", "environment", "metrics")
TABLES = {"predictions": "parquet", "training_history": "csv", "communication": "csv", "feature_provenance": "csv"}
MANIFEST = "run_manifest"


def new_run_id() -> str:
    """Time and a random part, so that two runs never share one."""
    return f"run-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:12]}"


def json_digest(value) -> str:
    """SHA-256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


#: Packages whose versions a run records.
PACKAGES = ("pyspark", "pyarrow", "numpy", "pandas")


def dependency_versions(packages: tuple[str, ...] = PACKAGES) -> dict[str, str | None]:
    """The installed version of each package; None for one that is not there."""
    out = {}
    for name in packages:
        try:
            out[name] = version(name)
        except PackageNotFoundError:
            out[name] = None
    return out


def code_version(folder: str | None = None) -> str | None:
    """The commit that the code was taken from, read from its repository's files; None where there is none."""
    here = Path(folder or __file__).resolve()
    for place in (here, *here.parents):
        git = place / ".git"
        if git.is_dir():
            head = (git / "HEAD").read_text().strip()
            if not head.startswith("ref: "):
                return head
            name = head[5:]
            if (git / name).exists():
                return (git / name).read_text().strip()
            packed = (git / "packed-refs").read_text().splitlines() if (git / "packed-refs").exists() else []
            return next((line.split(" ")[0] for line in packed if line.endswith(f" {name}")), None)
    return None


def environment(seed: int) -> dict:
    facts = {"seed": seed, "python": platform.python_version(), "spark": pyspark.__version__, "system": platform.system(), "machine": platform.machine()}
    return facts | {"dependency_versions": dependency_versions(), "code_version": code_version()}


def write_document(spark: SparkSession, path: str, value: dict) -> None:
    """One JSON document, written by Spark so that any store will do; an existing one is an error."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)


def read_document(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect()))


def write_run(spark: SparkSession, root: str, seed: int, documents: dict[str, dict], tables: dict[str, DataFrame], run_id: str | None = None, datasets: dict[str, DataFrame] | None = None) -> str:
    """The folder of a new bundle: DOCUMENTS (all but the environment are given), TABLES, and a manifest with the size and
    SHA-256 of every file, the versions of code and packages, and the rows and digest of each of the datasets that the run
    was given. A missing or unknown member, or a run id that is taken, is refused."""
    wanted = {*DOCUMENTS} - {"environment"}
    if set(documents) != wanted or set(tables) != set(TABLES):
        raise ValueError(f"a run has the documents {sorted(wanted)} and the tables {sorted(TABLES)}")
    run_id = run_id or new_run_id()
    folder = f"{root}/{run_id}"
    given = {name: row_digest(df).first().asDict() for name, df in (datasets or {}).items()}
    facts = environment(seed)
    for name, value in {**documents, "environment": facts}.items():
        write_document(spark, f"{folder}/{name}.json", value)
    for name, kind in TABLES.items():
        writer = tables[name].write
        writer.parquet(f"{folder}/{name}.parquet") if kind == "parquet" else writer.option("header", True).csv(f"{folder}/{name}.csv")
    files = member_files(spark, folder).collect()  # a bundle has a few files for each member
    manifest = {"run_id": run_id, "created_at": datetime.now(UTC).isoformat(), "seed": seed, "configuration_hash": json_digest(documents["config"]), "dataset_provenance_hash": json_digest(documents["dataset_provenance"])}
    manifest |= {"dataset_hashes": given, "dependency_versions": facts["dependency_versions"], "code_version": facts["code_version"]}
    write_document(spark, f"{folder}/{MANIFEST}.json", manifest | {"artifacts": {r.name: {"bytes": r.bytes, "sha256": r.sha256} for r in files}})
    return folder


def member_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the data files of a bundle, the manifest left out; name is the path below the folder."""
    name = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return file_manifest(spark, folder).select(name.alias("name"), "bytes", "sha256").where(~F.startswith("name", F.lit(f"{MANIFEST}.")))


def changed_files(spark: SparkSession, folder: str) -> DataFrame:
    """(name, problem) of files that are missing, new or different from what the manifest says."""
    stated = read_document(spark, f"{folder}/{MANIFEST}.json")["artifacts"]
    known = spark.createDataFrame([(k, v["sha256"]) for k, v in stated.items()], "name string, stated string")
    both = member_files(spark, folder).join(known, "name", "full_outer")
    problem = F.when(F.col("sha256").isNull(), "missing").when(F.col("stated").isNull(), "unknown").when(F.col("sha256") != F.col("stated"), "changed")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


def changed_datasets(spark: SparkSession, folder: str, datasets: dict[str, DataFrame]) -> list[str]:
    """The names of datasets that are missing, unknown to the run, or no longer what it was given."""
    stated = read_document(spark, f"{folder}/{MANIFEST}.json").get("dataset_hashes", {})
    now = {name: row_digest(df).first().asDict() for name, df in datasets.items()}
    return sorted(name for name in stated.keys() | now.keys() if stated.get(name) != now.get(name))


def read_run(spark: SparkSession, folder: str) -> tuple[dict[str, dict], dict[str, DataFrame]]:
    """(documents, tables) of a bundle; a member that is not there raises FileNotFoundError."""
    documents, tables = {}, {}
    try:
        for name in (*DOCUMENTS, MANIFEST):
            documents[name] = read_document(spark, f"{folder}/{name}.json")
        for name, kind in TABLES.items():
            tables[name] = spark.read.parquet(f"{folder}/{name}.parquet") if kind == "parquet" else spark.read.option("header", True).csv(f"{folder}/{name}.csv")
    except pyspark.errors.AnalysisException as error:
        raise FileNotFoundError(f"{folder} lacks a member of a run: {error.getMessage() or error}") from error
    return documents, tables


def write_study(spark: SparkSession, root: str, name: str, results: DataFrame, seed: int, config: dict, predictions: DataFrame, history: DataFrame, communication: DataFrame, provenance: DataFrame) -> str:
    """A study as a run: its result rows, one for each condition and few, are the metrics."""
    documents = {"config": {"study": name, **config}, "dataset_provenance": {"study": name}, "linkage_manifest": {}, "metrics": {"rows": [r.asDict() for r in results.collect()]}}
    return write_run(spark, root, seed, documents, {"predictions": predictions, "training_history": history, "communication": communication, "feature_provenance": provenance})


def main_results(spark: SparkSession, folders: dict[str, str], metrics: tuple[str, ...] = ("roc_auc", "pr_auc", "f1")) -> DataFrame:
    """(run, metrics...): the main table over named runs; a metric that a run lacks is NULL."""
    rows = [(name, *(float(x) if (x := found.get(m)) is not None else None for m in metrics)) for name, folder in folders.items() for found in [read_document(spark, f"{folder}/metrics.json")]]
    return spark.createDataFrame(rows, "run string, " + ", ".join(f"{m} double" for m in metrics))


class ResourceSampler(threading.Thread):
    """Looks at the resident size of the driver's Python every few milliseconds; peak and last are bytes."""

    def __init__(self, every: float = 0.02):
        super().__init__(daemon=True)
        self.every, self.ended, self.samples, self.peak, self.last = every, threading.Event(), 0, 0, 0

    def look(self) -> None:
        with open("/proc/self/statm") as f:
            self.last = int(f.read().split()[1]) * resource.getpagesize()
        self.samples, self.peak = self.samples + 1, max(self.peak, self.last)

    def run(self) -> None:
        while not self.ended.wait(self.every):
            self.look()

    def __enter__(self) -> ResourceSampler:
        self.look()
        self.start()
        return self

    def __exit__(self, *_) -> None:
        self.ended.set()
        self.join()
        self.look()


def measured(action: Callable[[], object], spark: SparkSession | None = None) -> tuple[object, dict[str, float]]:
    """What an action returns, its wall time, and the largest resident size of the driver's Python while it ran, sampled by a
    thread. With a session also what it asked of Spark: the jobs, stages and tasks of a job group of its own (the caller's
    group is set again afterwards); stages whose shuffle files were still there count without tasks."""
    group, name = f"measured-{uuid.uuid4().hex}", "spark.jobGroup.id"
    before = spark.sparkContext.getLocalProperty(name) if spark else None
    if spark:
        spark.sparkContext.setJobGroup(group, "measured")
    try:
        with ResourceSampler() as sampler:
            began = time.perf_counter()
            out = action()
            cost = {"seconds": time.perf_counter() - began}
    finally:
        if spark:
            spark.sparkContext.setLocalProperty(name, before)
    cost |= {"peak_rss_bytes": float(sampler.peak), "rss_samples": sampler.samples}
    if spark:
        tracker = spark.sparkContext.statusTracker()
        jobs = [j for j in (tracker.getJobInfo(k) for k in tracker.getJobIdsForGroup(group)) if j]
        stages = [x for x in (tracker.getStageInfo(k) for j in jobs for k in j.stageIds) if x]
        cost |= {"jobs": len(jobs), "stages": len(stages), "tasks": sum(x.numCompletedTasks for x in stages)}
    return out, cost


def scaling_grid(spark: SparkSession, sizes: list[int], make: Callable[[int], DataFrame], train: Callable[[DataFrame], object]) -> DataFrame:
    """(rows, seconds, peak_rss_bytes, jobs, stages, tasks): a model trained on frames of each size, one after the other."""
    rows = []
    for n in sizes:
        df = make(n)
        _, cost = measured(lambda df=df: train(df), spark)
        rows.append((n, cost["seconds"], cost["peak_rss_bytes"], cost["jobs"], cost["stages"], cost["tasks"]))
    return spark.createDataFrame(rows, "rows long, seconds double, peak_rss_bytes double, jobs int, stages int, tasks int")
