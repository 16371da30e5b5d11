"""Run evaluation (QES-01 to QES-12)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import Scan

OUTCOME = ["run_id", "type", "artifact", "outcome", "detail"]


def assert_counts_min(counts: DataFrame, assertions: DataFrame) -> DataFrame:
    """QES-01. assertions(run_id, artifact, min) against counts(run_id, artifact, n): a topic without rows counts 0."""
    met = assertions.join(counts, ["run_id", "artifact"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    outcome = F.when(F.col("n") >= F.col("min"), "passed").otherwise("failed")
    return met.select("run_id", F.lit("counts_min").alias("type"), "artifact", outcome.alias("outcome"), F.concat_ws(" of ", F.col("n").cast("string"), F.col("min").cast("string")).alias("detail"))


def assert_match_golden(actual: DataFrame, golden: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """QES-02. One row (outcome, missing, extra): equal as multisets after dropping ignored columns."""
    cols = [c for c in golden.columns if c not in (ignore or [])]
    extra = actual.select(cols).exceptAll(golden.select(cols)).agg(F.count("*").alias("extra"))
    missing = golden.select(cols).exceptAll(actual.select(cols)).agg(F.count("*").alias("missing"))
    both = missing.join(F.broadcast(extra))  # one row each
    return both.select(F.when((F.col("missing") == 0) & (F.col("extra") == 0), "passed").otherwise("failed").alias("outcome"), "missing", "extra")


def assert_metric_threshold(metrics: DataFrame, assertions: DataFrame) -> DataFrame:
    """QES-03. assertions(run_id, artifact, gte) against metrics(run_id, artifact, value); a missing metric is skipped."""
    met = assertions.join(metrics, ["run_id", "artifact"], "left")
    outcome = F.when(F.col("value").isNull(), "skipped").when(F.col("value") >= F.col("gte"), "passed").otherwise("failed")
    return met.select("run_id", F.lit("metric_threshold").alias("type"), "artifact", outcome.alias("outcome"), F.format_string("%.6f", "value").alias("detail"))


def evaluate_runspec(*outcomes: DataFrame) -> DataFrame:
    """QES-04. Run records of assertion outcomes: status is failed if one failed; assertions sorted, of a bounded number a run."""
    rows = reduce(DataFrame.unionByName, [o.select(OUTCOME) for o in outcomes])
    one = F.struct("type", "artifact", "outcome", "detail")
    return rows.groupBy("run_id").agg(F.when(F.bool_or(F.col("outcome") == "failed"), "failed").otherwise("completed").alias("status"), F.sort_array(F.collect_list(one)).alias("assertions"), F.count_if(F.col("outcome") == "passed").alias("n_passed"), F.count_if(F.col("outcome") == "skipped").alias("n_skipped"))


def provenance_gate(runs: DataFrame, keys: tuple[str, ...] = ("git", "images", "schemas", "offsets")) -> DataFrame:
    """QES-05. runs(status, provenance as JSON text) with allowed: completed, and every key there and not false; {} and null pass."""
    have = F.coalesce(F.json_object_keys("provenance"), F.array().cast("array<string>"))
    good = F.col("status") == "completed"
    for k in keys:
        good = good & F.array_contains(have, k) & ~F.coalesce(F.get_json_object("provenance", f"$.{k}") == "false", F.lit(False))
    return runs.withColumn("allowed", F.coalesce(good, F.lit(False)))


def capture_provenance(events: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """QES-06. Of (run_id, topic, partition, offset, schema_version): offsets and versions seen, one row a run, topic and partition.

    With runs(run_id, pipelines map), each row has its run's pipelines; null for a run that is not there.
    """
    seen = events.groupBy("run_id", "topic", "partition").agg(F.min("offset").alias("first_offset"), F.max("offset").alias("last_offset"), F.count("*").alias("n"), F.array_sort(F.collect_set("schema_version")).alias("schema_versions"))
    return seen if runs is None else seen.join(runs.select("run_id", "pipelines"), "run_id", "left")


def diff_artifacts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """QES-07. (key, change, columns) of rows added, removed or changed between two versions of a table with unique keys."""
    cols = [c for c in left.columns if c != key]
    a = left.select(key, F.struct(*cols).alias("l"))
    b = right.select(key, F.struct(*cols).alias("r"))
    met = a.join(b, key, "full_outer")
    changed = F.filter(F.array(*[F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), F.lit(c)) for c in cols]), lambda x: x.isNotNull())
    change = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return met.select(key, change.alias("change"), F.when(change == "changed", F.array_join(changed, ",")).alias("columns")).where("change IS NOT NULL")


def run_history(runs: DataFrame) -> DataFrame:
    """QES-08. Of (run_id, scenario, status, started_at): place in the scenario's history, whether the latest, pass rate so far, flip from the run before. A scenario with most of the runs is scanned in even parts."""
    ok = F.col("status") == "completed"
    r = runs.select("scenario", "run_id", "status", "started_at")
    order = ["started_at", "run_id"]
    r = Scan(r, ["scenario"], order).values(number="seq", final="latest", sums={"passed": ok.cast("long")}, lags={"before": F.col("status")}).result()
    flip = F.col("before").isNotNull() & ((F.col("before") == "completed") != ok)
    return r.select("scenario", "run_id", "status", F.col("seq").cast("int").alias("seq"), "latest", (F.col("passed") / F.col("seq")).alias("pass_rate"), flip.alias("flip"))


def fingerprint(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """QES-10. Order-insensitive content hash of each group: row count and the sum of 60-bit row hashes."""
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in cols]).cast("binary"))
    n = F.conv(F.substring(row, 1, 15), 16, 10).cast("decimal(38,0)")
    return df.groupBy(*(by or [])).agg(F.count("*").alias("n_rows"), F.sum(n).cast("string").alias("fp"))


def determinism_check(runs: DataFrame, prints: DataFrame) -> DataFrame:
    """QES-09. runs(run_id, spec_hash, offsets) whose equals in both have differing fingerprints of prints(run_id, artifact, fp)."""
    met = runs.join(prints, "run_id")
    return met.groupBy("spec_hash", "offsets", "artifact").agg(F.count_distinct("fp").alias("n_fp"), F.count_distinct("run_id").alias("n_runs")).where("n_fp > 1")


def pipeline_versions(runs: DataFrame, names: list[str]) -> DataFrame:
    """QES-11. runs(run_id, pipelines map) as one row a run with a column for each named pipeline's version."""
    return runs.select("run_id", F.explode("pipelines").alias("name", "version")).groupBy("run_id").pivot("name", names).agg(F.first("version"))


def version_changes(runs: DataFrame) -> DataFrame:
    """QES-11. Of runs(run_id, scenario, started_at, pipelines map): (scenario, name, run_id, before, version) where a pipeline's version differs from that of the scenario's run before it that has the pipeline."""
    each = runs.select("scenario", "run_id", "started_at", F.explode("pipelines").alias("name", "version"))
    found = Scan(each, ["scenario", "name"], ["started_at", "run_id"]).values(lags={"before": F.col("version")}).result()
    return found.where("before IS NOT NULL AND NOT before <=> version").select("scenario", "name", "run_id", "before", "version")


def run_duration(runs: DataFrame) -> DataFrame:
    """QES-12. (run_id, status, seconds) of each run: from start to finish, null while it is running or a time is missing."""
    took = F.unix_timestamp("finished_at") - F.unix_timestamp("started_at")
    return runs.select("run_id", "status", F.when(F.col("status") != "running", took).alias("seconds"))


def run_durations(runs: DataFrame, as_of: str, limit_s: int) -> DataFrame:
    """QES-12. By status: runs, mean seconds of the finished ones, and runs still open limit_s after their start."""
    took = F.when(F.col("status") != "running", F.unix_timestamp("finished_at") - F.unix_timestamp("started_at"))
    late = (F.col("status") == "running") & (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("started_at") > limit_s)
    return runs.groupBy("status").agg(F.count("*").alias("n"), F.avg(took).alias("mean_s"), F.max(took).alias("max_s"), F.count_if(late).alias("n_late"))


def runspec_hash(**fields: Column) -> Column:
    """QES-10. sha256 of a run spec's canonical text: name=value lines by name, nulls left out."""
    return F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{n}="), fields[n].cast("string")) for n in sorted(fields)]).cast("binary"), 256)
