"""Workspace fleets as tables (WSP-01 to WSP-14), carriers (CAR-01 to CAR-03) and training sites (HAM-01 to HAM-03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scans import Scan
from .adaptation import semver


def lock_drift(manifest: DataFrame, lock: DataFrame, heads: DataFrame) -> DataFrame:
    """WSP-01. manifest(name) with locked, head and drift: both there and different."""
    met = manifest.join(lock.select("name", F.col("rev").alias("locked")), "name", "left").join(heads.select("name", F.col("rev").alias("head")), "name", "left")
    return met.withColumn("drift", F.coalesce((F.col("locked") != "") & (F.col("head") != "") & (F.col("locked") != F.col("head")), F.lit(False)))


def repo_status(manifest: DataFrame, checkouts: DataFrame) -> DataFrame:
    """WSP-02. MISSING, GIT or LOCAL by checkouts(name, is_git)."""
    met = manifest.join(checkouts.select("name", "is_git", F.lit(True).alias("there")), "name", "left")
    return met.withColumn("status", F.when(F.col("there").isNull(), "MISSING").when(F.col("is_git"), "GIT").otherwise("LOCAL")).drop("there", "is_git")


def select_targets(manifest: DataFrame, only: list[str] | None = None, role: str | None = None, every: bool = False) -> DataFrame:
    """WSP-03. Names in only; else with every all components; else those of a role; else none."""
    if only:
        return manifest.where(F.col("name").isin(*only))
    if every:
        return manifest.where("role = 'component'")
    return manifest.where(F.col("role") == role) if role else manifest.where(F.lit(False))


def task_contract(repos: DataFrame, files: DataFrame, task: str) -> DataFrame:
    """WSP-04. repos(name) with contract: the file of files(name, path) that comes first in the task contract's order, or no contract."""
    order = ["Makefile", "justfile", "Taskfile.yml", "Taskfile.yaml", f"scripts/{task}.sh", f"scripts/{task}.py"]
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("path"))
    best = files.withColumn("p", place).where("p > 0").groupBy("name").agg(F.min_by("path", "p").alias("contract"))
    return repos.join(best, "name", "left").withColumn("contract", F.coalesce("contract", F.lit("no contract")))


def run_rollup(results: DataFrame) -> DataFrame:
    """WSP-05. Of (batch, position, outcome, code): exit code is the last non-zero in order, where missing and no contract
    are 2; and how many were ok, failed, missing and without a contract, each result in one count. Results without
    a position have no place in the order. Of results at the same position, the least of a column place counts, if there is one."""
    away = F.col("outcome").isin("missing", "no contract")
    r = results.withColumn("c", F.when(away, 2).otherwise(F.col("code")))
    counts = {"n_ok": ~away & (F.col("c") == 0), "n_failed": ~away & (F.col("c") != 0), "n_missing": F.col("outcome") == "missing", "n_no_contract": F.col("outcome") == "no contract"}
    last = F.when((F.col("c") != 0) & F.col("position").isNotNull(), F.struct(-F.col("position"), *(["place"] if "place" in r.columns else [])))
    return r.groupBy("batch").agg(F.coalesce(F.min_by("c", last), F.lit(0)).alias("exit_code"), *(F.count_if(c).alias(n) for n, c in counts.items()))


def inventory_rows(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """WSP-06. (name, role, rev, license, capabilities) of each repository: the locked revision or null, the license hint or unknown, its capabilities sorted."""
    met = manifest.join(lock.select("name", "rev"), "name", "left")
    return met.select("name", "role", "rev", F.coalesce("license", F.lit("unknown")).alias("license"), F.sort_array(F.array_distinct("capabilities")).alias("capabilities"))


def inventory_report(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """WSP-06. Repositories by role and license hint, with how many are locked and their distinct capabilities."""
    met = manifest.join(lock.select("name", F.col("rev").alias("locked")), "name", "left")
    by = [F.col("role"), F.coalesce("license", F.lit("unknown")).alias("license")]
    # a null marks the repository itself beside its capabilities; counts combine before the shuffle, no array is gathered
    each = met.select(*by, "locked", F.explode(F.concat(F.coalesce("capabilities", F.array().cast("array<string>")), F.array(F.lit(None).cast("string")))).alias("c"))
    return each.groupBy("role", "license").agg(F.count_if(F.col("c").isNull()).alias("n"), F.count_if(F.col("c").isNull() & F.col("locked").isNotNull()).alias("n_locked"), F.count_distinct("c").cast("int").alias("n_capabilities"))


def capability_match(adapters: DataFrame, provided: DataFrame) -> DataFrame:
    """WSP-07. (name, missing) of adapters(name, required_capabilities) against provided(name, capabilities)."""
    met = adapters.join(provided, "name", "left")
    lacks = F.array_except("required_capabilities", F.coalesce("capabilities", F.array().cast("array<string>")))
    return met.select("name", F.array_join(F.sort_array(lacks), ",").alias("missing")).where("missing <> ''")


def dependency_violations(edges: DataFrame, allowed: DataFrame) -> DataFrame:
    """WSP-08. edges(src, dst, src_role, dst_role) whose roles are no allowed(src_role, dst_role) direction."""
    return edges.join(allowed, ["src_role", "dst_role"], "left_anti")


def semver_satisfies(deps: DataFrame, versions: DataFrame) -> DataFrame:
    """WSP-09. deps(name, needs as >=x.y.z) with newest of versions(name, version), numerically, and ok."""
    newest = versions.groupBy("name").agg(F.max_by("version", semver(F.col("version"))).alias("newest"))
    least = F.regexp_replace("needs", r"^\s*>=\s*", "")
    return deps.join(newest, "name", "left").withColumn("ok", F.coalesce(semver(F.col("newest")) >= semver(least), F.lit(False)))


def reference_counts(files: DataFrame, terms: list[str]) -> DataFrame:
    """WSP-10. (term, n): files(path, text) that mention each of a few given terms, one pass."""
    hits = F.filter(F.array(*[F.when(F.contains(F.col("text"), F.lit(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
    return files.select("path", F.explode(hits).alias("term")).groupBy("term").agg(F.count_distinct("path").alias("n"))


def file_inventory(files: DataFrame) -> DataFrame:
    """WSP-11. Of (path, kind, bytes): files, bytes and empty files by kind and extension."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return files.groupBy("kind", ext.alias("extension")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"), F.count_if(F.col("bytes") == 0).alias("n_empty"))


def license_gate(inventory: DataFrame, allowed: list[str]) -> DataFrame:
    """WSP-12. (name, outcome): not allowed, or no hint."""
    out = F.when(F.col("license").isNull(), "no hint").when(~F.col("license").isin(*allowed), "not allowed")
    return inventory.select("name", out.alias("outcome")).where("outcome IS NOT NULL")


#: Directory of each role; fixed values of the layout.
ROLE_DIRS = {"component": "components/", "adapter": "adapters/", "third_party": "third_party/"}


def role_path_check(manifest: DataFrame) -> DataFrame:
    """WSP-13. Repositories whose local_path is not under their role's directory; other roles are not judged."""
    bad = F.lit(False)
    for role, d in ROLE_DIRS.items():
        bad = bad | ((F.col("role") == role) & ~F.col("local_path").startswith(d))
    return manifest.where(bad)


def lock_verify(manifest: DataFrame, lock: DataFrame) -> DataFrame:
    """WSP-14. (name, problem): not locked, or locked but not in the manifest."""
    met = manifest.select("name", F.lit(1).alias("m")).join(lock.select("name", F.lit(1).alias("l")), "name", "full_outer")
    return met.select("name", F.when(F.col("l").isNull(), "not locked").when(F.col("m").isNull(), "not in manifest").alias("problem")).where("problem IS NOT NULL")


def carrier_digest():
    """sha256 of the four unsigned fields of a carrier, as a text with fixed separators."""
    return F.sha2(F.concat_ws("|", "type", F.col("time").cast("string"), F.col("payload"), F.col("dryRun").cast("string")).cast("binary"), 256)


def carrier_integrity(carriers: DataFrame) -> DataFrame:
    """CAR-01. One row (verified, failed) of carriers(type, time, payload, dryRun, digest); rows with a missing field fail."""
    whole = F.col("type").isNotNull() & F.col("time").isNotNull() & F.col("payload").isNotNull() & F.col("dryRun").isNotNull()
    good = F.coalesce(whole & (F.col("digest") == carrier_digest()), F.lit(False))
    return carriers.agg(F.count_if(good).alias("verified"), F.count_if(~good).alias("failed"))


def lifecycle_sessions(carriers: DataFrame, by: str, first: str = "a2a.author.propose", last: str = "a2a.done") -> DataFrame:
    """CAR-02. Sessions of (by, type, time, id): opened by first, closed by last; steps, whether done, seconds. Events before the first opening have session 0."""
    s = Scan(carriers, [by], ["time", "id"]).values(sums={"session": (F.col("type") == first).cast("long")}).result()
    end = F.min(F.when(F.col("type") == last, F.col("time")))
    s = s.groupBy(by, "session").agg(F.count("*").alias("n_steps"), F.min("time").alias("opened"), end.alias("closed"), F.count_distinct("type").alias("n_types"))
    return s.withColumn("seconds", F.unix_timestamp("closed") - F.unix_timestamp("opened"))


def dryrun_rollup(carriers: DataFrame) -> DataFrame:
    """CAR-03. Events by type, dry and live."""
    return carriers.groupBy("type").agg(F.count_if("dryRun").alias("dry"), F.count_if(~F.col("dryRun")).alias("live"))


def split_brain(promotions: DataFrame, grants: DataFrame) -> DataFrame:
    """HAM-01. (epoch, n_sites) promoted by several sites of promotions(epoch, site) without a quorum grant of grants(epoch)."""
    return promotions.groupBy("epoch").agg(F.count_distinct("site").alias("n_sites")).where("n_sites > 1").join(grants.select("epoch").distinct(), "epoch", "left_anti")


def passive_violations(actions: DataFrame, roles: DataFrame) -> DataFrame:
    """HAM-02. actions(site, at, action, id) by a site whose last role of roles(site, at, role) by then is passive; a role counts from its own time on."""
    a = actions.select("site", "at", F.lit(1).alias("o"), "action", "id", F.lit(None).cast("string").alias("role"))
    r = roles.select("site", "at", F.lit(0).alias("o"), F.lit(None).cast("string").alias("action"), F.lit(None).cast(actions.schema["id"].dataType).alias("id"), "role")
    u = Scan(a.unionByName(r), ["site"], ["at", "o", "role"]).values(lasts={"now": F.col("role")}).result()
    return u.where("o = 1 AND now = 'passive' AND action IN ('train', 'promote')").select("site", "at", "action", "id")


def failovers(roles: DataFrame) -> DataFrame:
    """HAM-03. (site, at, from_role, role) where a site's role flips. Roles of equal times stand in text order."""
    return Scan(roles.select("site", "at", "role"), ["site"], ["at", "role"]).values(lags={"from_role": F.col("role")}).result().where("from_role IS NOT NULL AND from_role <> role").select("site", "at", "from_role", "role")
