"""Tenants, quotas, access rights, lineage and versions, as tables of events."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import scan

RESOURCES = ("storage_tb", "compute_hours", "jobs", "memory_gb", "gpu", "bandwidth_gbps")


def usage(events: DataFrame, tenant: str = "tenant_id", order: list[str] = ["event_id"], amount: str = "amount") -> DataFrame:  # noqa: B006
    """Running use after each event (allocations positive, releases negative),
    never below 0. The clamped running sum is the plain sum less its lowest value
    so far: two scans and no fold, and no window over a tenant's whole history."""
    out = scan.scan(scan.chunked(events, [tenant], order), [tenant], order, {"_s": scan.total(F.col(amount))})
    out = scan.scan(out, [tenant], order, {"_low": scan.lowest(F.col("_s"))})
    return out.select(*events.columns, (F.col("_s") - F.least(F.lit(0.0), F.col("_low"))).alias("used"))


def allocate(events: DataFrame, quotas: DataFrame, resources=RESOURCES, tenant: str = "tenant_id", order: list[str] = ["event_id"]) -> DataFrame:  # noqa: B006
    """Replays requests (``kind`` allocate or release, an amount for each resource)
    against the tenant's quotas, each checked before it is added: ``granted``,
    ``reasons`` (one for each resource that an allocation would take over its quota;
    it then takes nothing of any) and the use after it, ``used_<resource>``. A
    release takes off what is used at most. Null amounts count as 0; a tenant
    without quotas may take nothing.

    Whether a request is granted depends on all before it, so a tenant is replayed in
    order; its requests stream through a task in batches, of which one is held.
    """
    names, kinds = [f"used_{r}" for r in resources], {c: t for c, t in events.dtypes}
    limits = quotas.select(F.col(tenant).alias("_tenant"), *(F.coalesce(F.col(f"quota_{r}"), F.lit(0.0)).alias(f"_q_{r}") for r in resources))
    rows = events.select(*events.columns, *(F.coalesce(F.col(r).cast("double"), F.lit(0.0)).alias(f"_a_{r}") for r in resources))
    rows = rows.join(limits, rows[tenant].eqNullSafe(F.col("_tenant")), "left").drop("_tenant")
    rows = rows.repartition(tenant).sortWithinPartitions(tenant, *order)
    given = list(events.columns)
    n, at, what = len(given), given.index(tenant), given.index("kind")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used = object(), []
        for some in batches:
            tenants, what_ = some.column(at).to_pylist(), some.column(what).to_pylist()
            amounts = list(zip(*(some.column(n + i).to_pylist() for i in range(len(resources)))))
            quota = list(zip(*(some.column(n + len(resources) + i).fill_null(0.0).to_pylist() for i in range(len(resources)))))
            granted, reasons, after = [], [], []
            for t, k, a, q in zip(tenants, what_, amounts, quota):
                if t != now:
                    now, used = t, [0.0] * len(resources)
                over = [f"{r}: {u + x:.2f} > {m:.2f}" for r, u, x, m in zip(resources, used, a, q) if x > 0 and u + x > m] if k == "allocate" else []
                if k == "release":
                    used = [max(0.0, u - x) for u, x in zip(used, a)]
                elif k == "allocate" and not over:
                    used = [u + x for u, x in zip(used, a)]
                granted.append(not over)
                reasons.append(over)
                after.append(used)
            columns = [*some.columns[:n], pa.array(granted), pa.array(reasons, pa.list_(pa.string())), *(pa.array(c, pa.float64()) for c in zip(*after))]
            if granted:
                yield pa.RecordBatch.from_arrays(columns, [*given, "granted", "reasons", *names])

    schema = ", ".join([*(f"`{c}` {t}" for c, t in kinds.items()), "granted boolean", "reasons array<string>", *(f"{c} double" for c in names)])
    return rows.mapInArrow(replay, schema)


def utilisation(used: Column, quota: Column) -> Column:
    return F.least(F.lit(100.0), used / F.greatest(quota, F.lit(1e-9)) * 100)


def exceeded(resources=RESOURCES, used: str = "used_", quota: str = "quota_") -> Column:
    """Reasons, one for each resource whose use is over its quota."""
    one = lambda r: F.when(F.col(used + r) > F.col(quota + r), F.format_string(f"{r}: %.2f > %.2f", F.col(used + r), F.col(quota + r)))
    return F.array_compact(F.array(*map(one, resources)))


def summary(events: DataFrame, quotas: DataFrame) -> DataFrame:
    """Used, quota and remaining of each tenant: all its events in one sum where
    nothing was clamped, else the last of its running use."""
    last = usage(events).groupBy("tenant_id").agg(F.max_by("used", "event_id").alias("used"))
    out = quotas.join(last, "tenant_id", "left").na.fill(0.0, ["used"])
    return out.withColumns({"remaining": F.col("quota") - F.col("used"), "percent": utilisation(F.col("used"), F.col("quota")), "over_quota": F.col("used") > F.col("quota")})


def last_use(events: DataFrame, by: list[str], order: list[str], amount: str = "amount") -> DataFrame:
    """Use of each group after all its events, ``used``: the last of ``usage``, from
    one scan, as the end and the lowest point of the plain running sum tell it."""
    out = scan.scan(scan.chunked(events, by, order), by, order, {"_s": scan.total(F.col(amount))})
    ends = out.groupBy(*by).agg(F.max_by("_s", F.struct(*order)).alias("_end"), F.min("_s").alias("_low"))
    return ends.select(*by, (F.col("_end") - F.least(F.lit(0.0), F.col("_low"))).alias("used"))


def system_status(tenants: DataFrame, events: DataFrame, parts: dict[str, DataFrame], resources=RESOURCES, order: list[str] = ["event_id"]) -> DataFrame:  # noqa: B006
    """A row for each tenant (tenant_id, ..., quota_<resource>): its columns without
    the quotas, ``utilization`` (percent by resource), ``over_quota``, ``issues`` (a
    reason for each resource used beyond its quota), and of each of ``parts`` (users,
    sandboxes, workspaces: tables with tenant_id) how many rows it has there.

    ``events`` are tenant_id, resource, amount and ``order``. Tenants without events
    or parts have 0; null quotas count as 0. Each table is summed up by tenant
    before it meets another, so that no table multiplies a second one's rows.
    """
    known = events.where(F.col("resource").isin(*resources))
    used = last_use(known, ["tenant_id", "resource"], order).groupBy("tenant_id").agg(*(F.coalesce(F.max(F.when(F.col("resource") == x, F.col("used"))), F.lit(0.0)).alias(f"used_{x}") for x in resources))
    out = tenants.join(used, "tenant_id", "left").na.fill(0.0, [f"used_{x}" for x in resources] + [f"quota_{x}" for x in resources])
    for name, df in parts.items():
        out = out.join(df.groupBy("tenant_id").agg(F.count(F.lit(1)).alias(name)), "tenant_id", "left").na.fill(0, [name])
    shares = F.create_map(*(x for c in resources for x in (F.lit(c), utilisation(F.col(f"used_{c}"), F.col(f"quota_{c}")))))
    own = [c for c in tenants.columns if not c.startswith("quota_")]
    issues = exceeded(resources)
    return out.select(*own, shares.alias("utilization"), (F.size(issues) > 0).alias("over_quota"), issues.alias("issues"), *parts)


ROLES = ("admin", "operational", "research", "academic", "viewer")


def new_tenants(requests: DataFrame, tenants: DataFrame, order: list[str], quota: dict[str, float] | None = None) -> DataFrame:
    """Requests (tenant_id, name, role, any quota_<resource>) with what becomes of
    them: an id (the digest of ``order`` where none is asked for), the role (research
    unless said), every quota (the asked one, else that of ``quota``, a research
    tenant's unless given), ``sandbox`` (the name of the one it starts with), and
    ``error``: "unknown role", or "exists" for an id that is there or that a request
    before it in ``order`` took. Only rows without error are tenants.

    Who comes first for an id is told by an aggregate, so an id that is asked for
    again and again is no group in one task.
    """
    quota = RESEARCH_QUOTA if quota is None else quota
    given = requests.withColumns({
        "tenant_id": F.coalesce(F.col("tenant_id"), F.md5(F.concat_ws(":", *(F.col(c).cast("string") for c in order)))),
        "role": F.coalesce(F.lower("role"), F.lit("research")),
    })
    sound = F.col("role").isin(*ROLES)
    first = given.where(sound).groupBy("tenant_id").agg(F.min(F.struct(*order)).alias("_first"))
    taken = tenants.select("tenant_id", F.lit(True).alias("_taken")).distinct()
    out = given.join(first, "tenant_id", "left").join(taken, "tenant_id", "left")
    late = F.col("_taken").isNotNull() | (F.col("_first") != F.struct(*order))
    asked = lambda x: [F.col(f"quota_{x}")] if f"quota_{x}" in requests.columns else []
    quotas = {f"quota_{x}": F.coalesce(*asked(x), F.lit(quota.get(x, 0.0))) for x in RESOURCES}
    error = F.when(~sound, "unknown role").when(late, "exists")
    return out.withColumns(quotas | {"sandbox": F.concat("name", F.lit("_default")), "error": error}).drop("_first", "_taken")


def access(requests: DataFrame, acl: DataFrame, now: Column) -> DataFrame:
    """Requests (request_id, resource_id, user_id, tenant_id, role, permission)
    with ``granted`` and ``via``: an unexpired user entry, the admin role, an
    unexpired tenant entry, or an unexpired public entry for reading. Of several
    grants to one key the latest holds."""
    latest = acl.groupBy("resource_id", "grantee_kind", "grantee").agg(F.max_by(F.struct("permissions", "expires_at"), "granted_at").alias("e"))
    live = latest.where(F.col("e.expires_at").isNull() | (F.col("e.expires_at") > now))

    def entries(kind: str, key: str) -> DataFrame:
        return live.where(F.col("grantee_kind") == kind).select("resource_id", F.col("grantee").alias(key), F.col("e.permissions").alias(f"_{kind}"))

    out = requests.join(entries("user", "user_id"), ["resource_id", "user_id"], "left").join(entries("tenant", "tenant_id"), ["resource_id", "tenant_id"], "left")
    out = out.join(entries("public", "_x").drop("_x"), "resource_id", "left")
    has = lambda kind: F.coalesce(F.array_contains(f"_{kind}", F.col("permission")), F.lit(False))
    via = F.when(has("user"), "user").when(F.col("role") == "admin", "admin").when(has("tenant"), "tenant")
    via = via.when((F.col("permission") == "read") & F.col("user_id").isNotNull() & has("public"), "public")
    return out.select(*requests.columns, via.isNotNull().alias("granted"), via.alias("via"))


def revoke(acl: DataFrame, gone: DataFrame) -> DataFrame:
    return acl.join(gone, ["resource_id", "grantee_kind", "grantee"], "left_anti")


def share_with_members(resource: DataFrame, members: DataFrame) -> DataFrame:
    """Grants of a workspace's resources (workspace_id, resource_id, permissions)
    to the tenants that are its members."""
    out = resource.join(members, "workspace_id")
    return out.select("resource_id", F.lit("tenant").alias("grantee_kind"), F.col("tenant_id").alias("grantee"), "permissions")


def scaled_workers(loads: list[tuple[float, float]], low: int = 16, high: int = 1024, start: int = 16, cooldown: float = 300.0) -> list[int]:
    """Workers after each (time, load): 8 more from 0.75 on, 4 fewer up to 0.25,
    not again within the cooldown. A replay on the driver, of one controller."""
    out, workers, last = [], start, float("-inf")
    for at, load in loads:
        step = 8 if load >= 0.75 else -4 if load <= 0.25 else 0
        target = min(high, max(low, workers + step))
        if target != workers and at - last >= cooldown:
            workers, last = target, at
        out.append(workers)
    return out


# Lineage: edges (source, target)


def lineage(spark, edges: DataFrame, start: DataFrame, direction: str = "upstream", depth: int | None = None) -> DataFrame:
    """Nodes reached from ``start`` (node), with their least number of steps, or
    those of up to ``depth`` steps. Level by level, each a join with what is new,
    so a node is expanded once and a cycle ends of itself; the levels are written
    to the shared folder. The edges are written once; what a level reaches is
    written before it is held against what was seen, so that a small level, as most
    are, goes round by broadcast, and neither edges nor nodes are shuffled for it."""
    from ..plans.scratch import materialise

    folded = 8  # levels after which what was seen becomes one table again
    here, there = ("target", "source") if direction == "upstream" else ("source", "target")
    steps = materialise(edges.select(F.col(here).alias("node"), F.col(there).alias("next")), "lineage")
    seen = new = start.select("node", F.lit(0).alias("steps")).distinct()
    for k in itertools.count(1) if depth is None else range(1, depth + 1):
        found = materialise(steps.join(new.select("node"), "node").select(F.col("next").alias("node")).distinct(), "lineage")
        known = seen.select("node").join(found, "node", "left_semi").distinct()
        new = found.join(known, "node", "left_anti")
        new = materialise(new.withColumn("steps", F.lit(k)), "lineage")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        if k % folded == 0:
            seen = materialise(seen.coalesce(max(1, spark.sparkContext.defaultParallelism)), "lineage")
    return seen


def lineage_sql(edges: str, start: str, depth: int = 16) -> str:
    """The same for shallow graphs as one recursive query (both dialects)."""
    return f"""
    WITH RECURSIVE reach(node, steps) AS (
      SELECT node, 0 FROM {start}
      UNION ALL
      SELECT e.source, r.steps + 1 FROM reach r JOIN {edges} e ON e.target = r.node WHERE r.steps < {depth})
    SELECT node, min(steps) AS steps FROM reach GROUP BY node"""


def connect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    known = nodes.select("node")
    return edges.join(known.withColumnRenamed("node", "source"), "source", "left_semi").join(known.withColumnRenamed("node", "target"), "target", "left_semi")


def versions(changes: DataFrame, by: str = "dataset", order: str = "created_at", kind: str = "change_type") -> DataFrame:
    """Semantic version of each change: the first is 1.0.0; major, minor and
    patch count the changes of their kind since the last of a higher one."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    n = F.row_number().over(W.partitionBy(by).orderBy(order))
    is_kind = lambda k: ((F.col(kind) == k) & (F.col("_n") > 1)).cast("int")
    out = changes.withColumn("_n", n).withColumn("major", 1 + F.sum(is_kind("major")).over(w))
    wm = W.partitionBy(by, "major").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("minor", F.sum(is_kind("minor")).over(wm))
    wp = W.partitionBy(by, "major", "minor").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    out = out.withColumn("patch", F.sum(is_kind("patch")).over(wp))
    return out.withColumn("version", F.concat_ws(".", "major", "minor", "patch")).drop("_n")


def version_diff(a: Column, b: Column) -> tuple[Column, Column]:
    """Variables added and removed from version a to b."""
    return F.array_sort(F.array_except(b, a)), F.array_sort(F.array_except(a, b))


def checksum(df: DataFrame, by: list[str], portable: bool = False) -> DataFrame:
    """Digest of a group's rows whatever their order: counts and sums of row
    hashes, which add up in any order and before the shuffle, as decimals that no
    number of rows overflows. ``portable`` hashes are MD5 digests of the values as
    text (each after a mark, null without one), which other engines know as well."""
    if portable:
        digest = F.md5(F.concat_ws("|", *(F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in df.columns)))
        a, b = (F.conv(F.substring(digest, at, 8), 16, 10) for at in (1, 9))
    else:
        h = F.xxhash64(*df.columns)
        a, b = F.pmod(h, F.lit(1 << 31)), F.shiftrightunsigned(h, 33)
    parts = df.withColumns({"_a": a.cast("decimal(20,0)"), "_b": b.cast("decimal(20,0)")}).groupBy(*by)
    out = parts.agg(F.count(F.lit(1)).alias("n"), F.sum("_a").alias("a"), F.sum("_b").alias("b"))
    return out.select(*by, "n", F.sha2(F.concat_ws(":", "n", "a", "b"), 256).alias("checksum"))


#: What a research tenant gets if nothing else is said.
RESEARCH_QUOTA = {"storage_tb": 10.0, "compute_hours": 1000.0, "jobs": 10.0, "memory_gb": 128.0, "gpu": 0.0, "bandwidth_gbps": 1.0}


def available(requests: DataFrame, state: DataFrame, resources=RESOURCES) -> DataFrame:
    """Requests (tenant_id, request_<resource>...) against tenants (tenant_id,
    active, used_..., quota_...): ``granted`` and the ``reasons`` why not."""
    out = requests.join(state, "tenant_id", "left")
    over = [F.when(F.col(f"used_{r}") + F.col(f"request_{r}") > F.col(f"quota_{r}"), F.lit(f"{r} would exceed its quota")) for r in resources if f"request_{r}" in requests.columns]
    known = F.when(F.col("active").isNull(), F.lit("no such tenant")).when(~F.col("active"), F.lit("tenant is not active"))
    reasons = F.array_compact(F.array(known, *over))
    return out.withColumns({"reasons": reasons, "granted": F.size(reasons) == 0})


def grant(acl: DataFrame, new: DataFrame) -> DataFrame:
    """Grants are appended; of one key the latest holds when access is checked."""
    return acl.unionByName(new)


def is_member(owner: Column, members: Column, who: Column) -> Column:
    return (owner == who) | F.coalesce(F.array_contains(members, who), F.lit(False))


def without_tenant(tenants: DataFrame, tenant: str) -> DataFrame:
    return tenants.where(F.col("tenant_id") != tenant)


def monthly_reset(events: DataFrame, at: int, resources: tuple[str, ...] = ("compute_hours", "jobs")) -> DataFrame:
    """Events that bring the monthly resources of every tenant to 0 at ``at``."""
    left = events.where(F.col("resource").isin(*resources)).groupBy("tenant_id", "resource").agg((-F.sum("amount")).alias("amount"))
    return events.unionByName(left.withColumn("event_id", F.lit(at).cast(dict(events.dtypes)["event_id"])).select(*events.columns))


def granted_by_owners(grants: DataFrame, users: DataFrame) -> DataFrame:
    """Of the grants (resource_id, grantee_kind, grantee, permissions, expires_at,
    granted_at, owner) those that hold: of each key the latest whose owner, where
    one is named, is an administrator or operational."""
    able = users.where(F.lower("role").isin("admin", "operational")).select(F.col("user_id").alias("owner")).distinct()
    good = grants.where("owner IS NULL").unionByName(grants.join(able, "owner", "left_semi").select(*grants.columns))
    rest = [c for c in grants.columns if c not in ("resource_id", "grantee_kind", "grantee")]
    latest = good.groupBy("resource_id", "grantee_kind", "grantee").agg(F.max_by(F.struct(*rest), "granted_at").alias("_g"))
    return latest.select("resource_id", "grantee_kind", "grantee", "_g.*")


def usage_to_quota(used: DataFrame, resources=RESOURCES) -> DataFrame:
    """What tenants use, as a quota of the same size."""
    return used.select("tenant_id", *(F.col(f"used_{r}").alias(f"quota_{r}") for r in resources if f"used_{r}" in used.columns))


def sandboxes(requests: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows of new sandboxes (tenant_id, name, storage_quota_tb, is_isolated):
    without a quota of their own they get the tenant's storage; isolated unless said."""
    out = requests.join(tenants.select("tenant_id", F.col("quota_storage_tb").alias("_q")), "tenant_id")
    path = F.concat_ws("/", F.lit("sandboxes"), "tenant_id", "name")
    return out.select("tenant_id", "name", F.coalesce("storage_quota_tb", "_q").alias("storage_quota_tb"), F.coalesce("is_isolated", F.lit(True)).alias("is_isolated"), path.alias("path"))


def users(requests: DataFrame) -> DataFrame:
    """Rows of new users: a viewer without permissions unless said."""
    none = F.array().cast("array<string>")
    return requests.withColumns({"role": F.coalesce("role", F.lit("viewer")), "permissions": F.coalesce("permissions", none)})


def workspaces(requests: DataFrame) -> DataFrame:
    """Rows of new workspaces: the owner is the first member, the description may be empty."""
    return requests.withColumns({"description": F.coalesce("description", F.lit("")), "members": F.array("owner_tenant_id")})


def track_steps(steps: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of processing steps (step, inputs: an array, output): from each input
    that is a node to the step, and from the step to what it produced."""
    given = steps.select(F.explode("inputs").alias("source"), F.col("step").alias("target"), F.lit("input_to").alias("relation"))
    given = given.join(nodes.select(F.col("node").alias("source")), "source", "left_semi").select("source", "target", "relation")
    return given.unionByName(steps.select(F.col("step").alias("source"), F.col("output").alias("target"), F.lit("produced").alias("relation")))


def version_records(df: DataFrame, changes: DataFrame, by: str = "dataset") -> DataFrame:
    """Versions of each change with the dataset's checksum, size in bytes of its
    values, and variables, as the version table keeps them."""
    sums = checksum(df, [by]).select(by, "checksum")
    sizes = df.groupBy(by).agg((F.count("value") * 8).alias("size_bytes"), F.array_sort(F.collect_set("variable")).alias("variables"))
    return versions(changes, by).join(sums, by, "left").join(sizes, by, "left")


def latest_versions(changes: DataFrame, by: str = "dataset", order: str = "created_at", kind: str = "change_type") -> DataFrame:
    """The last version of each dataset, without numbering those before it: major
    changes are counted, minor ones after the last major, patches after the last of
    either, each in one aggregate, so a dataset of many versions is no window. A
    dataset's row, one for each, is looked up by its hash: no change is sorted."""
    at = F.col(order)
    ends = changes.groupBy(by).agg(F.min(at).alias("_first"), F.max(at).alias("_end"), F.count(F.lit(1)).alias("n_versions"))
    later = changes.join(ends.select(by, "_first").hint("shuffle_hash"), by).where(at > F.col("_first"))
    when = lambda k: F.when(F.col(kind) == k, at)
    major = later.groupBy(by).agg(F.count(when("major")).alias("_major"), F.max(when("major")).alias("_last_major"))
    minor = later.join(major.hint("shuffle_hash"), by).where(F.col("_last_major").isNull() | (at > F.col("_last_major")))
    minor = minor.groupBy(by).agg(F.count(when("minor")).alias("_minor"), F.max(when("minor")).alias("_last_minor"))
    patch = later.join(major.hint("shuffle_hash"), by).join(minor.hint("shuffle_hash"), by).where((F.col("_last_major").isNull() | (at > F.col("_last_major"))) & (F.col("_last_minor").isNull() | (at > F.col("_last_minor"))))
    patch = patch.groupBy(by).agg(F.count(when("patch")).alias("_patch"))
    out = ends
    for counts in (major.select(by, "_major"), minor.select(by, "_minor"), patch):
        out = out.join(counts.hint("shuffle_hash"), by, "left")
    out = out.na.fill(0, ["_major", "_minor", "_patch"])
    return out.select(by, F.col("_end").alias(order), "n_versions", F.concat_ws(".", F.col("_major") + 1, "_minor", "_patch").alias("version"))


def version_at(records: DataFrame, number: str, by: str = "dataset", order: str = "created_at") -> DataFrame:
    """The first record of each dataset with exactly this version."""
    first = F.row_number().over(W.partitionBy(by).orderBy(order))
    return records.where(F.col("version") == number).withColumn("_r", first).where("_r = 1").drop("_r")
