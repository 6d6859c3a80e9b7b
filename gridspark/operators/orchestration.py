"""Task graphs, parameter sweeps and Bayesian optimisation."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.special import normal_quantile


@dataclass
class Task:
    name: str
    run: Callable[..., Any]
    needs: list[str] = field(default_factory=list)
    priority: int = 0
    retries: int = 0
    checkpoint: bool = False


class Workflow:
    """Tasks of one graph; a single table of edges, so late dependencies are safe."""

    def __init__(self, tasks: Iterable[Task] = ()):
        self.tasks = {t.name: t for t in tasks}

    def add(self, task: Task) -> None:
        self.tasks[task.name] = task

    def depend(self, task: str, on: str) -> None:
        if on not in self.tasks[task].needs:
            self.tasks[task].needs.append(on)

    def remove(self, name: str) -> None:
        self.tasks.pop(name)
        for t in self.tasks.values():
            t.needs = [n for n in t.needs if n != name]

    def problems(self) -> list[str]:
        found = [f"{t.name}: {n} is missing" for t in self.tasks.values() for n in t.needs if n not in self.tasks]
        found += [f"{t.name}: nothing to run" for t in self.tasks.values() if not callable(t.run)]
        try:
            if not found:
                self.order()
        except ValueError as e:
            found.append(str(e))
        return found

    def ready(self, done: set[str]) -> list[str]:
        free = [t for t in self.tasks.values() if t.name not in done and set(t.needs) <= done]
        return [t.name for t in sorted(free, key=lambda t: (-t.priority, t.name))]

    def order(self) -> list[str]:
        done: list[str] = []
        while len(done) < len(self.tasks):
            free = self.ready(set(done))
            if not free:
                raise ValueError("the tasks depend on each other in a circle")
            done.append(free[0])
        return done

    def execute(self, store: Checkpoints | None = None, wait: float = 0.0) -> dict[str, dict]:
        """Runs the tasks in order and stops at the first that fails for good."""
        results: dict[str, dict] = {}
        for name in self.order():
            task = self.tasks[name]
            kept = store.latest(name) if store and task.checkpoint else None
            began = time.time()
            for attempt in range(task.retries + 1):
                try:
                    value = kept if kept is not None else task.run(*(results[n]["value"] for n in task.needs))
                    results[name] = {"status": "completed", "value": value, "checksum": digest(value), "seconds": time.time() - began}
                    break
                except Exception as e:
                    results[name] = {"status": "failed", "value": None, "error": str(e), "seconds": time.time() - began}
                    if attempt < task.retries:
                        time.sleep(wait)
            if results[name]["status"] == "failed":
                break
            if store and task.checkpoint and kept is None:
                store.save(name, value)
        return results

    def levels(self, spark: SparkSession) -> DataFrame:
        """Each task with the length of its longest chain of needs."""
        depth: dict[str, int] = {}
        for name in self.order():
            depth[name] = max((depth[n] + 1 for n in self.tasks[name].needs), default=0)
        return spark.createDataFrame(list(depth.items()), "task string, level int")


def digest(value: Any) -> str:
    raw = value.tobytes() if isinstance(value, np.ndarray) else json.dumps(value, sort_keys=True, default=str).encode()
    return hashlib.sha256(raw).hexdigest()


class Checkpoints:
    """Task states as JSON rows of a Parquet table, appended, never pickled."""

    SCHEMA = "id string, task string, workflow string, step long, saved_at double, state string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def save(self, task: str, state: Any, workflow: str = "", step: int = 0, at: float | None = None) -> str:
        text = json.dumps(state, sort_keys=True, default=str)
        key = hashlib.sha256(f"{text}{task}{step}".encode()).hexdigest()[:16]
        row = [(key, task, workflow, step, time.time() if at is None else at, text)]
        self.spark.createDataFrame(row, self.SCHEMA).write.mode("append").parquet(self.path)
        return key

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception:
            return self.spark.createDataFrame([], self.SCHEMA)

    def latest(self, task: str) -> Any:
        row = self.table().where(F.col("task") == task).agg(F.max_by("state", F.struct("saved_at", "step"))).first()[0]
        return None if row is None else json.loads(row)

    def list(self, task: str | None = None, workflow: str | None = None) -> DataFrame:
        out = self.table()
        out = out if task is None else out.where(F.col("task") == task)
        return (out if workflow is None else out.where(F.col("workflow") == workflow)).orderBy("saved_at")

    def since(self, at: float) -> DataFrame:
        """What is left after clearing checkpoints older than ``at``."""
        return self.table().where(F.col("saved_at") >= at)


@dataclass
class Range:
    """A parameter: uniform, loguniform, normal (low, high are its clip), discrete or values."""

    name: str
    low: float = 0.0
    high: float = 1.0
    kind: str = "uniform"
    values: tuple = ()

    def at(self, u: np.ndarray) -> np.ndarray:
        if self.kind == "values":
            return np.array(self.values)[np.minimum((u * len(self.values)).astype(int), len(self.values) - 1)]
        if self.kind == "loguniform":
            return np.exp(math.log(self.low) + u * (math.log(self.high) - math.log(self.low)))
        if self.kind == "normal":
            z = np.array([normal_quantile(float(p)) for p in np.clip(u, 1e-9, 1 - 1e-9)])
            return np.clip((self.low + self.high) / 2 + z * (self.high - self.low) / 6, self.low, self.high)
        x = self.low + u * (self.high - self.low)
        return np.rint(x) if self.kind == "discrete" else x


def latin_hypercube(ranges: list[Range], n: int, seed: int = 0) -> list[dict]:
    rng = np.random.default_rng(seed)
    columns = {r.name: r.at((rng.permutation(n) + rng.random(n)) / n) for r in ranges}
    return [{k: v[i].item() for k, v in columns.items()} for i in range(n)]


def grid(ranges: list[Range], n: int) -> list[dict]:
    k = max(1, math.ceil(round(n ** (1 / len(ranges)), 9)))
    axes = [r.at(np.linspace(0, 1, k)) if r.kind != "values" else np.array(r.values) for r in ranges]
    mesh = np.meshgrid(*axes, indexing="ij")
    return [{r.name: m.ravel()[i].item() for r, m in zip(ranges, mesh)} for i in range(min(n, mesh[0].size))]


def sweep(spark: SparkSession, points: list[dict], evaluate: Callable[[dict], float], maximise: bool = True) -> DataFrame:
    """The value of each point, worked out in parallel, and which is best (the
    first of equal ones); a point that fails counts as the worst."""
    rows = [(i, json.dumps(p, sort_keys=True)) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "i long, parameters string").repartition(max(1, min(len(rows), spark.sparkContext.defaultParallelism * 4)))
    worst = float("-inf") if maximise else float("inf")
    from ..plans.scratch import materialise

    def run(parts):
        for pdf in parts:
            values = []
            for p in pdf["parameters"]:
                try:
                    values.append(float(evaluate(json.loads(p))))
                except Exception:
                    values.append(worst)
            yield pdf.assign(value=values)

    out = table.mapInPandas(run, T.StructType([*table.schema.fields, T.StructField("value", T.DoubleType())]))
    out = materialise(out, "sweep")  # read twice, worked out once
    best = out.agg(F.max(F.struct((F.col("value") if maximise else -F.col("value")).alias("v"), (-F.col("i")).alias("at"))).getField("at").alias("_best"))
    return out.crossJoin(F.broadcast(best)).withColumn("best", F.col("i") == -F.col("_best")).drop("_best")  # one row


def bayesian(evaluate: Callable[[dict], float], ranges: list[Range], iterations: int = 30, initial: int = 10, maximise: bool = True, seed: int = 0, acquire: str = "ei") -> tuple[dict, float, pd.DataFrame]:
    """Optimum by a Gaussian process (Matern 5/2) over the unit cube: a start of
    Latin hypercube points, then the best of 1000 candidates by ``ei`` (expected
    improvement), ``pi``, ``ucb`` or ``mean``. One sequential loop on the driver."""
    sign = 1 if maximise else -1
    rng = np.random.default_rng(seed)
    cube = lambda n: np.stack([(rng.permutation(n) + rng.random(n)) / n for _ in ranges], axis=1)
    point = lambda u: {r.name: r.at(np.array([x]))[0].item() for r, x in zip(ranges, u)}
    us = list(cube(min(initial, iterations)))
    ys = [sign * evaluate(point(u)) for u in us]
    while len(us) < iterations:
        x, y = np.array(us), np.array(ys)
        mean, scale = y.mean(), y.std() or 1.0
        c = cube(1000)
        kernel = lambda a, b: _matern(np.linalg.norm(a[:, None] - b[None], axis=2) / 0.3)
        inverse = np.linalg.inv(kernel(x, x) + 1e-6 * np.eye(len(x)))
        k = kernel(c, x)
        mu = k @ inverse @ ((y - mean) / scale)
        sd = np.sqrt(np.maximum(1 - np.einsum("ij,jk,ik->i", k, inverse, k), 1e-12))
        gain = mu - ((y.max() - mean) / scale)
        z = gain / sd
        cdf = np.array([(1 + math.erf(v / math.sqrt(2))) / 2 for v in z])
        score = {"ei": gain * cdf + sd * np.exp(-z * z / 2) / math.sqrt(2 * math.pi), "pi": cdf, "ucb": mu + 2.576 * sd, "mean": mu}[acquire]
        us.append(c[int(score.argmax())])
        ys.append(sign * evaluate(point(us[-1])))
    k = int(np.argmax(ys))
    history = pd.DataFrame([point(u) | {"value": sign * y} for u, y in zip(us, ys)])
    return point(us[k]), sign * ys[k], history


def _matern(r):
    return (1 + math.sqrt(5) * r + 5 * r * r / 3) * np.exp(-math.sqrt(5) * r)


def validated(results: DataFrame) -> DataFrame:
    """Results (status, checksum, expected, start, end) with ``valid``: completed,
    of the expected checksum where one is given, and not ended before the start."""
    ok = (F.col("status") == "completed") & (F.col("expected").isNull() | (F.col("checksum") == F.col("expected"))) & (F.col("end") >= F.col("start"))
    return results.withColumn("valid", F.coalesce(ok, F.lit(False)))


def cancelled(executions: DataFrame, gone: DataFrame) -> DataFrame:
    """The executions with those of ``gone`` (execution_id) cancelled that still run."""
    mark = gone.select("execution_id", F.lit(True).alias("_gone")).distinct()
    out = executions.join(mark, "execution_id", "left")
    return out.withColumn("status", F.when(F.col("_gone") & (F.col("status") == "running"), "cancelled").otherwise(F.col("status"))).drop("_gone")


def cleaned(executions: DataFrame, cutoff: Column) -> DataFrame:
    """What is left after clearing executions that ended before the cutoff; those
    that have not ended stay."""
    return executions.where(F.col("end").isNull() | (F.col("end") >= cutoff))


def encoded(df: DataFrame, ranges: list[Range]) -> DataFrame:
    """Parameters as numbers: values by their place among the range's, from 0 (null for others)."""
    return df.withColumns({r.name: F.when(F.array_position(F.array(*map(F.lit, r.values)), F.col(r.name)) > 0, F.array_position(F.array(*map(F.lit, r.values)), F.col(r.name)) - 1).cast("double") if r.kind == "values" else F.col(r.name).cast("double") for r in ranges})


def decoded(df: DataFrame, ranges: list[Range]) -> DataFrame:
    """Numbers as parameters: clipped to the range, rounded where it is discrete, and places as their values."""

    def one(r: Range) -> Column:
        if r.kind == "values":
            place = F.least(F.greatest(F.round(r.name), F.lit(0)), F.lit(len(r.values) - 1)).cast("int")
            return F.get(F.array(*map(F.lit, r.values)), place)
        x = F.least(F.greatest(F.col(r.name), F.lit(float(r.low))), F.lit(float(r.high)))
        return F.round(x) if r.kind == "discrete" else x

    return df.withColumns({r.name: one(r) for r in ranges})


def sweep_tasks(spark: SparkSession, points: list[dict], evaluate: Callable[[dict], float], objective: Callable[[float], float] | None = None, maximise: bool = True, name: str = "parameter_sweep") -> DataFrame:
    """A sweep as a workflow's table: a row for each point with its task's name,
    status, value and objective; a point that fails has no value and is the worst."""
    out = sweep(spark, points, (lambda p: objective(evaluate(p))) if objective else evaluate, maximise)
    bad = F.col("value").isin(float("inf"), float("-inf")) | F.isnan("value")
    return out.select(F.format_string(f"{name}-%05d", F.col("i")).alias("task"), "parameters", F.when(bad, "failed").otherwise("completed").alias("status"), F.when(~bad, F.col("value")).alias("value"), "best")


def sensitivity(spark: SparkSession, evaluate: Callable[[dict], float], ranges: list[Range], n: int = 100, seed: int = 0) -> DataFrame:
    """The sweep of ``n`` Latin hypercube points that a sensitivity analysis reads."""
    return sweep_tasks(spark, latin_hypercube(ranges, n, seed), evaluate)
