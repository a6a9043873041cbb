"""Experiment protocol: configurations, gates, grids, results, checkpoints.

Driver-side state around the DataFrame operators; tables stay in Spark.
"""

from __future__ import annotations

import copy
import hashlib
import itertools
import json
import math
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kelpwright.operators.checks import canonical_json
from kelpwright.storage import delete


def config_hash(config: Mapping) -> str:
    return hashlib.sha256(canonical_json(config).encode()).hexdigest()


@dataclass(frozen=True)
class Rule:
    """What a configuration value must be."""

    kind: type | tuple[type, ...]
    positive: bool = False
    choices: tuple = ()


def validate_config(config: Mapping[str, Any], rules: Mapping[str, Rule], forbidden: Iterable[str] = ()) -> list[str]:
    """Faults of a configuration, none if it is valid; bools are not numbers."""
    faults = [f"{k}: missing" for k in rules if k not in config] + [f"{k}: unknown" for k in config if k not in rules]
    faults += [f"{k}: not allowed here" for k in forbidden if k in config]
    for k, rule in rules.items():
        if k not in config:
            continue
        v = config[k]
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        if not isinstance(v, rule.kind) or (isinstance(v, bool) and bool not in (rule.kind if isinstance(rule.kind, tuple) else (rule.kind,))):
            faults.append(f"{k}: wrong type")
        elif number and not math.isfinite(v):
            faults.append(f"{k}: not finite")
        elif rule.positive and number and v <= 0:
            faults.append(f"{k}: not positive")
        elif rule.choices and v not in rule.choices:
            faults.append(f"{k}: not one of {list(rule.choices)}")
    return faults


class FrozenGate:
    """Test rows stay closed until a configuration is frozen, and it stays so."""

    def __init__(self) -> None:
        self._config: str | None = None

    def freeze(self, config: Mapping) -> str:
        text = canonical_json(config)
        if self._config is not None and self._config != text:
            raise RuntimeError("another configuration is frozen already")
        self._config = text
        return hashlib.sha256(text.encode()).hexdigest()

    def open_test(self, config: Mapping, read: Callable[[], DataFrame]) -> DataFrame:
        if self._config is None:
            raise RuntimeError("the test split cannot be read before a configuration is frozen")
        if canonical_json(config) != self._config:
            raise RuntimeError("the configuration is not the frozen one")
        return read()


def grid(space: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, in the order of the space."""
    return [dict(zip(space, values, strict=True)) for values in itertools.product(*space.values())]


@dataclass
class GridSearch:
    """Evaluates configurations once each; ties go to the earlier one."""

    evaluate: Callable[[dict], dict]
    keys: Sequence[str]
    results: dict[str, tuple[dict, dict]] = field(default_factory=dict)

    def run(self, configs: Iterable[dict]) -> list[tuple[dict, dict]]:
        for c in configs:
            text = canonical_json(c)
            if text not in self.results:
                self.results[text] = (c, self.evaluate(c))
        return self.ranked()

    def ranked(self) -> list[tuple[dict, dict]]:
        return sorted(self.results.values(), key=lambda r: tuple(-r[1][k] for k in self.keys))

    def refine(self, name: str, values: Sequence, top: int = 3) -> list[tuple[dict, dict]]:
        """Vary one more field on the best configurations."""
        return self.run([c | {name: v} for c, _ in self.ranked()[:top] for v in values])


def deep_merge(base: Mapping, change: Mapping) -> dict:
    out = copy.deepcopy(dict(base))
    for k, v in change.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else copy.deepcopy(v)
    return out


def ablations(base: Mapping, changes: Mapping[str, Mapping]) -> dict[str, dict]:
    """The base and one configuration per change, each from the base."""
    return {"base": copy.deepcopy(dict(base))} | {name: deep_merge(base, c) for name, c in changes.items()}


def flat(config: Mapping, path: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in config.items():
        out |= flat(v, f"{path}{k}.") if isinstance(v, Mapping) else {f"{path}{k}": v}
    return out


def matrix_differences(configs: Mapping[str, Mapping], may_differ: Iterable[str]) -> list[str]:
    """Fields beyond the allowed ones in which configurations differ."""
    flats = [flat(c) for c in configs.values()]
    names = sorted({k for f in flats for k in f} - set(may_differ))
    return [k for k in names if len({canonical_json(f.get(k)) for f in flats}) > 1]


class Scorer(Protocol):
    """What evaluators need of a model: pairs in, pairs with a prediction out."""

    def predict(self, pairs: DataFrame) -> DataFrame: ...


class Registry:
    """Model factories by name."""

    def __init__(self) -> None:
        self._makers: dict[str, Callable[..., Any]] = {}

    def add(self, name: str, maker: Callable[..., Any]) -> None:
        if name in self._makers:
            raise ValueError(f"{name} is registered already")
        self._makers[name] = maker

    def make(self, name: str, **config: Any) -> Any:
        if name not in self._makers:
            raise ValueError(f"unknown model {name}: one of {sorted(self._makers)}")
        return self._makers[name](**config)


def stage_completeness(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """(blocker) rows: absent models, and more than one protocol or evaluator.

    ``results``: model, protocol, evaluator.  Absent models are never filled in.
    """
    spark = results.sparkSession
    wanted = spark.createDataFrame([(m,) for m in models], "model string")
    absent = wanted.join(results.select("model"), "model", "left_anti").select(F.concat(F.lit("missing model: "), "model").alias("blocker"))
    counts = results.agg(F.countDistinct("protocol").alias("p"), F.countDistinct("evaluator").alias("e"))
    mixed = counts.select(F.explode(F.array(F.when(F.col("p") > 1, "several protocols"), F.when(F.col("e") > 1, "several evaluators"))).alias("blocker"))
    return absent.unionByName(mixed.where("blocker IS NOT NULL"))


def assemble_results(spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType, optional: Iterable[str] = ()) -> DataFrame:
    """Result rows under a fixed schema.

    A field that is absent is an error unless it is optional, when it is null; a
    field that the schema lacks is an error too.
    """
    names, free = [f.name for f in schema], set(optional)
    for r in rows:
        absent, extra = sorted(set(names) - set(r) - free), sorted(set(r) - set(names))
        if absent or extra:
            raise ValueError(f"result row: missing {absent}, unknown {extra}")
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


_DONE = "COMPLETE.json"


def publish_checkpoint(spark: SparkSession, root: str, step: int, tables: Mapping[str, DataFrame], binding: Mapping) -> str:
    """Write a checkpoint's tables, then the marker that makes it valid.

    ``binding`` (say, the configuration) must match when it is loaded.
    """
    path = f"{root.rstrip('/')}/step-{step:09d}"
    delete(spark, path)
    counts = {}
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
        counts[name] = spark.read.parquet(f"{path}/{name}").count()
    marker = canonical_json({"step": step, "rows": counts, "binding": config_hash(binding)})
    spark.createDataFrame([(marker,)], "value string").coalesce(1).write.text(f"{path}/{_DONE}")
    return path


def latest_checkpoint(spark: SparkSession, root: str, binding: Mapping) -> tuple[int, dict[str, DataFrame]] | None:
    """The newest complete checkpoint with this binding and its row counts intact."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return None
    for path in sorted((s.getPath().toString() for s in fs.listStatus(base)), reverse=True):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{_DONE}/_SUCCESS")):
            continue
        marker = json.loads(spark.read.text(f"{path}/{_DONE}").first()[0])
        if marker["binding"] != config_hash(binding):
            continue
        tables = {n: spark.read.parquet(f"{path}/{n}") for n in marker["rows"]}
        if all(df.count() == marker["rows"][n] for n, df in tables.items()):
            return marker["step"], tables
    return None


def equal_tables(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted (resume checks)."""
    return sorted(a.columns) == sorted(b.columns) and a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()
