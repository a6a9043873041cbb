"""Neighborhood collaborative filtering as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwright.operators.baselines import bayesian_popularity, fit_biases, predict_biases, top_per_user
from kelpwright.storage import Workspace


def shrunk(similarity, support, shrinkage: float):
    """similarity * n / (n + shrinkage); 0 where both are 0."""
    total = support + F.lit(float(shrinkage))
    return F.when(total > 0, similarity * support / total).otherwise(0.0)


def residuals(ratings: DataFrame, variant: str, user: str = "user_id", item: str = "item_id"):
    """(user, item, rating, residual) and the bias model, if the variant has one."""
    if variant == "mean_centered":
        means = ratings.groupBy(user).agg(F.avg("rating").alias("base"))
        return ratings.join(means, user).select(user, item, "rating", (F.col("rating") - F.col("base")).alias("residual")), None
    if variant != "bias_aware":
        raise ValueError(f"unknown variant {variant}")
    model = fit_biases(ratings, user=user, item=item)
    return predict_biases(ratings, model, user, item).select(user, item, "rating", (F.col("rating") - F.col("raw")).alias("residual")), model


#: Entities of a shared key that travel in one list, rows of an entity beyond
#: which its sums are taken in several tasks, and list entries summed at a time.
LIST, SPLIT_ROWS, SUM_ENTRIES = 2_000, 50_000, 2_000_000


def _corated(k: int | None, min_support: int, shrinkage: float):
    """Sums over the partners of rows (a, ra, ids, rs) sorted by a.

    With ``k`` the k most similar of each entity, else (a, b, dot, support).
    """

    def close(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        b, value, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        b, of = np.unique(b, return_inverse=True)
        return b, np.bincount(of, value, len(b)), np.bincount(of, n, len(b)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, parts, size, out = None, [], 0, []

        def done() -> None:
            b, value, n = close(parts)
            if k is not None:
                similarity = np.round(value * n / (n + shrinkage), 12)
                good = np.flatnonzero((value > 0) & (n >= min_support) & (similarity > 0) & (b != who))
                good = good[np.lexsort((b[good], -similarity[good]))[:k]]
                b, value, n = b[good], similarity[good], n[good]
            out.append((np.full(len(b), who, b.dtype), b, value, n))

        def batch_of() -> pa.RecordBatch:
            a, b, value, n = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(value, pa.float64()), pa.array(n, pa.int64())], names=["a", "b", "value", "support"])

        for batch in batches:
            own, scale = batch.column("a").to_numpy(zero_copy_only=False), batch.column("ra").to_numpy()
            length = pc.list_value_length(batch.column("ids")).to_numpy()
            ids, value = batch.column("ids").flatten().to_numpy(zero_copy_only=False), batch.column("rs").flatten().to_numpy() * np.repeat(scale, length)
            upto = np.concatenate([[0], np.cumsum(length)])
            cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]]) if len(own) else np.zeros(1, int)
            for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if parts and own[x] != who:
                    done()
                    parts, size = [], 0
                who = own[x]
                part = slice(upto[x], upto[z])
                parts.append((ids[part], value[part], np.ones(upto[z] - upto[x])))
                size += upto[z] - upto[x]
                if size > SUM_ENTRIES:
                    parts, size = [close(parts)], 0
            if len(out) > 4096:
                yield batch_of()
                out = []
        if parts:
            done()
        if out:
            yield batch_of()

    return run


def top_similar(res: DataFrame, entity: str, shared: str, k: int, min_support: int, shrinkage: float) -> DataFrame:
    """(entity, neighbor, similarity, support): the k most similar entities.

    Cosine over whole residual vectors; only pairs that share ``min_support`` of
    ``shared`` and whose cosine is positive; shrunk by support, rounded to 12
    decimals so that noise about 0 is none; ties by id.

    The entities of a shared key travel in lists of about LIST, each to the
    others: all partners of an entity meet in its task, which sums them up and
    hands on its k best alone.  A shared key of any size is many lists, and an
    entity of more than SPLIT_ROWS rows has several tasks, whose sums are added.
    """
    space = Workspace(res.sparkSession, "similar_entities")
    kind = dict(res.dtypes)[entity]
    rows = res.where(F.col(entity).isNotNull() & F.col(shared).isNotNull()).select(F.col(shared).alias("s"), F.col(entity).alias("e"), F.col("residual").cast("double").alias("r"))
    norms = space.write(rows.groupBy("e").agg(F.sqrt(F.sum(F.col("r") * F.col("r"))).alias("norm"), F.count(F.lit(1)).alias("n")), "norms")
    unit = rows.join(norms.select("e", "norm"), "e").select("s", "e", F.when(F.col("norm") > 0, F.col("r") / F.col("norm")).otherwise(0.0).alias("r"))
    large = space.write(rows.groupBy("s").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > LIST).select("s", F.ceil(F.col("m") / LIST).alias("lists")), "large")
    if not large.isEmpty():
        unit = unit.join(large, "s", "left").withColumn("list", F.coalesce(F.pmod(F.xxhash64("e"), F.col("lists")), F.lit(0))).drop("lists")
    else:
        unit = unit.withColumn("list", F.lit(0).cast("long"))
    lists = unit.groupBy("s", "list").agg(F.collect_list("e").alias("ids"), F.collect_list("r").alias("rs"))
    if large.isEmpty():
        met = lists.select(F.explode(F.arrays_zip(F.col("ids").alias("a"), F.col("rs").alias("ra"))).alias("own"), "ids", "rs").select("own.a", "own.ra", "ids", "rs")
    else:
        met = lists.join(unit.select("s", F.col("e").alias("a"), F.col("r").alias("ra")), "s").select("a", "ra", "ids", "rs")
    busy = norms.where(F.col("n") > SPLIT_ROWS).select(F.col("e").alias("a"), F.ceil(F.col("n") / SPLIT_ROWS).alias("tasks"))
    schema = f"a {kind}, b {kind}, value double, support bigint"
    if busy.isEmpty():
        near = met.repartition("a").sortWithinPartitions("a").mapInArrow(_corated(k, min_support, shrinkage), schema)
        return near.select(F.col("a").alias("entity"), F.col("b").alias("neighbor"), F.col("value").alias("similarity"), "support")
    task = F.coalesce(F.pmod(F.xxhash64("ids"), F.col("tasks")), F.lit(0))
    met = met.join(busy, "a", "left").select("a", "ra", "ids", "rs", task.alias("task")).repartition("a", "task").sortWithinPartitions("a").drop("task")
    sums = met.mapInArrow(_corated(None, min_support, shrinkage), schema).groupBy("a", "b").agg(F.sum("value").alias("cosine"), F.sum("support").alias("support"))
    sums = sums.where((F.col("cosine") > 0) & (F.col("support") >= min_support) & (F.col("a") != F.col("b")))
    near = sums.withColumn("similarity", F.round(shrunk(F.col("cosine"), F.col("support"), shrinkage), 12)).where("similarity > 0")
    near = near.select(F.col("a").alias("entity"), F.col("b").alias("neighbor"), "similarity", "support")
    return top_per_user(near, k, "entity", "neighbor", "similarity").drop("rank")


@dataclass
class NeighborhoodCF:
    """User- or item-based CF with a Bayesian popularity fallback."""

    mode: str = "item"
    variant: str = "bias_aware"
    k: int = 40
    min_support: int = 3
    shrinkage: float = 10.0
    min_neighbors: int = 1
    user: str = "user_id"
    item: str = "item_id"

    def fit(self, ratings: DataFrame) -> NeighborhoodCF:
        if self.mode not in ("user", "item"):
            raise ValueError(f"unknown mode {self.mode}")
        space = Workspace(ratings.sparkSession, "cf")
        res, self.model = residuals(ratings, self.variant, self.user, self.item)
        self.res = space.write(res, "residuals")
        entity, shared = (self.user, self.item) if self.mode == "user" else (self.item, self.user)
        self.neighbors = space.write(top_similar(self.res, entity, shared, self.k, self.min_support, self.shrinkage), "neighbors")
        self.popularity = space.write(bayesian_popularity(ratings, item=self.item).select(self.item, F.col("score").alias("fallback")), "popularity")
        self.means = self.res.groupBy(self.user).agg(F.avg("rating").alias("mean"))
        self.mu = ratings.agg(F.avg("rating")).first()[0]
        return self

    def _base(self, pairs: DataFrame) -> DataFrame:
        if self.model is not None:
            return predict_biases(pairs, self.model, self.user, self.item).withColumnRenamed("raw", "base")
        return pairs.join(self.means, self.user, "left").withColumnRenamed("mean", "base")

    def _neighbors(self, users: DataFrame | None = None, pairs: DataFrame | None = None) -> DataFrame:
        """(user, item, similarity, residual): the rated neighbors of pairs.

        With ``pairs`` only those, else all that the users' neighbors reach.
        """
        u, i = self.user, self.item
        res = self.res.select(F.col(u).alias("ru"), F.col(i).alias("ri"), "residual")
        near = self.neighbors.withColumnsRenamed({"entity": "e", "neighbor": "m"})
        if self.mode == "user":
            start = (pairs if pairs is not None else users).join(near, F.col(u) == F.col("e"))
            on = F.col("m") == F.col("ru")
            if pairs is not None:
                rows = start.join(res, on & (F.col(i) == F.col("ri")))
            else:
                rows = start.join(res, on).withColumn(i, F.col("ri"))
        elif pairs is not None:
            rows = pairs.join(near, F.col(i) == F.col("e")).join(res, (F.col("m") == F.col("ri")) & (F.col(u) == F.col("ru")))
        else:
            # A user's rows together first: where the neighbors are broadcast, the sums need no other exchange.
            rows = users.join(res, F.col(u) == F.col("ru")).repartition(u).join(near, F.col("m") == F.col("ri")).withColumn(i, F.col("e"))
        return rows.select(u, i, "similarity", "residual")

    def _evidence(self, pairs: DataFrame) -> DataFrame:
        """(user, item, num, den, neighbors) of the pairs that have neighbors."""
        u, i, w = self.user, self.item, F.col("similarity")
        return self._neighbors(pairs=pairs).groupBy(u, i).agg(F.sum(w * F.col("residual")).alias("num"), F.sum(F.abs(w)).alias("den"), F.count(F.lit(1)).alias("neighbors"))

    def _supported(self):
        return F.coalesce((F.col("neighbors") >= self.min_neighbors) & (F.col("den") > 0) & F.col("base").isNotNull(), F.lit(False))

    def predict(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with rating_estimate (clipped), neighbors and used_fallback."""
        asked = pairs.select(self.user, self.item).distinct()
        known = asked.join(self.means.select(self.user), self.user, "left_semi").join(self.popularity.select(self.item), self.item, "left_semi")
        scored = self._base(asked).join(self._evidence(pairs=known), [self.user, self.item], "left").join(self.popularity, self.item, "left")
        raw = F.when(self._supported(), F.col("base") + F.col("num") / F.col("den")).otherwise(F.coalesce("fallback", F.lit(self.mu)))
        out = scored.select(self.user, self.item, F.least(F.greatest(raw, F.lit(1.0)), F.lit(5.0)).alias("rating_estimate"), F.coalesce("neighbors", F.lit(0)).alias("neighbors"), (~self._supported()).alias("used_fallback"))
        return pairs.join(out, [self.user, self.item], "left")

    def recommend(self, users: DataFrame, n: int = 10, secondary: bool = False) -> DataFrame:
        """(user, rank, item, score, evidence, used_fallback): n unseen items each.

        Items with enough neighbors rank by the unclipped estimate, all others
        by Bayesian popularity.  Popularity lists are made for those users only
        who have fewer than n estimates above the best popularity.
        ``secondary`` breaks equal scores by popularity, then evidence.
        """
        from kelpwright.operators.baselines import popular_unseen

        u, i = self.user, self.item
        space = Workspace(self.res.sparkSession, "lists")
        tie = ("fallback", "evidence") if secondary else ()
        who = users.select(u).distinct()
        w, seen = F.col("similarity"), self.res.select(u, i)

        def estimated(asked: DataFrame) -> DataFrame:
            """(user, item, score, evidence) of unseen items with enough neighbors."""
            own = seen.join(asked, u, "left_semi").select(u, i, F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("double").alias("residual"))
            sums = (F.sum(w * F.col("residual")).alias("num"), F.sum(F.abs(w)).alias("den"), F.count(w).alias("neighbors"), F.bool_or(w.isNull()).alias("seen"))
            reached = self._neighbors(users=asked).unionByName(own).groupBy(u, i).agg(*sums).where("NOT seen")
            based = self._base(reached).where(self._supported())
            return based.select(u, i, F.round(F.col("base") + F.col("num") / F.col("den"), 9).alias("score"), F.col("den").alias("evidence"))

        def ranked(rows: DataFrame) -> DataFrame:
            return top_per_user(rows.join(self.popularity, i, "left"), n, u, i, "score", tie)

        best = space.write(ranked(estimated(who)).select(u, i, "score", "evidence", F.lit(False).alias("used_fallback")), "best")
        top = self.popularity.agg(F.round(F.max("fallback"), 9)).first()[0]
        full = best.where(F.col("score") > F.lit(top)).groupBy(u).count().where(F.col("count") >= n) if top is not None else best.select(u)
        short = space.write(who.join(full.select(u), u, "left_anti"), "short")
        # Of the popularity order, items with an estimate must be skipped as well.
        taken = seen.join(short, u, "left_semi").unionByName(estimated(short).select(u, i))
        for_all = taken.unionByName(short.join(seen.select(u).distinct(), u, "left_anti").withColumn(i, F.lit(None)))
        rest = popular_unseen(self.popularity, for_all, n, u, i, "fallback").join(self.popularity, i)
        rest = rest.select(u, i, F.round("fallback", 9).alias("score"), F.lit(0.0).alias("evidence"), F.lit(True).alias("used_fallback"))
        return ranked(best.unionByName(rest)).select(u, "rank", i, "score", "evidence", "used_fallback")


def explain(model: NeighborhoodCF, pairs: DataFrame, n: int = 3) -> DataFrame:
    """The n neighbors that weigh most in each estimate, by |weight * residual|."""
    u, i = model.user, model.item
    near = model.neighbors.withColumnsRenamed({"entity": "e", "neighbor": "m"})
    res = model.res.select(F.col(u).alias("ru"), F.col(i).alias("ri"), "residual")
    if model.mode == "user":
        rows = pairs.join(near, F.col(u) == F.col("e")).join(res, (F.col("m") == F.col("ru")) & (F.col(i) == F.col("ri")))
    else:
        rows = pairs.join(near, F.col(i) == F.col("e")).join(res, (F.col("m") == F.col("ri")) & (F.col(u) == F.col("ru")))
    rows = rows.withColumn("contribution", F.round(F.col("similarity") * F.col("residual"), 12)).withColumn("size", F.abs("contribution"))
    rows = rows.withColumn("pair", F.struct(u, i))
    return top_per_user(rows, n, "pair", "m", "size").select(u, i, "rank", F.col("m").alias("neighbor"), "contribution")
