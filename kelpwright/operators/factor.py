"""Matrix factorization over observed ratings.

Least-squares sums over a row's ratings are matrix products in Arrow batches,
those of a row with very many ratings in several tasks; multiplicative updates
are hash aggregates with map-side combine.  Stochastic descent runs on
blocks of users by items in strata whose blocks share neither, which equals
one sequential pass in some order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kelpwright.functions.scalars import dot
from kelpwright.operators.baselines import fit_biases, predict_biases, top_per_user
from kelpwright.operators.blocks import Placed, als_in_blocks
from kelpwright.operators.catalog import CELL, catalog_lists
from kelpwright.storage import Workspace

#: Items of a cell of the catalog.
_ITEM_BLOCK = CELL


def initial_factors(ids: DataFrame, k: int, seed: int, low: float = -0.17, high: float = 0.17) -> DataFrame:
    """(idx, f): reproducible uniform factors, a function of id and seed."""
    uniform = lambda j: F.shiftrightunsigned(F.xxhash64("idx", j, F.lit(seed)), 11) / F.lit(float(2**53))
    return ids.withColumn("f", F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.lit(low) + uniform(j) * (high - low)))


#: Ratings of a row beyond which its sums are taken in several tasks.
SPLIT_RATINGS = 200_000
#: Rows solved at a time.
_SOLVE = 512


def _normal(k: int, reg: float, packed: bool, solve: bool):
    """Sums of outer products and of value * factors over rows sorted by idx.

    In: (idx, f, value) or, if ``packed``, (idx, f) with sums already; out: the
    ridge solutions if ``solve``, else the sums, as (idx, f).
    """
    low = np.tril_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sums: list[np.ndarray] = []

        def out(upto: int) -> pa.RecordBatch:
            s = np.array(sums[:upto])
            if solve:
                gram = np.zeros((len(s), k, k))
                gram[:, low[0], low[1]] = s[:, : len(low[0])]
                gram[:, low[1], low[0]] = s[:, : len(low[0])]
                s = np.linalg.solve(gram + reg * np.eye(k), s[:, len(low[0]) :, None])[:, :, 0]
            offsets = pa.array(np.arange(len(s) + 1, dtype=np.int32) * s.shape[1])
            batch = pa.RecordBatch.from_arrays([pa.array(ids[:upto]), pa.ListArray.from_arrays(offsets, pa.array(s.ravel()))], names=["idx", "f"])
            del ids[:upto], sums[:upto]
            return batch

        for b in batches:
            if not b.num_rows:
                continue
            own = b.column("idx").to_numpy(zero_copy_only=False)
            f = b.column("f").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
            value = None if packed else b.column("value").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            for x, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                part = f[x:z]
                new = part.sum(0) if packed else np.concatenate([(part.T @ part)[low], value[x:z] @ part])
                if ids and ids[-1] == own[x]:
                    sums[-1] = sums[-1] + new
                else:
                    ids.append(own[x])
                    sums.append(new)
            if len(ids) > _SOLVE:
                yield out(len(ids) - 1)  # the last row may go on
        if ids:
            yield out(len(ids))

    return run


def busy_rows(triplets: DataFrame, own: str, space: Workspace) -> DataFrame | None:
    """(idx, tasks) of the rows with more than SPLIT_RATINGS ratings, or None."""
    counts = triplets.groupBy(F.col(own).alias("idx")).count().where(F.col("count") > SPLIT_RATINGS)
    busy = space.write(counts.select("idx", F.ceil(F.col("count") / SPLIT_RATINGS).alias("tasks")), f"busy_{own}")
    return None if busy.isEmpty() else busy


def als_half_step(triplets: DataFrame, own: str, other: str, factors: DataFrame, k: int, reg: float, busy: DataFrame | None = None) -> DataFrame:
    """(idx, f) of the ``own`` side: ridge solutions given the other side's.

    The penalty is ``reg`` whatever the number of ratings.  Rows without
    ratings have no result.  Sums are taken by matrix products over a row's
    ratings as they stream by, for ``busy`` ones in several tasks first.
    """
    rows = triplets.join(factors.withColumnRenamed("idx", other), other).select(F.col(own).alias("idx"), "f", "value", F.xxhash64(other).alias("h"))
    schema = f"idx {dict(triplets.dtypes)[own]}, f array<double>"
    if busy is None:
        return rows.drop("h").repartition("idx").sortWithinPartitions("idx").mapInArrow(_normal(k, reg, False, True), schema)
    rows = rows.join(busy, "idx", "left").withColumn("task", F.coalesce(F.pmod("h", F.col("tasks")), F.lit(0)))
    sums = rows.repartition("idx", "task").sortWithinPartitions("idx").select("idx", "f", "value").mapInArrow(_normal(k, reg, False, False), schema)
    return sums.repartition("idx").sortWithinPartitions("idx").mapInArrow(_normal(k, reg, True, True), schema)


@dataclass
class FactorModel:
    """Factors of both sides, with biases where the model has them."""

    users: DataFrame
    items: DataFrame
    biases: tuple[float, DataFrame, DataFrame] | None = None
    history: list[float] = field(default_factory=list)
    user: str = "user_id"
    item: str = "item_id"
    placed: Placed | None = None

    def predict(self, pairs: DataFrame, output: str = "prediction") -> DataFrame:
        """``pairs`` with the raw estimate; an unknown side adds nothing."""
        if self.placed is not None:
            rows = self.placed.predict(pairs, output)
        else:
            u = self.users.select(F.col("idx").alias(self.user), F.col("f").alias("__p"))
            i = self.items.select(F.col("idx").alias(self.item), F.col("f").alias("__q"))
            rows = pairs.join(u, self.user, "left").join(i, self.item, "left")
            rows = rows.withColumn(output, F.coalesce(dot("__p", "__q"), F.lit(0.0))).drop("__p", "__q")
        if self.biases is not None:
            rows = predict_biases(rows, self.biases, self.user, self.item).withColumn(output, F.col(output) + F.col("raw")).drop("raw")
        return rows

    def recommend(self, candidates: DataFrame, seen: DataFrame, n: int = 10) -> DataFrame:
        """The n best unseen candidate pairs of each user by the raw score, ties by id."""
        open_ = candidates.join(seen.select(self.user, self.item), [self.user, self.item], "left_anti")
        scored = self.predict(open_, "score").withColumn("score", F.round("score", 9))
        return top_per_user(scored, n, self.user, self.item, "score")

    def recommend_catalog(self, seen: DataFrame, n: int = 10) -> DataFrame:
        """The n best unseen items of the whole item side for each user.

        By the raw score rounded to 9 decimals, ties by id (integers); seen
        items are excluded before the cut.  Each task meets blocks of users with
        the cells of items that can still enter their lists (operators/catalog.py);
        no pairs are formed and no item is left out but by such a bound.
        """
        sides = []
        for own, key, other in ((self.users, self.user, self.item), (self.items, self.item, self.user)):
            rows = own.select(F.col("idx").alias(key), F.col("f").alias("v"))
            if self.biases is not None:  # the raw bias of a pair is the sum of both sides' less the mean
                rows = predict_biases(rows.withColumn(other, F.lit(None).cast("long")), self.biases, self.user, self.item)
                raw = [F.lit(1.0), F.col("raw")] if key == self.user else [F.col("raw") - self.biases[0], F.lit(1.0)]
                rows = rows.select(key, F.concat("v", F.array(*raw)).alias("v"))
            sides.append(rows)
        users, items = sides
        known = seen.where(F.col(self.item).isNotNull()).groupBy(self.user).agg(F.collect_set(F.col(self.item).cast("long")).alias("seen"))
        asked = users.join(known, self.user, "left").select(self.user, "v", F.coalesce("seen", F.array().cast("array<bigint>")).alias("seen"))
        return catalog_lists(asked, items, self.user, self.item, n, _ITEM_BLOCK).withColumn(self.item, F.col(self.item).cast(dict(items.dtypes)[self.item]))


def observed_rmse(triplets: DataFrame, model: FactorModel) -> float:
    e = F.col("prediction") - F.col("value")
    return model.predict(triplets).agg(F.sqrt(F.avg(e * e))).first()[0]


def fit_als(ratings: DataFrame, k: int = 8, reg: float = 0.1, iterations: int = 5, seed: int = 42, biased: bool = False, user: str = "user_id", item: str = "item_id") -> FactorModel:
    """Explicit ALS; ``biased``: on the residuals of a fitted bias model.

    Observed zero residuals stay in the design.  Half steps run on blocks whose
    factors are mapped files (operators/blocks.py); if a row has more than
    SPLIT_RATINGS ratings, factors are joined to the ratings instead and written
    each half step, so that its sums are taken in several tasks.
    """
    space = Workspace(ratings.sparkSession, "als")
    biases = fit_biases(ratings, user=user, item=item) if biased else None
    if biased:
        triplets = predict_biases(ratings, biases, user, item).select(user, item, (F.col("rating") - F.col("raw")).alias("value"))
    else:
        triplets = ratings.where("rating > 0").select(user, item, F.col("rating").cast("double").alias("value"))
    triplets = space.write(triplets, "triplets")
    items = initial_factors(triplets.select(F.col(item).alias("idx")).distinct(), k, seed)
    users, busy = None, {c: busy_rows(triplets, c, space) for c in (user, item)}
    if iterations and busy[user] is None and busy[item] is None:
        users, items, placed = als_in_blocks(triplets, user, item, lambda ids: initial_factors(ids, k, seed), k, reg, iterations, space)
        space.drop("triplets")
        return FactorModel(users, items, biases, user=user, item=item, placed=placed)
    for t in range(iterations):
        users = space.write(als_half_step(triplets, user, item, items, k, reg, busy[user]), f"users{t}")
        items = space.write(als_half_step(triplets, item, user, users, k, reg, busy[item]), f"items{t}")
        if t:
            space.drop(f"users{t - 1}")
            space.drop(f"items{t - 1}")
    space.drop("triplets")
    return FactorModel(users, items, biases, user=user, item=item)


def fit_nmf(ratings: DataFrame, k: int = 8, reg: float = 0.01, iterations: int = 20, tol: float = 1e-4, epsilon: float = 1e-9, seed: int = 42, user: str = "user_id", item: str = "item_id") -> FactorModel:
    """Non-negative factors by multiplicative updates over observed ratings.

    Converged when the observed RMSE changes by less than ``tol`` between
    checks, which come every tenth iteration and at the end.
    """
    space = Workspace(ratings.sparkSession, "nmf")
    triplets = space.write(ratings.where("rating > 0").select(user, item, F.col("rating").cast("double").alias("value")), "triplets")
    sides = {c: initial_factors(triplets.select(F.col(c).alias("idx")).distinct(), k, seed + n, epsilon, 1.0) for n, c in enumerate((user, item))}

    def update(own: str, other: str, name: str) -> DataFrame:
        rows = triplets.join(sides[own].select(F.col("idx").alias(own), F.col("f").alias("w")), own).join(sides[other].select(F.col("idx").alias(other), F.col("f").alias("h")), other)
        rows = rows.withColumn("p", dot("w", "h"))
        sums = [F.sum(F.col("value") * F.col("h")[j]).alias(f"n{j}") for j in range(k)] + [F.sum(F.col("p") * F.col("h")[j]).alias(f"d{j}") for j in range(k)]
        per = rows.groupBy(F.col(own).alias("idx")).agg(*sums)
        new = F.array(*(F.col("f")[j] * F.col(f"n{j}") / (F.col(f"d{j}") + reg * F.col("f")[j] + epsilon) for j in range(k)))
        return space.write(sides[own].join(per, "idx").select("idx", new.alias("f")), name)

    history: list[float] = []
    for t in range(iterations):
        sides[user] = update(user, item, f"users{t}")
        sides[item] = update(item, user, f"items{t}")
        if t:
            space.drop(f"users{t - 1}")
            space.drop(f"items{t - 1}")
        if t % 10 == 0 or t == iterations - 1:
            history.append(observed_rmse(triplets, FactorModel(sides[user], sides[item], user=user, item=item)))
            if len(history) > 1 and abs(history[-2] - history[-1]) < tol:
                break
    return FactorModel(sides[user], sides[item], history=history, user=user, item=item)


def sgd_pass(users: np.ndarray, items: np.ndarray, ratings: np.ndarray, p: np.ndarray, q: np.ndarray, bu: np.ndarray | None, bi: np.ndarray | None, mu: float, rate: float, reg: float) -> None:
    """Sequential updates in the given order, in place; biases where given."""
    for u, i, r in zip(users, items, ratings, strict=True):
        pu = p[u].copy()
        e = r - pu @ q[i] - (mu + bu[u] + bi[i] if bu is not None else 0.0)
        if bu is not None:
            bu[u] += rate * (e - reg * bu[u])
            bi[i] += rate * (e - reg * bi[i])
        p[u] += rate * (e * q[i] - reg * pu)
        q[i] += rate * (e * pu - reg * q[i])


def fit_sgd(
    train: DataFrame, validation: DataFrame | None = None, k: int = 8, rate: float = 0.01, reg: float = 0.02, epochs: int = 5, patience: int = 3, min_delta: float = 1e-4,
    blocks: int = 4, biased: bool = False, seed: int = 42, user: str = "user_id", item: str = "item_id",
) -> FactorModel:
    """Sequential SGD factorization, with intercepts if ``biased``.

    Users and items are hashed to ``blocks``; an epoch is one stratum after
    another, the blocks of a stratum being independent of each other, so the
    result is that of one sequential pass ordered by stratum and, in a block, by
    a seeded hash of epoch and pair.  A task holds one block of ratings and its
    two blocks of factors: choose ``blocks`` so that these fit.  Training stops
    after ``patience`` epochs without a validation RMSE lower by ``min_delta``
    (unclipped) and returns the best epoch.
    """
    space = Workspace(train.sparkSession, "sgd")
    value = F.col("rating").cast("double").alias("value")
    rows = train.where("rating > 0").select(user, item, value)
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(blocks)).cast("int")
    rows = space.write(rows.withColumns({"ub": block(F.col(user)), "ib": block(F.col(item))}), "rows")
    mu = rows.agg(F.avg("value")).first()[0] if biased else 0.0
    sides = {}
    for n, (c, b) in enumerate(((user, "ub"), (item, "ib"))):
        sides[b] = space.write(initial_factors(rows.select(F.col(c).alias("idx"), b).distinct(), k, seed + n).withColumn("b", F.lit(0.0)), f"start_{b}")
    kinds = dict(rows.dtypes)

    def step(key: tuple, ratings: pd.DataFrame, factors: pd.DataFrame) -> pd.DataFrame:
        place = {s: {i: n for n, i in enumerate(factors.loc[factors["side"] == s, "idx"])} for s in (0, 1)}
        f = {s: np.array(factors.loc[factors["side"] == s, "f"].tolist()) for s in (0, 1)}
        b = {s: factors.loc[factors["side"] == s, "b"].to_numpy(float).copy() for s in (0, 1)}
        if len(ratings) and len(f[0]) and len(f[1]):
            ratings = ratings.sort_values(["h", user, item])
            us, its = ratings[user].map(place[0]).to_numpy(), ratings[item].map(place[1]).to_numpy()
            sgd_pass(us, its, ratings["value"].to_numpy(), f[0], f[1], b[0] if biased else None, b[1] if biased else None, mu, rate, reg)
        out = []
        for s in (0, 1):
            out.append(pd.DataFrame({"side": s, "idx": list(place[s]), "own": factors.loc[factors["side"] == s, "own"].to_numpy(), "f": list(f[s]), "b": b[s]}))
        return pd.concat(out, ignore_index=True)

    def model() -> FactorModel:
        biases = None
        if biased:
            biases = (mu, *(sides[b].select(F.col("idx").alias(c), F.col("b").alias(o)) for b, c, o in (("ub", user, "bu"), ("ib", item, "bi"))))
        return FactorModel(sides["ub"].select("idx", "f"), sides["ib"].select("idx", "f"), biases, user=user, item=item)

    held = validation.where("rating > 0").select(user, item, value) if validation is not None else None
    best, best_loss, stale, history = model(), float("inf"), 0, []
    for epoch in range(epochs):
        for s in range(blocks):
            group = F.pmod(F.col("ub") - F.col("ib"), F.lit(blocks))
            part = rows.where(group == s).select(F.col("ub").alias("task"), user, item, "value", F.xxhash64(user, item, F.lit(epoch), F.lit(seed)).alias("h"))
            u = sides["ub"].select(F.col("ub").alias("task"), F.lit(0).alias("side"), "idx", F.col("ub").alias("own"), "f", "b")
            i = sides["ib"].select(F.pmod(F.col("ib") + s, F.lit(blocks)).cast("int").alias("task"), F.lit(1).alias("side"), "idx", F.col("ib").alias("own"), "f", "b")
            new = part.groupBy("task").cogroup(u.unionByName(i).groupBy("task")).applyInPandas(step, f"side int, idx {kinds[user]}, own int, f array<double>, b double")
            new = space.write(new, f"e{epoch}s{s}")
            sides = {name: new.where(f"side = {n}").select("idx", F.col("own").alias(name), "f", "b") for n, name in enumerate(("ub", "ib"))}
        if held is None:
            best = model()
            continue
        loss = observed_rmse(held, model())
        history.append(loss)
        if loss < best_loss - min_delta:
            best, best_loss, stale = model(), loss, 0
        else:
            stale += 1
            if stale >= patience:
                break
    best.history = history
    return best


def svdpp_estimate(mu: float, bu: float, bi: float, p: np.ndarray, q: np.ndarray, y: np.ndarray) -> float:
    """mu + b_u + b_i + q.(p + sum of y over the user's implicit items / root of their number)."""
    implicit = y.sum(0) / np.sqrt(len(y)) if len(y) else 0.0
    return float(mu + bu + bi + q @ (p + implicit))


def fit_svdpp(
    train: DataFrame, k: int = 8, rate: float = 0.01, reg: float = 0.02, epochs: int = 3, blocks: int = 4, seed: int = 42, user: str = "user_id", item: str = "item_id",
    validation: DataFrame | None = None, patience: int = 3, min_delta: float = 1e-4,
) -> tuple[FactorModel, DataFrame]:
    """SVD++ with implicit histories of train: the model and (idx, y) factors.

    Implicit set: read, reviewed or rated.  The model's user factors already
    hold p plus the implicit term.  Users are hashed to ``blocks``; a block runs
    the sequential updates over its users on its own copy of the item side, and
    after each epoch the copies are averaged by their number of ratings (one
    block is the exact sequential algorithm).  With ``validation``, training
    stops after ``patience`` epochs without an RMSE lower by ``min_delta`` and
    returns the best epoch.
    """
    space = Workspace(train.sparkSession, "svdpp")
    implicit = train.where("is_read OR is_reviewed OR rating > 0")
    rows = implicit.select(user, item, F.col("rating").cast("double").alias("value")).withColumn("task", F.pmod(F.xxhash64(user, F.lit(seed)), F.lit(blocks)).cast("int"))
    rows = space.write(rows, "rows")
    mu = rows.where("value > 0").agg(F.avg("value")).first()[0]
    ids = rows.select(F.col(item).alias("idx")).distinct()
    items = initial_factors(ids, k, seed + 1).withColumn("b", F.lit(0.0)).join(initial_factors(ids, k, seed + 2).withColumnRenamed("f", "y"), "idx")
    users = initial_factors(rows.select(F.col(user).alias("idx"), "task").distinct(), k, seed).withColumn("b", F.lit(0.0))
    users, items = space.write(users, "u"), space.write(items, "i")
    kind = dict(rows.dtypes)[user]
    schema = f"side int, idx {kind}, task int, f array<double>, b double, y array<double>, n double"

    def step(key: tuple, ratings: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        us, its = state[state["side"] == 0], state[state["side"] == 1]
        pu, pi = {x: n for n, x in enumerate(us["idx"])}, {x: n for n, x in enumerate(its["idx"])}
        p, q, y = (np.array(x.tolist()).reshape(-1, k) for x in (us["f"], its["f"], its["y"]))
        bu, bi, seen = us["b"].to_numpy(float).copy(), its["b"].to_numpy(float).copy(), np.zeros(len(pi))
        ratings = ratings.assign(u=ratings[user].map(pu), i=ratings[item].map(pi))
        own = {u: np.sort(g["i"].unique()) for u, g in ratings.groupby("u")}
        for r in ratings[ratings["value"] > 0].sort_values(["h", user, item]).itertuples():
            u, i, hist = r.u, r.i, own[r.u]
            root = np.sqrt(len(hist))
            rep = p[u] + y[hist].sum(0) / root
            e = r.value - (mu + bu[u] + bi[i] + q[i] @ rep)
            bu[u] += rate * (e - reg * bu[u])
            bi[i] += rate * (e - reg * bi[i])
            qi = q[i].copy()
            q[i] += rate * (e * rep - reg * q[i])
            p[u] += rate * (e * qi - reg * p[u])
            y[hist] += rate * (e * qi / root - reg * y[hist])
            seen[i] += 1
        u = pd.DataFrame({"side": 0, "idx": list(pu), "task": us["task"].to_numpy(), "f": list(p), "b": bu, "y": None, "n": 0.0})
        i = pd.DataFrame({"side": 1, "idx": list(pi), "task": -1, "f": list(q), "b": bi, "y": list(y), "n": seen})
        return pd.concat([u, i], ignore_index=True)

    mean = lambda c: F.array(*(F.sum(F.col(c)[j] * F.col("w")) / F.sum("w") for j in range(k))).alias(c)
    pairs = rows.select(F.col(user).alias("u"), F.col(item).alias("idx")).distinct()

    def assembled(name: str) -> FactorModel:
        """The model as it stands: each user's p plus the implicit term."""
        sums = pairs.join(items.select("idx", "y"), "idx").groupBy("u").agg(*(F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(k)), F.sqrt(F.count(F.lit(1))).alias("root"))
        whole = users.join(sums, users["idx"] == sums["u"]).select("idx", F.array(*(F.col("f")[j] + F.col(f"y{j}") / F.col("root") for j in range(k))).alias("f"))
        biases = (mu, users.select(F.col("idx").alias(user), F.col("b").alias("bu")), items.select(F.col("idx").alias(item), F.col("b").alias("bi")))
        return FactorModel(space.write(whole, name), items.select("idx", "f"), biases, user=user, item=item)

    held = validation.where("rating > 0").select(user, item, F.col("rating").cast("double").alias("value")) if validation is not None else None
    best, best_loss, stale, losses = None, float("inf"), 0, []
    for epoch in range(epochs):
        part = rows.withColumn("h", F.xxhash64(user, item, F.lit(epoch), F.lit(seed)))
        null = F.lit(None).cast("array<double>")
        # A block needs the item side of its own users' items only.
        needed = rows.select("task", F.col(item).alias("idx")).distinct()
        i = items.join(needed, "idx").select(F.lit(1).alias("side"), "idx", "task", "f", "b", "y")
        u = users.select(F.lit(0).alias("side"), "idx", "task", "f", "b", null.alias("y"))
        new = space.write(part.groupBy("task").cogroup(u.unionByName(i).groupBy("task")).applyInPandas(step, schema), f"e{epoch}")
        users = new.where("side = 0").select("idx", "task", "f", "b")
        w = new.where("side = 1").withColumn("w", F.col("n") + 1e-6)
        items = space.write(w.groupBy("idx").agg(mean("f"), (F.sum(F.col("b") * F.col("w")) / F.sum("w")).alias("b"), mean("y")), f"i{epoch}")
        if held is None:
            continue
        model = assembled(f"whole{epoch}")
        losses.append(observed_rmse(held, model))
        if losses[-1] < best_loss - min_delta:
            best, best_loss, stale = (model, items.select("idx", "y")), losses[-1], 0
        else:
            stale += 1
            if stale >= patience:
                break
    model, y = best or (assembled("whole"), items.select("idx", "y"))
    model.history = losses
    return model, y
