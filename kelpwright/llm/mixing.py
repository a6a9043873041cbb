"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the (source, language, topic) cells are raked to the marginals
in turn, the sources last, under each source's cap on repeats.  Documents are
then drawn with the calibrated weights as expected copies: the whole part is
taken for sure, the rest by a threshold on hash / fraction that is set, source
by source, where the drawn tokens meet the target.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bins of each of the two histograms that place a source's threshold.
_BINS = 4096
#: Cells that the driver may rake, and sources that may be listed.
MAX_CELLS, MAX_SOURCES = 1_000_000, 10_000


def fill_to(weight: np.ndarray, tokens: np.ndarray, cap: float, target: float) -> np.ndarray:
    """Scale the weights to ``target`` tokens, none above ``cap``."""
    target = min(target, cap * tokens.sum())
    weight = np.maximum(weight, 1e-12)
    for _ in range(100):
        free = weight < cap
        rest = target - cap * tokens[~free].sum()
        have = (weight * tokens)[free].sum()
        if not free.any() or have <= 0:
            break
        weight = np.where(free, weight * max(rest, 0) / have, cap)
        if (weight <= cap).all():
            break
        weight = np.minimum(weight, cap)
    return np.minimum(weight, cap)


def rake(tokens: np.ndarray, source: np.ndarray, cap: np.ndarray, target: np.ndarray, margins: Sequence[tuple[np.ndarray, np.ndarray]], steps: int = 200) -> np.ndarray:
    """Expected copies per cell.

    ``tokens``, ``source``: by cell; ``cap``, ``target`` (tokens): by source;
    ``margins``: (class of each cell, target share of each class) pairs.
    """
    weight = (target / np.maximum(1, np.bincount(source, tokens, len(cap))))[source]
    total = target.sum()
    for _ in range(steps):
        before = weight
        for of, share in margins:
            have = np.bincount(of, weight * tokens, len(share))
            weight = np.minimum(weight * np.divide(share * total, have, out=np.ones_like(have), where=have > 0)[of], cap[source])
        for s in range(len(cap)):
            own = source == s
            if own.any():
                weight = weight.copy()
                weight[own] = fill_to(weight[own], tokens[own], cap[s], target[s])
        if np.max(np.abs(weight - before), initial=0) < 1e-9:
            break
    return weight


def _targets(share: np.ndarray, cap: np.ndarray, supply: np.ndarray, total: float | None) -> np.ndarray:
    """Tokens wanted of each source: its share of the total, as far as it goes.

    Without a total, the largest at which every source with documents can give
    its share of what sources with documents are to give.
    """
    live = (supply > 0) & (share > 0) & (cap > 0)
    if not live.any():
        return np.zeros(len(share))
    share = np.where(live, share, 0) / share[live].sum()
    if total is None:
        total = (cap * supply)[live] / share[live]
        total = float(total.min())
    return np.minimum(share * total, cap * supply)


def mix_sources(
    sized: DataFrame, targets: DataFrame, strata: Sequence[str] = ("lang", "topic"), total_tokens: float | None = None,
    margins: Mapping[str, Mapping[str, float]] | None = None, seed: int = 11,
) -> DataFrame:
    """``sized`` with ``copies``: the documents of the mix, each at least once.

    ``sized``: doc_id, source, n_tokens and the strata; ``targets``: source,
    target_share, max_repeats.  A stratum's marginal is its share of the tokens
    of all listed sources unless ``margins`` gives one.  Source totals come
    within about a document of their targets; marginals are met as far as the
    caps and the source targets allow.  ``copies`` never exceeds max_repeats; a
    column of that name in ``sized`` is replaced, other columns are kept.

    Documents with a null id or source, of an unlisted source, or without
    tokens are not in the mix; null strata are a stratum of their own; a listed
    source without documents gives nothing and its share is spread over the
    others in proportion; repeated rows are documents of their own.  Of a source
    listed twice the larger share counts; null shares and caps are 0.

    Sums are pre-aggregated per cell and per histogram bin; only these, bounded
    by MAX_CELLS and MAX_SOURCES (more raise an error), reach the driver.
    """
    wanted = (
        targets.where("source IS NOT NULL").groupBy("source").agg(F.max(F.struct(F.coalesce("target_share", F.lit(0.0)), F.coalesce("max_repeats", F.lit(0)))).alias("t"))
        .orderBy("source").limit(MAX_SOURCES + 1).collect()
    )
    if len(wanted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    names = [r["source"] for r in wanted]
    place = {name: k for k, name in enumerate(names)}
    share, cap = (np.array([max(0.0, float(r["t"][i])) for r in wanted]) for i in (0, 1))
    own = sized.where(F.col("doc_id").isNotNull() & (F.col("n_tokens") > 0) & F.col("source").isin(names))
    own = own.withColumns({f"__mix_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata})
    key = ["source", *(f"__mix_{c}" for c in strata)]
    cells = own.groupBy(*key).agg(F.sum("n_tokens").alias("tokens")).orderBy(*key).limit(MAX_CELLS + 1).collect()
    if len(cells) > MAX_CELLS:
        raise ValueError(f"more than {MAX_CELLS} cells of {key}: coarsen the strata")
    columns = [c for c in sized.columns if c != "copies"]
    nothing = own.select(*columns, F.lit(0).alias("copies")).limit(0)
    if not cells:
        return nothing

    tokens = np.array([r["tokens"] for r in cells], float)
    source = np.array([place[r["source"]] for r in cells])
    goal = _targets(share, cap, np.bincount(source, tokens, len(names)), total_tokens)
    if not goal.any():
        return nothing
    classes = []
    for c in strata:
        values, of = np.unique([r[f"__mix_{c}"] for r in cells], return_inverse=True)
        given = (margins or {}).get(c)
        part = np.array([given.get(v, 0.0) for v in values]) if given else np.bincount(of, tokens)
        classes.append((of, part / max(part.sum(), 1e-300)))
    weight = rake(tokens, source, cap, goal, classes)

    spark = sized.sparkSession
    sure = np.floor(weight + 1e-9)
    rows = [(*(r[k] for k in key), int(b), float(max(0.0, w - b))) for r, b, w in zip(cells, sure, weight, strict=True)]
    plan = spark.createDataFrame(rows, ", ".join(f"`{k}` string" for k in key) + ", __sure int, __part double")
    # At most MAX_CELLS rows, but few as a rule: let their size choose the join.
    drawn = own.join(plan, key)
    uniform = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(2**53))
    odds = uniform / F.col("__part")
    drawn = drawn.withColumn("__u", F.when(F.col("__part") > 0, odds / (1 + odds)).otherwise(F.lit(1.0)))

    extra = goal - np.bincount(source, sure * tokens, len(names))
    low, width = np.zeros(len(names)), np.ones(len(names))
    for _ in range(2):  # find the bin where each source meets its target, then the bin within it
        bounds = spark.createDataFrame([(s, float(a), float(w)) for s, a, w in zip(names, low, width, strict=True)], "source string, __low double, __width double")
        bin_ = F.floor((F.col("__u") - F.col("__low")) / F.col("__width") * _BINS).cast("int")
        binned = drawn.where("__part > 0").join(F.broadcast(bounds), "source").withColumn("__bin", bin_).where(F.col("__bin") < _BINS)
        binned = binned.withColumn("__bin", F.greatest("__bin", F.lit(-1))).groupBy("source", "__bin").agg(F.sum("n_tokens").alias("t")).collect()
        sums = np.zeros((len(names), _BINS + 1))
        for r in binned:
            sums[place[r["source"]], r["__bin"] + 1] += r["t"]
        upto = np.cumsum(sums, 1)  # tokens below each bin's lower bound, then below the end
        last = np.array([np.argmin(np.abs(row - e)) if e > 0 else 0 for row, e in zip(upto, extra, strict=True)])
        if _ == 0:
            last = np.array([max(0, int(np.searchsorted(row, e)) - 1) if e > 0 else 0 for row, e in zip(upto, extra, strict=True)])
            last = np.minimum(last, _BINS - 1)
        low = low + last * width / _BINS
        width = width / _BINS
    cut = spark.createDataFrame([(s, float(a)) for s, a in zip(names, low, strict=True)], "source string, __cut double")
    copies = (F.col("__sure") + ((F.col("__u") < F.col("__cut")) & (F.col("__part") > 0)).cast("int")).alias("copies")
    return drawn.join(F.broadcast(cut), "source").select(*columns, copies).where("copies > 0")


def reached_shares(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """Per listed source: target and reached share, tokens, documents, copies."""
    per = mix.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    filled = targets.join(per, "source", "left")
    total = F.sum("tokens").over(Window.partitionBy())  # over the rows of targets, one a source
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("tokens", "documents", "most_copies")}
    return filled.withColumns(zero).select(
        "source", "target_share", F.coalesce(F.try_divide("tokens", total), F.lit(0.0)).alias("reached_share"), "max_repeats", "tokens", "documents", "most_copies"
    )
