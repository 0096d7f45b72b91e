"""Random-intercept models fitted as Spark aggregates over level tables.

Model: y = X b + Z1 u1 (+ Z2 u2) + e.  Rows become sums per level of the first factor
(and per cell, with two factors).  For a variance ratio l1 = s1^2 / s^2 the first
factor is eliminated level by level: a level of n rows takes w = l1 / (1 + n l1) of
the products of its sums away, so every quantity of the likelihood is a grouped sum
over levels.  A round evaluates a grid of ratios for all models at once; the next one
looks at the neighbourhood of the best, and a parabola ends the search.  No task
holds a model's levels, whatever their number.

With a second (crossed) factor its levels stand as columns beside X, with 1 / l2 on
their diagonal; only the smaller factor is treated so (at most ``MOST_LEVELS``
levels), and for each l1 its ratio l2 is searched on that reduced matrix, a group of
at most (columns squared) numbers.  BLUPs come back by joins with the level tables.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

LOW, HIGH = -20.0, 12.0      # range of the log ratio
POINTS, ROUNDS = 65, 3        # grids of 0.5, 1 / 64 and 1 / 2048, then the vertex of a parabola
MOST_LEVELS = 1000           # of the smaller of two crossed factors
_FEW_MODELS = 100_000        # models whose search state is broadcast


def _grid(state: DataFrame, rows: DataFrame, n_models: int) -> DataFrame:
    """Rows once per log ratio (``t``) that their model looks at."""
    side = F.broadcast(state) if n_models <= _FEW_MODELS else state
    at = F.transform(F.sequence(F.lit(0), F.lit(POINTS - 1)),
                     lambda i: F.col("lo") + (F.col("hi") - F.col("lo")) * i / F.lit(float(POINTS - 1)))
    return rows.join(side, "__m").withColumn("t", F.explode(at)).drop("lo", "hi")


def _weight(n="n"):
    ratio = F.exp("t")
    return ratio / (1.0 + F.col(n) * ratio)


def _reduced(levels: DataFrame, p: int) -> list:
    """Aggregates over levels of what the elimination takes away, for the fixed columns."""
    w = _weight()
    out = [F.sum(F.log1p(F.col("n") * F.exp("t"))).alias("ld"), F.sum(w * F.col("sy") * F.col("sy")).alias("wyy")]
    for i in range(p):
        out.append(F.sum(w * F.col(f"sx_{i}") * F.col("sy")).alias(f"wxy_{i}"))
        out += [F.sum(w * F.col(f"sx_{i}") * F.col(f"sx_{j}")).alias(f"wxx_{i}_{j}") for j in range(i, p)]
    return out


def _square(pdf: pd.DataFrame, name: str, p: int) -> np.ndarray:
    m = np.zeros((len(pdf), p, p))
    for i in range(p):
        for j in range(i, p):
            m[:, i, j] = m[:, j, i] = pdf[f"{name}_{i}_{j}"]
    return m


def _fixed_part(pdf: pd.DataFrame, p: int):
    a = _square(pdf, "sxx", p) - _square(pdf, "wxx", p)
    b = np.stack([pdf[f"sxy_{i}"] - pdf[f"wxy_{i}"] for i in range(p)], axis=1)
    return a, b, (pdf["syy"] - pdf["wyy"]).to_numpy(float), pdf["N"].to_numpy(float), pdf["ld"].to_numpy(float)


def _solve(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    try:
        x = np.linalg.solve(a, b)
    except np.linalg.LinAlgError:
        return None
    return x if np.isfinite(x).all() else None


def _criterion(a, b, yy, n, ld, p: int, reml: bool) -> float:
    """-2 log likelihood but for constants; a matrix that can't be solved counts as the worst."""
    x = _solve(a, b)
    rss = -1.0 if x is None else yy - x @ b
    if rss <= 0 or n <= p:
        return 1e300
    if not reml:
        return n * math.log(rss / n) + ld
    sign, more = np.linalg.slogdet(a)
    return (n - p) * math.log(rss / (n - p)) + ld + more if sign > 0 else 1e300


def _inner(a, b, yy, n, ld, p: int, reml: bool, iters: int = 80):
    """Best log ratio of the second factor and its criterion, for a matrix reduced by the first."""
    szz, q = a[p:, p:], len(b) - p

    def value(t):
        c = a.copy()
        c[p:, p:] += np.eye(q) * math.exp(-t)
        more = np.linalg.slogdet(np.eye(q) + math.exp(t) * szz)[1]
        x = _solve(c, b)
        rss = -1.0 if x is None else yy - x @ b
        if rss <= 0 or n <= p:
            return 1e300
        if not reml:
            return n * math.log(rss / n) + ld + more
        fixed = np.linalg.slogdet(c)[1] - np.linalg.slogdet(c[p:, p:])[1]
        return (n - p) * math.log(rss / (n - p)) + ld + more + fixed

    ts = np.linspace(LOW, HIGH, 33)
    vs = [value(t) for t in ts]
    k = int(np.argmin(vs))
    lo, hi = ts[max(0, k - 1)], ts[min(len(ts) - 1, k + 1)]
    g = (math.sqrt(5) - 1) / 2
    c, d = hi - g * (hi - lo), lo + g * (hi - lo)
    fc, fd = value(c), value(d)
    for _ in range(iters):
        if fc < fd:
            hi, d, fd = d, c, fc
            c = hi - g * (hi - lo)
            fc = value(c)
        else:
            lo, c, fc = c, d, fd
            d = lo + g * (hi - lo)
            fd = value(d)
        if hi - lo < 1e-9:
            break
    return (lo + hi) / 2, min(fc, fd)


def _narrow(scored: DataFrame, last: bool) -> DataFrame:
    """Each model's next range (or, at last, the vertex of the parabola through the best point's neighbours)."""
    w = Window.partitionBy("__m").orderBy("t")  # POINTS rows
    beside = scored.withColumns({"tl": F.lag("t").over(w), "tr": F.lead("t").over(w),
                                 "cl": F.lag("crit").over(w), "cr": F.lead("crit").over(w)})
    best = beside.groupBy("__m").agg(F.min_by(F.struct("t", "crit", "tl", "tr", "cl", "cr"), F.struct("crit", "t")).alias("b")).select(
        "__m", "b.*")
    if not last:
        return best.select("__m", F.coalesce("tl", "t").alias("lo"), F.coalesce("tr", "t").alias("hi"))
    bend = F.col("cl") - 2 * F.col("crit") + F.col("cr")
    step = 0.5 * (F.col("cl") - F.col("cr")) / bend * (F.col("tr") - F.col("t"))
    ok = (bend > 1e-9) & F.col("tl").isNotNull() & F.col("tr").isNotNull()
    top = F.when(ok, F.col("t") + step).otherwise(F.col("t"))
    return best.select("__m", top.alias("lo"), top.alias("hi"))


def fit_levels(df: DataFrame, y: str, xs, groups, by, reml: bool, cells: DataFrame) -> DataFrame:
    """The fit in the long form of :func:`.mixed.mixed_model`, from the cell table of its sums."""
    by, groups, p = list(by), list(groups), len(xs) + 1
    sums = [c for c in cells.columns if c not in by and c not in groups]
    key = F.struct(*[F.col(b).alias(f"k{i}") for i, b in enumerate(by)]) if by else F.struct(F.lit(0).alias("k0"))
    cells = cut_lineage(cells.select(key.alias("__m"), *[F.col(g).alias(f"__g{i}") for i, g in enumerate(groups)], *sums), "mixed-cells")
    order = [0]
    if len(groups) == 2:
        n = cells.groupBy("__m").agg(*[F.count_distinct(F.coalesce(F.col(f"__g{i}").cast("string"), F.lit("\0"))).alias(f"q{i}")
                                       for i in (0, 1)]).agg(F.max("q0").alias("q0"), F.max("q1").alias("q1")).first()
        order = [0, 1] if (n["q0"] or 0) >= (n["q1"] or 0) else [1, 0]
        if min(n["q0"] or 0, n["q1"] or 0) > MOST_LEVELS:
            raise ValueError(f"both factors have more than {MOST_LEVELS} levels in a model")
    cells = cells.select("__m", F.col(f"__g{order[0]}").alias("__a"),
                         *([F.col(f"__g{order[1]}").alias("__b")] if len(groups) == 2 else []), *sums)
    levels = cells if len(groups) == 1 else cut_lineage(
        cells.groupBy("__m", "__a").agg(*[F.sum(c).alias(c) for c in sums]), "mixed-levels")
    total = levels.groupBy("__m").agg(F.sum("n").cast("double").alias("N"), *[F.sum(c).alias(c) for c in sums if c != "n" and not (
        c.startswith("sx_") or c == "sy")])
    total = cut_lineage(total, "mixed-totals")
    n_models = total.count()
    state = total.select("__m", F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi"))
    for turn in range(ROUNDS):
        if len(groups) == 1:
            grid = _grid(state, levels, n_models).groupBy("__m", "t").agg(*_reduced(levels, p)).join(total, "__m")
            scored = grid.mapInPandas(_score_single(p, reml), "__m " + total.schema["__m"].dataType.simpleString() + ", t double, crit double")
        else:
            scored = _crossed(cells, levels, total, state, n_models, p, reml, False)
        state = cut_lineage(_narrow(scored, turn == ROUNDS - 1), "mixed-search")
    final = state.select("__m", "lo", F.col("lo").alias("hi"))
    kind = total.schema["__m"].dataType.simpleString()
    found = f"__m {kind}, kind string, term int, level string, estimate double, vcov array<double>, ratio double"
    if len(groups) == 1:
        one = final.select("__m", F.col("lo").alias("t"))
        side = F.broadcast(one) if n_models <= _FEW_MODELS else one
        grid = levels.join(side, "__m").groupBy("__m", "t").agg(*_reduced(levels, p)).join(total, "__m")
        fit = cut_lineage(grid.mapInPandas(_solve_single(p, reml), found), "mixed-fit")
    else:
        fit = cut_lineage(_crossed(cells, levels, total, final, n_models, p, reml, True, found), "mixed-fit")
    return _long(fit, levels, cells, by, groups, order, xs, p, df)


def _score_single(p: int, reml: bool):
    def run(parts):
        for pdf in parts:
            a, b, yy, n, ld = _fixed_part(pdf, p)
            crit = [_criterion(a[i], b[i], yy[i], n[i], ld[i], p, reml) for i in range(len(pdf))]
            yield pd.DataFrame({"__m": pdf["__m"], "t": pdf["t"], "crit": crit})
    return run


def _solve_single(p: int, reml: bool):
    def run(parts):
        for pdf in parts:
            a, b, yy, n, _ = _fixed_part(pdf, p)
            rows = []
            for i in range(len(pdf)):
                x = _solve(a[i], b[i])
                x = np.full(p, np.nan) if x is None else x
                s2 = (yy[i] - x @ b[i]) / ((n[i] - p) if reml else n[i])
                v = s2 * np.linalg.pinv(a[i])
                m, t = pdf["__m"].iloc[i], float(pdf["t"].iloc[i])
                rows += [(m, "fixed", k, None, float(x[k]), v[k].tolist(), t) for k in range(p)]
                rows += [(m, "sigma2", -1, None, float(s2), None, t), (m, "sigma2", 0, None, float(s2 * math.exp(t)), None, t)]
            yield pd.DataFrame(rows, columns=["__m", "kind", "term", "level", "estimate", "vcov", "ratio"])
    return run


def _crossed(cells, levels, total, state, n_models: int, p: int, reml: bool, solve: bool, found: str = "") -> DataFrame:
    """Score (or solve) the two-factor model for every log ratio of the first factor."""
    points = state.select("__m", F.col("lo").alias("t")) if solve else None

    def dealt(rows):
        if solve:
            return rows.join(F.broadcast(points) if n_models <= _FEW_MODELS else points, "__m")
        return _grid(state, rows, n_models)

    fixed = dealt(levels).groupBy("__m", "t").agg(*_reduced(levels, p)).join(total, "__m")
    xs = [f"sx_{i}" for i in range(p)]
    sums = levels.select("__m", "__a", F.col("n").alias("nj"), *[F.col(c).alias(f"{c}_j") for c in xs], F.col("sy").alias("sy_j"))
    mine = cells.select("__m", "__a", F.col("__b").cast("string").alias("k"), "n", *xs, "sy")
    mine = mine.groupBy("__m", "__a", "k").agg(*[F.sum(c).alias(c) for c in ("n", *xs, "sy")])
    on = [mine["__m"] == sums["__m"], mine["__a"].eqNullSafe(sums["__a"])]
    each = mine.join(sums, on).select(mine["__m"], mine["__a"], "k", "n", *xs, "sy", "nj", *[f"{c}_j" for c in xs], "sy_j")
    w = _weight("nj")
    border = dealt(each).groupBy("__m", "t", "k").agg(
        F.sum(F.col("sy") - w * F.col("n") * F.col("sy_j")).alias("zy"),
        F.array(*[F.sum(F.col(c) - w * F.col("n") * F.col(f"{c}_j")) for c in xs]).alias("zx"), F.sum("n").alias("zn"))
    # pairs of the second factor's levels inside a level of the first: at most MOST_LEVELS squared a level
    other = mine.select(F.col("__m").alias("__m2"), F.col("__a").alias("__a2"), F.col("k").alias("l"), F.col("n").alias("n2"))
    pairs = each.select("__m", "__a", "k", "n", "nj").join(
        other, (F.col("__m") == F.col("__m2")) & F.col("__a").eqNullSafe(F.col("__a2"))).where(
        F.coalesce("k", F.lit("\0")) <= F.coalesce("l", F.lit("\0")))
    pairs = dealt(pairs).groupBy("__m", "t", "k", "l").agg(F.sum(w * F.col("n") * F.col("n2")).alias("c"))
    tagged = fixed.select("__m", "t", F.lit(0).alias("tag"), F.lit(None).cast("string").alias("k"), F.lit(None).cast("string").alias("l"),
                          F.lit(0.0).alias("v"), F.struct([c for c in fixed.columns if c not in ("__m", "t")]).alias("f"),
                          F.lit(None).cast("array<double>").alias("zx"), F.lit(0.0).alias("zn"))
    kind = tagged.schema["f"].dataType
    none = F.lit(None).cast(kind).alias("f")
    tagged = tagged.unionByName(border.select("__m", "t", F.lit(1).alias("tag"), "k", F.lit(None).cast("string").alias("l"),
                                              F.col("zy").alias("v"), none, "zx", F.col("zn").cast("double").alias("zn")))
    tagged = tagged.unionByName(pairs.select("__m", "t", F.lit(2).alias("tag"), "k", "l", F.col("c").alias("v"), none,
                                             F.lit(None).cast("array<double>").alias("zx"), F.lit(0.0).alias("zn")))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.loc[pdf["tag"] == 0, "f"].iloc[0]
        f = pd.DataFrame([f if isinstance(f, dict) else f.asDict()])
        a0, b0, yy, n, ld = _fixed_part(f, p)
        z = pdf[pdf["tag"] == 1].assign(name=lambda d: d["k"].fillna("\0")).sort_values("name")
        place = {k: i for i, k in enumerate(z["name"])}
        q = len(place)
        a, b = np.zeros((p + q, p + q)), np.concatenate([b0[0], z["v"].to_numpy(float)])
        a[:p, :p] = a0[0]
        a[:p, p:] = np.stack([np.asarray(v, float) for v in z["zx"]], axis=1)
        a[p:, :p] = a[:p, p:].T
        a[p:, p:] = np.diag(z["zn"].to_numpy(float))
        c = pdf[pdf["tag"] == 2]
        i, j = (c[s].fillna("\0").map(place).to_numpy() for s in ("k", "l"))
        v = c["v"].to_numpy(float)
        np.subtract.at(a, (p + i, p + j), v)
        off = i != j
        np.subtract.at(a, (p + j[off], p + i[off]), v[off])
        m, t = pdf["__m"].iloc[0], float(pdf["t"].iloc[0])
        best, crit = _inner(a, b, yy[0], n[0], ld[0], p, reml)
        if not solve:
            return pd.DataFrame({"__m": [m], "t": [t], "crit": [crit]})
        a[p:, p:] += np.eye(q) * math.exp(-best)
        x = _solve(a, b)
        x = np.full(p + q, np.nan) if x is None else x
        s2 = (yy[0] - x @ b) / ((n[0] - p) if reml else n[0])
        inv = s2 * np.linalg.pinv(a)
        rows = [(m, "fixed", r, None, float(x[r]), inv[r, :p].tolist(), t) for r in range(p)]
        rows += [(m, "sigma2", -1, None, float(s2), None, t), (m, "sigma2", 0, None, float(s2 * math.exp(t)), None, t),
                 (m, "sigma2", 1, None, float(s2 * math.exp(best)), None, t)]
        rows += [(m, "blup", 1, None if name == "\0" else name, float(x[p + r]), None, t) for name, r in place.items()]
        return pd.DataFrame(rows, columns=["__m", "kind", "term", "level", "estimate", "vcov", "ratio"])

    schema = found if solve else f"__m {total.schema['__m'].dataType.simpleString()}, t double, crit double"
    # at most (levels of the smaller factor) squared rows a group
    return tagged.groupBy("__m", "t").applyInPandas(one, schema)


def _long(fit: DataFrame, levels: DataFrame, cells: DataFrame, by, groups, order, xs, p: int, df: DataFrame) -> DataFrame:
    """Fixed effects, variances and BLUPs as rows; the first factor's BLUPs by joins with its levels."""
    names = F.array(*[F.lit(v) for v in ["intercept", *xs]])
    factors = F.array(*[F.lit(groups[i]) for i in order])
    fixed = fit.where("kind = 'fixed'")
    beta = fixed.groupBy("__m").agg(*[F.max(F.when(F.col("term") == i, F.col("estimate"))).alias(f"b{i}") for i in range(p)],
                                    F.max("ratio").alias("t"))
    line = levels.join(beta, "__m")
    left = F.col("sy")
    for i in range(p):
        left = left - F.col(f"sx_{i}") * F.col(f"b{i}")
    if len(groups) == 2:
        u2 = fit.where("kind = 'blup'").select(F.col("__m").alias("__m2"), F.col("level").alias("k"), F.col("estimate").alias("u2"))
        own = cells.join(u2, (F.col("__m") == F.col("__m2")) & F.col("__b").cast("string").eqNullSafe(F.col("k")))
        own = own.groupBy(F.col("__m").alias("__m3"), F.col("__a").alias("__a3")).agg(F.sum(F.col("n") * F.col("u2")).alias("zu"))
        line = line.join(own, (F.col("__m") == F.col("__m3")) & F.col("__a").eqNullSafe(F.col("__a3")))
        left = left - F.col("zu")
    first = line.select("__m", F.lit("blup").alias("kind"), F.lit(groups[order[0]]).alias("term"),
                        F.col("__a").cast("string").alias("level"), (_weight() * left).alias("estimate"),
                        F.lit(None).cast("array<double>").alias("vcov"))
    told = fit.select("__m", "kind", F.when(F.col("kind") == "fixed", F.get(names, F.col("term")))
                      .when(F.col("term") < 0, F.lit("residual")).otherwise(F.get(factors, F.col("term"))).alias("term"),
                      "level", "estimate", "vcov")
    out = told.unionByName(first)
    types = {f.name: f.dataType for f in df.schema.fields}
    return out.select(*[F.col(f"__m.k{i}").cast(types.get(b, T.StringType())).alias(b) for i, b in enumerate(by)],
                      "kind", "term", "level", "estimate", "vcov")
