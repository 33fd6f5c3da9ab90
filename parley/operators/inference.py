"""Tests and models from sufficient statistics: Spark aggregates, closed forms finish a row a comparison."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.functions import special


def _p(f, *args: Column) -> Column:
    """A tail probability, computed once for each compared group, never for each observation."""
    whole = lambda *x: None if any(v is None or math.isnan(v) for v in x) else float(f(*x))
    return F.udf(whole, "double")(*[a.cast("double") for a in args])


def moments(rows: DataFrame, group: str, value: str, by: list[str] = ()) -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy(*by, group).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var"))


def against(stats: DataFrame, group: str, baseline: str) -> DataFrame:
    """Every other group's moments next to the baseline's (n0, mean0, var0), which is one row."""
    base = stats.filter(F.col(group) == baseline).select(*[F.col(c).alias(c + "0") for c in ("n", "mean", "var")])
    return stats.filter(F.col(group) != baseline).crossJoin(F.broadcast(base))


def welch(rows: DataFrame, group: str, value: str, baseline: str) -> DataFrame:
    """group, n, n0, t, df, p, d: each group against the baseline; d by the pooled variance, null below two values
    or without spread."""
    s = against(moments(rows, group, value), group, baseline)
    a, b = F.col("var") / F.col("n"), F.col("var0") / F.col("n0")
    t = F.try_divide(F.col("mean") - F.col("mean0"), F.sqrt(a + b))
    df = F.try_divide((a + b) * (a + b), a * a / (F.col("n") - 1) + b * b / (F.col("n0") - 1))
    pooled = F.sqrt(((F.col("n") - 1) * F.col("var") + (F.col("n0") - 1) * F.col("var0")) / (F.col("n") + F.col("n0") - 2))
    ok = (F.col("n") > 1) & (F.col("n0") > 1)
    out = s.filter(ok).withColumns({"t": t, "df": df, "d": F.try_divide(F.col("mean") - F.col("mean0"), pooled)})
    return out.withColumn("p", _p(special.t_two_sided, F.col("t"), F.col("df"))).select(group, "n", "n0", "t", "df", "p", "d")


def _place(value: Column) -> Column:
    """A whole number that grows with the value: sign, exponent and 8 bits below it. So values are told into places of
    1/256 of their size, the same wherever and whenever it is computed."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    own = (exponent + 1100) * 256 + F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * 256) + 1
    whole = F.when(value == 0, 0).when(size == float("inf"), 1 << 30).otherwise(own)
    return F.when(F.isnan(value), 1 << 31).otherwise(F.when(value < 0, -whole).otherwise(whole)).cast("long")


def _below(counts: DataFrame, value: str, n: str, within: list[str], below: str, equal: str) -> DataFrame:
    """counts with how many of n there are below each row's value, and at it, within; rows may share a value.

    Sums run over the rows of a place of values, and over the places, which are counted first: so no window has all values of
    a comparison, and the rows themselves take no part.
    """
    placed = counts.withColumn("__place", _place(F.col(value).cast("double")))
    at = Window.partitionBy(*within, "__place")
    held = placed.groupBy(*within, "__place").agg(F.sum(n).alias("__held"))
    before = F.sum("__held").over(Window.partitionBy(*within).orderBy("__place").rowsBetween(Window.unboundedPreceding, -1))
    held = held.select(*[F.col(c).alias(f"__{c}") for c in within], F.col("__place").alias("__there"), F.coalesce(before, F.lit(0)).alias("__before"))
    same = F.col("__place") == F.col("__there")
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    out = placed.withColumns({equal: F.sum(n).over(Window.partitionBy(*within, "__place", value)), "__upto": F.sum(n).over(at.orderBy(value))})
    return out.join(held, same).withColumn(below, F.col("__before") + F.col("__upto") - F.col(equal)).drop("__place", "__there", "__before", "__upto", *[f"__{c}" for c in within])


def ranked_values(rows: DataFrame, value: str, within: list[str], also: list[str] = (), name: str = "rank") -> DataFrame:
    """within, also, value, __n, mean rank and ties: values and how often they stand, instead of rows. Ranks are those within."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*within, *also, value).agg(F.count("*").alias("__n"))
    ranked = _below(counts, value, "__n", within, "__below", f"{name}_ties")
    return ranked.withColumn(name, F.col("__below") + (F.col(f"{name}_ties") + 1) / 2).drop("__below")


def mann_whitney(rows: DataFrame, group: str, value: str, baseline: str, by: list[str] = ()) -> DataFrame:
    """by, group, n, n0, U, p: two-sided, each group against the baseline, each value of by apart.

    U adds, over a group's values, the baseline's values below and half of those equal; ties are the baseline's, and what a group changes in
    them. So the baseline's values are summed up once for all groups.
    """
    by = list(by)
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, group, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    is_base = F.col(group) == baseline
    known = _below(counts.withColumn("m", F.when(is_base, F.col("n")).otherwise(0)), "v", "m", by, "less", "same")
    tied = lambda t: (t * t * t - t).cast("double")
    sums = known.groupBy(*by, group).agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * (F.col("less") + F.col("same") / 2)).alias("U"), F.sum(tied(F.col("n") + F.col("same")) - tied(F.col("same"))).alias("more"), F.sum(tied(F.col("n"))).alias("own"),
    )
    base = sums.filter(is_base).select(*by, F.col("n").alias("n0"), F.col("own").alias("ties0"))
    others = sums.filter(~is_base)
    s = others.join(F.broadcast(base), by) if by else others.crossJoin(F.broadcast(base))  # a row for each value of by
    p = _p(lambda u, n, m, ties: special.mann_whitney(u, int(n), int(m), ties), F.col("U"), F.col("n"), F.col("n0"), F.col("ties0") + F.col("more"))
    return s.withColumn("p", p).select(*by, group, "n", "n0", "U", "p")


def spearman(rows: DataFrame, x: str, y: str, within: list[str]) -> DataFrame:
    """within, n, rho, p: correlation of mean ranks, from the counts of pairs of values."""
    both = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pairs = both.groupBy(*within, x, y).agg(F.count("*").alias("n"))
    for v, name in ((x, "rx"), (y, "ry")):
        pairs = pairs.join(ranked_values(both, v, within, name=name).drop("__n", f"{name}_ties"), [*within, v])  # a row a value: where one holds most pairs, those are split
    n, total = F.col("n"), lambda c: F.sum(F.col("n") * c)
    s = pairs.groupBy(*within).agg(F.sum(n).alias("N"), *[total(F.col(c)).alias(c) for c in ("rx", "ry")], *[total(F.col(a) * F.col(b)).alias(a + b) for a, b in (("rx", "rx"), ("ry", "ry"), ("rx", "ry"))])
    spread = lambda a, b: F.col(a + b) - F.col(a) * F.col(b) / F.col("N")
    out = s.select(*within, F.col("N").alias("n"), F.try_divide(spread("rx", "ry"), F.sqrt(spread("rx", "rx") * spread("ry", "ry"))).alias("rho"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    p = F.when(F.abs("rho") >= 1, 0.0).otherwise(_p(special.t_two_sided, t, F.col("n") - 2))
    return out.withColumn("p", F.when(F.col("n") > 2, p))


def kruskal(rows: DataFrame, group: str, value: str, within: list[str]) -> DataFrame:
    """within, H, groups, p with tie correction."""
    ranked, t = ranked_values(rows, value, within, [group]), F.col("rank_ties")
    sums = ranked.groupBy(*within, group).agg(F.sum("__n").alias("n"), F.sum(F.col("__n") * F.col("rank")).alias("r"), F.sum(F.col("__n") * (t * t - 1)).cast("double").alias("ties"))
    s = sums.groupBy(*within).agg(F.sum("n").alias("N"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"), F.sum("ties").alias("ties"), F.count("*").alias("groups"))
    n = F.col("N")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    return s.filter("groups > 1").withColumn("H", h).withColumn("p", _p(special.chi2_upper, F.col("H"), F.col("groups") - 1)).select(*within, "H", "groups", "p")


def closest(means: DataFrame, group: str, value: str, baseline: str, within: list[str]) -> DataFrame:
    """Distance of every group's mean to the baseline's, and which is the closest."""
    base = means.filter(F.col(group) == baseline).agg(F.avg(value).alias("base"))
    far = means.filter(F.col(group) != baseline).crossJoin(F.broadcast(base)).withColumn("distance", F.abs(F.col(value) - F.col("base")))
    best = far.groupBy(*within).agg(F.min_by(group, F.struct("distance", group)).alias("closest"))
    return far.join(best, within).select(*within, group, "distance", "closest")


def omnibus(rows: DataFrame, group: str, value: str, baseline: str, by: list[str] = ()) -> DataFrame:
    """value ~ group with the baseline as reference, each value of by apart: by, F, its p, and for each group coefficient, t and p.
    The reference's coefficient is its mean."""
    by = list(by)
    s = moments(rows, group, value, by)
    total = s.groupBy(*by).agg(
        F.sum("n").alias("all_n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"), F.sum((F.col("n") - 1) * F.coalesce("var", F.lit(0.0))).alias("within"),
        F.max(F.when(F.col(group) == baseline, F.struct("n", "mean"))).alias("base"),
    )
    beside = lambda a, b: a.join(F.broadcast(b), by) if by else a.crossJoin(F.broadcast(b))  # noqa: E731  b: a row for each value of by
    between = beside(s, total.select(*by, "grand")).groupBy(*by).agg(F.sum(F.col("n") * (F.col("mean") - F.col("grand")) ** 2).alias("between"))
    full = beside(s, beside(total, between))
    mse = F.try_divide(F.col("within"), F.col("all_n") - F.col("k"))
    is_base = F.col(group) == baseline
    coef = F.when(is_base, F.col("mean")).otherwise(F.col("mean") - F.col("base.mean"))
    se = F.sqrt(mse * F.when(is_base, 1 / F.col("n")).otherwise(1 / F.col("n") + 1 / F.col("base.n")))
    out = full.withColumns({"F": F.try_divide(F.col("between") / (F.col("k") - 1), mse), "df1": F.col("k") - 1, "df2": F.col("all_n") - F.col("k"), "coef": coef, "t": F.try_divide(coef, se)})
    return out.withColumns({"p": _p(special.t_two_sided, F.col("t"), F.col("df2")), "p_F": _p(special.f_upper, F.col("F"), F.col("df1"), F.col("df2"))}).select(*by, group, "F", "df1", "df2", "p_F", "coef", "t", "p")


def vif(rows: DataFrame, columns: list[str]) -> list[tuple[str, float]]:
    """Variance inflation of each column: the diagonal of the inverse correlation matrix, from one aggregate."""
    pairs = [(a, b) for a in columns for b in columns]
    got = rows.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")) for a, b in pairs]).first()
    r = np.array(got, float).reshape(len(columns), -1)
    return list(zip(columns, np.diag(np.linalg.pinv(r)).tolist()))


def mixed_model(rows: DataFrame, y: str, group: str, factors: list[str]) -> list[dict]:
    """y ~ product of two-level 0/1 factors + (1 | group) by REML, with Wald p."""
    return _reml(_folded(rows, y, group, factors, []).collect(), factors)  # one row a pattern of counts


def mixed_models(rows: DataFrame, y: str, group: str, factor: str, factors: list[str], by: str, baseline: str, first: int = 0) -> list[dict]:
    """For each value of by other than the baseline, with its name: the model over its rows and the baseline's, in which
    factor is 1 - first for that value and first for the baseline. Groups must not reach across values of by."""
    marked = rows.withColumn(factor, F.when(F.col(by) == baseline, first).otherwise(1 - first))
    folded: dict[str, list] = {}
    for r in _folded(marked, y, group, [factor, *factors], [by]).collect():  # one row a value and pattern of counts
        folded.setdefault(r[by], []).append(r)
    base = folded.pop(baseline, [])
    return [{by: name, **term} for name, own in sorted(folded.items()) if base for term in _reml([*base, *own], [factor, *factors])]


def _products(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(k) for b in range(a, k)]


def _folded(rows: DataFrame, y: str, group: str, factors: list[str], by: list[str]) -> DataFrame:
    """What REML needs: for each group and cell of the factors count, sum and sum of squares, folded to moments for
    each distinct pattern of cell counts."""
    own = rows.filter(F.col(y).isNotNull()).withColumn("cell", sum(((F.col(f).cast("long") * (1 << i)) for i, f in enumerate(factors)), F.lit(0)))
    k = 1 << len(factors)
    cells = own.groupBy(*by, group).agg(
        *[F.count_if(F.col("cell") == c).alias(f"n{c}") for c in range(k)], *[F.coalesce(F.sum(F.when(F.col("cell") == c, F.col(y))), F.lit(0.0)).cast("double").alias(f"s{c}") for c in range(k)],
        F.sum(F.col(y) * F.col(y)).cast("double").alias("yy"),
    )
    return cells.groupBy(*by, *[f"n{c}" for c in range(k)]).agg(
        F.count("*").alias("m"), *[F.sum(f"s{c}").alias(f"S{c}") for c in range(k)], *[F.sum(F.col(f"s{a}") * F.col(f"s{b}")).alias(f"P{a}_{b}") for a, b in _products(k)], F.sum("yy").alias("yy"),
    )


def _reml(folded: list, factors: list[str]) -> list[dict]:
    """The likelihood, profiled over the ratio of the variances. Terms that the cells don't tell apart share by the
    pseudo-inverse. The ratio is where the slope of the profile changes sign: its values near the least tell no more than
    half of a number's digits."""
    k = 1 << len(factors)
    pattern = [f"n{c}" for c in range(k)]
    design = np.array([[float((c & t) == t) for t in range(k)] for c in range(k)])  # cell -> intercept, main effects, interactions
    n = np.array([[r[p] for p in pattern] for r in folded], float)
    m = np.array([r["m"] for r in folded], float)
    total = n.sum(1)
    sums = np.array([[r[f"S{c}"] for c in range(k)] for r in folded], float)
    full = np.array([[[r[f"P{min(a, b)}_{max(a, b)}"] for b in range(k)] for a in range(k)] for r in folded], float)
    yy = sum(r["yy"] for r in folded)
    big, xn = float((m * total).sum()), n @ design

    def fit(gamma: float):
        w = gamma / (1 + gamma * total)
        a = sum(mi * (design.T @ (ni[:, None] * design) - wi * np.outer(x, x)) for mi, ni, wi, x in zip(m, n, w, xn))
        b = sum(design.T @ s - wi * x * s.sum() for s, wi, x in zip(sums, w, xn))
        q = yy - float((w * full.sum((1, 2))).sum())
        inverse = np.linalg.pinv(a)
        beta = inverse @ b
        rest, df = max(q - b @ beta, 1e-300), big - k
        value = df * math.log(rest / df) + float((m * np.log1p(gamma * total)).sum()) + np.linalg.slogdet(a)[1]
        dw = 1 / (1 + gamma * total) ** 2
        da = -sum(mi * di * np.outer(x, x) for mi, di, x in zip(m, dw, xn))
        db = -sum(di * x * s.sum() for s, di, x in zip(sums, dw, xn))
        dq = -float((dw * full.sum((1, 2))).sum())
        slope = df * (dq - 2 * db @ beta + beta @ da @ beta) / rest + float((m * total / (1 + gamma * total)).sum()) + np.trace(inverse @ da)
        return value, slope, beta, inverse, rest / df

    grid = [0.0, *np.exp(np.linspace(-10, 7, 60))]
    best = min(range(len(grid)), key=lambda i: fit(grid[i])[0])
    lo, hi = grid[max(0, best - 1)], grid[min(len(grid) - 1, best + 1)]
    if fit(lo)[1] >= 0:
        hi = lo
    for _ in range(80):  # bisection
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if fit(mid)[1] < 0 else (lo, mid)
    _, _, beta, inverse, sigma2 = fit((lo + hi) / 2)
    names = ["intercept", *(":".join(f for i, f in enumerate(factors) if t >> i & 1) for t in range(1, k))]
    se = np.sqrt(np.maximum(np.diag(inverse) * sigma2, 0))
    return [{"term": t, "coef": float(c), "se": float(s), "z": float(c / s) if s else None, "p": special.normal_two_sided(c / s) if s else None, "group_var": float((lo + hi) / 2 * sigma2), "residual_var": float(sigma2)} for t, c, s in zip(names, beta, se)]
