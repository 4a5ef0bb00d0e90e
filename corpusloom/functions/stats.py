"""Statistics with their rules spelled out: five quantile conventions, intervals, agreement, guarded correlation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % points of Student's t for 1 to 30 degrees of freedom; 1.96 beyond.
T_95 = [12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228, 2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086, 2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042]
Z_95 = 1.96


def t_95(n: Column) -> Column:
    """The t value of n observations; null for fewer than two."""
    table = F.array(*map(F.lit, T_95))
    return F.when(n < 2, None).when(n - 1 <= len(T_95), F.try_element_at(table, (n - 1).cast("int"))).otherwise(Z_95)


#: Groups with more distinct values than this are cut into buckets, so that no task sorts a group of any size.
WHOLE, BUCKETS = 100_000, 200


def cumulative(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, c, upto: the rows of each distinct value and of all values up to it, exactly, for groups of any size.

    Rows are counted by value first. A group of more than ``WHOLE`` values is cut at approximate quantiles into buckets;
    a bucket's values are summed up in one task and the buckets' totals before it are added. The cuts only spread the
    work: the sums don't depend on where they lie.
    """
    counted = df.groupBy(*keys, value).agg(F.count("*").alias("c"))
    wide = counted.groupBy(*keys).agg(F.count("*").alias("__k")).filter(F.col("__k") > WHOLE).select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__wide"))
    same = lambda frame: [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    marks = [i / BUCKETS for i in range(1, BUCKETS)]
    cuts = (
        counted.join(wide, same(wide), "inner").groupBy(*keys)
        .agg(F.percentile_approx(F.col(value).cast("double"), marks, 2000).alias("__cuts")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__cuts")
    )
    placed = counted.join(cuts, same(cuts), "left").withColumn("__b", F.coalesce(F.size(F.filter("__cuts", lambda x: x < F.col(value).cast("double"))), F.lit(0))).select(*keys, value, "c", "__b")
    totals = placed.groupBy(*keys, "__b").agg(F.sum("c").alias("__t"))
    before = F.coalesce(F.sum("__t").over(Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__bb"), before.alias("__before"))
    inside = placed.withColumn("__in", F.sum("c").over(Window.partitionBy(*keys, "__b").orderBy(value)))
    joined = inside.join(offsets, [*same(offsets), F.col("__b") == F.col("__bb")])
    return joined.select(*keys, value, "c", (F.col("__in") + F.col("__before")).alias("upto"))


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, qs: dict[str, tuple[str, float]]) -> DataFrame:
    """keys + one column a name -> (rule, q), exact for groups of any size.

    Rules: half_even ``v[round(q(n-1))]`` (Q2), ceil ``v[ceil(qn)-1]`` (Q3), upper ``v[n//2]`` (Q4), linear at q(n-1) (Q1;
    Q5 is linear at 0.5). Each asks for one or two ranks, which the cumulative counts answer. Null values are left out,
    a group without values isn't in the result.
    """
    up = cumulative(df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v")), keys, "__v")
    sizes = up.groupBy(*keys).agg(F.max("upto").alias("__n")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__n")
    placed = up.join(sizes, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])

    def at(rank: Column) -> Column:
        return F.min(F.when(F.col("upto") >= rank, F.col("__v")))

    n = F.col("__n")
    picks = []
    for name, (rule, q) in qs.items():
        if rule == "linear":
            pos = F.lit(q) * (n - 1)
            low, high = at(F.floor(pos) + 1), at(F.ceil(pos) + 1)
            part = F.max(pos - F.floor(pos))
            picks.append((low + (high - low) * part).alias(name))
        else:
            rank = F.bround(q * (n - 1)).cast("bigint") + 1 if rule == "half_even" else F.greatest(F.ceil(q * n), F.lit(1)) if rule == "ceil" else F.floor(n / 2) + 1
            picks.append(at(rank).alias(name))
    return placed.groupBy(*keys).agg(*picks)


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3) -> DataFrame:
    """keys, n, rho over the pairs without nulls: Pearson's r of the average ranks.

    Equal pairs are counted before anything is ranked, and ranks come from cumulative counts, so neither ties nor large
    groups meet in one task.
    """
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys, F.col(x).alias("__x"), F.col(y).alias("__y")).agg(F.count("*").alias("__w"))
    ranked = pairs
    for side in ("__x", "__y"):
        # rows of the side's values, with their weights spread again as counts
        values = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, F.col(x if side == "__x" else y).alias(side))
        up = cumulative(values, keys, side)
        ranks = up.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(side).alias(f"_{side}"), (F.col("upto") - (F.col("c") - 1) / 2.0).alias(f"r{side}"))
        ranked = ranked.join(ranks, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col(side) == F.col(f"_{side}")]).drop(*[f"_{k}" for k in keys], f"_{side}")
    w, a, b = F.col("__w"), F.col("r__x"), F.col("r__y")
    n = F.sum(w)
    ma, mb = F.sum(w * a) / n, F.sum(w * b) / n
    sums = ranked.groupBy(*keys).agg(n.alias("n"), ma.alias("ma"), mb.alias("mb"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"), (F.min(a) == F.max(a)).alias("ca"), (F.min(b) == F.max(b)).alias("cb"))
    k = F.col("n")
    cov, va, vb = F.col("ab") - k * F.col("ma") * F.col("mb"), F.col("aa") - k * F.col("ma") * F.col("ma"), F.col("bb") - k * F.col("mb") * F.col("mb")
    rho = F.when((k >= least) & ~F.col("ca") & ~F.col("cb"), F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    return sums.select(*keys, "n", rho.alias("rho"))


def guarded_corr(x: str, y: str, least: int = 3) -> Column:
    """Pearson's r; null under ``least`` pairs or where a side is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x).cast("double")), F.when(both, F.col(y).cast("double"))
    n = F.count(a)
    cov = F.sum(a * b) * n - F.sum(a) * F.sum(b)
    va, vb = F.sum(a * a) * n - F.sum(a) * F.sum(a), F.sum(b * b) * n - F.sum(b) * F.sum(b)
    constant = (F.min(a) == F.max(a)) | (F.min(b) == F.max(b))
    return F.when((n >= least) & ~constant, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """The 95 % interval of a share; null where n is 0."""
    p, z2 = F.try_divide(hits, n), Z_95**2
    mid, wide = p + z2 / (2 * n), Z_95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    ok = n > 0
    return F.when(ok, F.greatest(F.lit(0.0), (mid - wide) / (1 + z2 / n))), F.when(ok, F.least(F.lit(1.0), (mid + wide) / (1 + z2 / n)))


def cohen_kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, observed, expected, kappa of two labels; rows with a null label are left out.

    The crosstab has at most the square of the labels' number of rows, whatever the data.
    """
    cells = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("la"), F.col(b).alias("lb")).agg(F.count("*").alias("c"))
    left = cells.groupBy(F.col("la").alias("l")).agg(F.sum("c").alias("x"), F.sum(F.when(F.col("la") == F.col("lb"), F.col("c")).otherwise(0)).alias("same"))
    right = cells.groupBy(F.col("lb").alias("l")).agg(F.sum("c").alias("y"))
    met = left.join(right, "l", "full_outer").agg(F.sum("x").alias("n"), F.sum("same").alias("same"), F.sum(F.col("x") * F.col("y")).alias("xy"))
    observed, expected = F.try_divide("same", "n"), F.coalesce(F.try_divide(F.col("xy"), F.col("n") * F.col("n")), F.lit(0.0))
    return met.select("n", observed.alias("observed"), expected.alias("expected"), F.when(expected < 1, F.try_divide(observed - expected, 1 - expected)).alias("kappa"))


def standard_error(sd: Column, n: Column) -> Column:
    return F.try_divide(sd, F.sqrt(n))
