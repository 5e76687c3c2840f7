"""Table functions: histograms, clusters, Pareto shares."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(values: DataFrame, column: str, bins: int) -> DataFrame:
    """bin_low, bin_high, count, frequency of equally wide bins; nulls are left out and empty bins are there.

    One aggregation finds the range and one counts by bin; no rows are sorted or gathered.
    """
    some = values.select(F.col(column).cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = some.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    place = F.when(F.col("w") > 0, F.least(F.floor((F.col("x") - F.col("lo")) / F.col("w")), F.lit(bins - 1))).otherwise(0)
    counts = some.crossJoin(F.broadcast(ends)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("count"))  # ends is one row
    every = ends.where("n > 0").select("lo", "w", "n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counts, "bin", "left").select(
        (F.col("lo") + F.col("bin") * F.col("w")).alias("bin_low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_high"),
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        (F.coalesce("count", F.lit(0)) / F.col("n")).alias("frequency"),
    )


#: Rows that a Pareto order is cut at, a power of two less one; there is one range more.
CUTS = 127


def _place(x: str, ties: list[str]) -> str:
    """A row's place in a Pareto order: large values first, nulls last, then the ties."""
    fields = [f"'n', ({x}) IS NULL", f"'x', -({x})", *(f"'t{i}', {t}" for i, t in enumerate(ties))]
    return f"named_struct({', '.join(fields)})"


def _range(cuts: str, place: str) -> str:
    """How many of the cuts come before a place, by binary search."""
    steps = [1 << i for i in reversed(range(CUTS.bit_length()))]
    return f"aggregate(array({', '.join(map(str, steps))}), 0, (__at, __by) -> __at + IF(get({cuts}, __at + __by - 1) < {place}, __by, 0))"


def pareto_join(x: str, ties: list[str], name: str, source: str) -> str:
    """A join of one row that divides the order of ``source`` (what follows FROM) into ranges for pareto_range.

    The cuts are the rows whose places have the smallest hashes: a sample by chance that is the same whenever it is taken,
    and that divides the rows of one frequent value by their ties.  One aggregation sums each range, and the sums before
    each range are of so few rows.  The cuts are joined again after it, as 8 KB beside each row that is grouped fill a task.
    """
    place = _place(x, ties)
    cuts = f"(SELECT array_sort(collect_list(k)) AS cuts FROM (SELECT k FROM (SELECT {place} AS k FROM {source}) ORDER BY xxhash64(k), k LIMIT {CUTS})) AS c"
    return (
        f" CROSS JOIN (SELECT /*+ BROADCAST(c) */ cuts, __bases, __total FROM (SELECT map_from_entries(collect_list(struct(b, struct(b, before)))) AS __bases, max(total) AS __total FROM"
        f" (SELECT b, coalesce(sum(s) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(s) OVER () AS total FROM"
        f" (SELECT /*+ BROADCAST(c) */ {_range('cuts', 'k')} AS b, sum(x) AS s FROM (SELECT {place} AS k, {x} AS x FROM {source}) CROSS JOIN {cuts} GROUP BY 1))) CROSS JOIN {cuts}) AS {name}"
    )


def pareto_range(x: str, ties: list[str], name: str) -> str:
    """A join after pareto_join that gives each row its range and the sum before it, so that windows carry no cuts."""
    return f" CROSS JOIN LATERAL (SELECT {name}.__bases[{_range(f'{name}.cuts', _place(x, ties))}] AS __at) AS {name}b"


def pareto_text(x: str, ties: list[str], name: str) -> str:
    """The share of the total that a row and all before it make up, over ranges that are summed side by side."""
    order = ", ".join([f"{x} DESC NULLS LAST", *ties])
    running = f"sum({x}) OVER (PARTITION BY {name}b.__at.b ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"(({name}b.__at.before + coalesce({running}, 0)) / nullif({name}.__total, 0))"


def pareto(rows: DataFrame, value: str, *ties: str, share: str = "share") -> DataFrame:
    """``rows`` with the share of the total of ``value`` that each row and all with larger values (then ties) make up."""
    x, keys = f"`{value}`", [f"`{t}`" for t in ties]
    joins = pareto_join(x, keys, "__p", "{__r}") + pareto_range(x, keys, "__p")
    return rows.sparkSession.sql(f"SELECT __r.*, {pareto_text(x, keys, '__p')} AS `{share}` FROM {{__r}} AS __r{joins}", __r=rows)


def clusters(rows: DataFrame, k: int | None = None, seed: int = 42, steps: int = 20) -> DataFrame:
    """entity_id (the first column), cluster_id and distance to the centre over the other columns; rows with a missing
    feature have no cluster.  Centres start by k-means|| and default to ceil(sqrt(n / 2)) in number."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    first, *rest = rows.columns
    names = [f"`{c}`" for c in rest]
    arrays = [c for c, t in rows.dtypes if c in rest and t.startswith("array")]
    if arrays:
        rows = rows.withColumn("__f", array_to_vector(F.col(arrays[0]).cast("array<double>")))
        whole, gaps = rows.where(F.col(arrays[0]).isNotNull()), rows.where(F.col(arrays[0]).isNull())
    else:
        missing = F.expr(" OR ".join(f"{c} IS NULL" for c in names))
        whole, gaps = VectorAssembler(inputCols=rest, outputCol="__f").transform(rows.where(~missing)), rows.where(missing)
    n = k or max(1, -int(-((whole.count() / 2) ** 0.5) // 1))
    model = KMeans(k=n, seed=seed, maxIter=steps, featuresCol="__f", predictionCol="cluster_id").fit(whole)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    far = F.sqrt(F.aggregate(F.zip_with(vector_to_array("__f"), F.element_at(centres, F.col("cluster_id") + 1), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    found = model.transform(whole).select(F.col(first).alias("entity_id"), "cluster_id", far.alias("distance"))
    return found.unionByName(gaps.select(F.col(first).alias("entity_id"), F.lit(None).cast("int").alias("cluster_id"), F.lit(None).cast("double").alias("distance")))
