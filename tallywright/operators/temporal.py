"""As-of operators: everything a query row may know lies strictly before its date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.sources.shared import materialized


def ranked_history(catalog: DataFrame, keys: list[str], date: str = "d", tie: str = "row_key") -> DataFrame:
    """catalog with ``nth``, its place by (date, tie) in its key, and ``prior``, the rows of its key on earlier days.

    Rows are numbered within (key, month) and months get offsets from a small
    pre-aggregate, so a key that holds a large part of all rows is spread over
    its months instead of landing in one task. Offsets have as many rows as the keys
    have months and lie as the windows do, so they are merged and never broadcast.
    """
    month = F.date_format(date, "yyyy-MM").alias("month")
    rows = catalog.select("*", month)
    in_month = Window.partitionBy(*keys, "month")
    earlier = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(*keys, "month").count().select(*keys, "month", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("offset"))
    return (
        rows.withColumn("at", F.row_number().over(in_month.orderBy(date, tie)))
        .withColumn("day_rank", F.rank().over(in_month.orderBy(date)) - 1)
        .join(offsets.hint("merge"), [*keys, "month"])
        .withColumn("nth", F.col("offset") + F.col("at"))
        .withColumn("prior", F.col("offset") + F.col("day_rank"))
        .drop("at", "day_rank", "offset", "month")
    )


def reachable(rows: DataFrame, keys: list[str], n: int, since: str, date: str = "d", tie: str = "row_key") -> DataFrame:
    """Rows from the day ``since`` on, and of each key the newest n before it.

    No query from that day on has any other row among its newest n, and places that
    are counted from the first row left differ by the same number in all of a key.
    Tasks cut their own rows to n of a key before these move.
    """
    day = F.lit(since).cast("date")
    newest = Window.partitionBy(*keys).orderBy(F.desc(date), F.desc(tie))
    old = rows.where(F.col(date) < day).withColumn("newest", F.row_number().over(newest)).where(F.col("newest") <= n).drop("newest")
    return rows.where(F.col(date) >= day).unionByName(old)


def latest_prior(catalog: DataFrame, is_query: Column, keys: list[str], n: int, columns: list[str], date: str = "d", tie: str = "row_key", since: str | None = None) -> DataFrame:
    """The latest n rows of the same key before each query row: q_* columns, c_* columns, pool_rank (1: newest) and q_block.

    A query row with p prior rows takes places p - n + 1 .. p of its key. Places lie in
    blocks of n, so they are in the block of p or in that before it: history stands in
    its own block and in the next, a query asks in one. So the pairs of a query lie
    together by (key, q_block), and what is computed for each query by these and its
    key moves no pair. since: a day before which there is no query; history that no
    query can reach is left out.
    """
    if since is not None:
        catalog = reachable(catalog, keys, n, since, date, tie)
    ranked = ranked_history(catalog, keys, date, tie)
    queries = ranked.where(is_query & (F.col("prior") > 0)).select(
        *[F.col(k).alias(f"q_{k}") for k in keys],
        *[F.col(c).alias(f"q_{c}") for c in columns if c not in keys],
        _block("prior", n).alias("q_block"),
        F.col("prior"),
    )
    history = ranked.select(*[F.col(c).alias(f"c_{c}") for c in dict.fromkeys([*keys, *columns])], F.col("nth"), F.explode(F.array(_block("nth", n), _block("nth", n) + 1)).alias("c_block"))
    on = [F.col(f"q_{k}") == F.col(f"c_{k}") for k in keys]
    return (
        queries.join(history, [*on, F.col("q_block") == F.col("c_block"), _newest(n)])
        .withColumn("pool_rank", (F.col("prior") - F.col("nth") + 1).cast("int"))
        .drop("nth", "prior", "c_block")
    )


def _block(place: str, n: int) -> Column:
    return F.floor(F.col(place) / n)


def _blocks(n: int) -> Column:
    """Blocks of n places that hold the newest n of ``prior`` rows."""
    return F.sequence(F.floor(F.greatest(F.col("prior") - (n - 1), F.lit(1)) / n), _block("prior", n))


def _newest(n: int) -> Column:
    """Whether the place ``nth`` is among the newest n of ``prior`` rows."""
    return (F.col("nth") <= F.col("prior")) & (F.col("nth") > F.col("prior") - n)


def counts_before(history: DataFrame, asks: DataFrame, keys: list[str], date: str = "d") -> DataFrame:
    """keys, date, prior: for each (keys, date) of asks the rows of history with these keys and an earlier date.

    Rows are counted by day within (keys, month), and months get offsets, so that
    neither a key's history nor its queries need meet in one task.
    """
    days = history.groupBy(*keys, date).agg(F.count("*").alias("one")).unionByName(asks.select(*keys, date).distinct().withColumn("one", F.lit(0).cast("long")))
    days = days.groupBy(*keys, date).agg(F.sum("one").alias("one"), F.min("one").alias("least")).withColumn("month", F.date_format(date, "yyyy-MM"))
    earlier = Window.partitionBy(*keys).orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    offsets = days.groupBy(*keys, "month").agg(F.sum("one").alias("in_month")).select(*keys, "month", F.coalesce(F.sum("in_month").over(earlier), F.lit(0)).alias("offset"))
    before = Window.partitionBy(*keys, "month").orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    counted = days.withColumn("at", F.coalesce(F.sum("one").over(before), F.lit(0))).where("least = 0").join(offsets.hint("merge"), [*keys, "month"])
    return counted.select(*keys, date, (F.col("offset") + F.col("at")).alias("prior"))


def newest_of_lists(history: DataFrame, asks: DataFrame, keys: list[str], n: int, date: str = "d", tie: str = "row_key", since: str | None = None) -> DataFrame:
    """The newest n rows of each list that a query asks for, strictly before its date.

    history: keys, date, tie, one row for each list that a row stands in. asks: keys,
    date and further columns, one row for each list that a query asks for. Returns
    the asks' further columns, c (tie of the row found) and c_d (its date). Rows are
    found by their place in the list, an equi-join on blocks of n places. since: a day
    before which nothing is asked; rows that cannot be found are left out.
    """
    if since is not None:
        history = materialized(reachable(history, keys, n, since, date, tie), "reachable")
    prior = counts_before(history, asks, keys, date).where("prior > 0")
    wanted = asks.join(prior, [*keys, date]).withColumn("block", F.explode(_blocks(n))).drop(date)
    found = ranked_history(history, keys, date, tie).select(*keys, "nth", _block("nth", n).alias("block"), F.col(tie).alias("c"), F.col(date).alias("c_d"))
    return wanted.join(found, [*keys, "block"]).where(_newest(n)).drop(*keys, "nth", "prior", "block")


#: Cells of a unit on the axis of the second key, and levels of dyadic cells over them.
FINE, LEVELS = 32, 5


def _outside(low: Column, high: Column):
    return lambda c: (low > high) | (F.floor(c / 2) < low) | (F.floor(c / 2) > high)


def _named(level: int):
    return lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell"))


def _cover(first: Column, last: Column) -> Column:
    """Array of (level, cell): the fewest dyadic cells whose union is the fine cells first..last."""
    out = []
    for level in range(LEVELS):
        size = 1 << level
        low, high = F.ceil(first / size), F.floor((last + 1) / size) - 1
        cells = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<long>"))
        if level + 1 < LEVELS:  # those whose parent is not covered whole
            low2, high2 = F.ceil(first / (2 * size)), F.floor((last + 1) / (2 * size)) - 1
            cells = F.filter(cells, _outside(low2, high2))
        out.append(F.transform(cells, _named(level)))
    return F.flatten(F.array(*out))


def latest_in_band(rows: DataFrame, is_query: Column, key: str, axis: Column, half: float, n: int, date: str = "d", tie: str = "row_key", since: str | None = None) -> DataFrame:
    """(q, c, c_d): the newest n rows of the query's key before its date whose axis is within ``half`` of the query's.

    Rows stand in dyadic cells of the axis, one for each level, and in a list of
    their exact value. A band is covered by few cells, and at its two edges by the
    lists of those values that lie within it; so a query reads the newest n rows of
    some ten lists, whatever the history, and the edges are exact. Null axes are in
    no band.
    """
    slim = rows.select(F.col(key).alias("key"), F.col(date).alias("d"), F.col(tie).alias("row_key"), axis.alias("x"), is_query.alias("asks")).where("x is not null and key is not null")
    covers = _band_covers(slim.groupBy("key", "x").agg(F.max(F.col("asks").cast("int")).alias("asked")), half)
    history = slim.select("key", "d", "row_key", F.explode(_band_levels()).alias("at")).select("key", "d", "row_key", "at.level", "at.spot")
    asks = slim.where("asks").select(F.col("row_key").alias("q"), "d", "key", "x").join(covers, ["key", "x"]).drop("x")
    found = newest_of_lists(history, asks, ["key", "level", "spot"], n, since=since)
    newest = Window.partitionBy("q").orderBy(F.desc("c_d"), F.desc("c"))
    return found.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)


def _band_levels() -> Column:
    """The lists in which a row with axis x stands: that of its exact value (level -1), and its cells."""
    cells = [F.struct(F.lit(k).alias("level"), F.floor(F.floor(F.col("x") * FINE) / (1 << k)).cast("double").alias("spot")) for k in range(LEVELS)]
    return F.array(F.struct(F.lit(-1).alias("level"), F.col("x").alias("spot")), *cells)


def _band_covers(values: DataFrame, half: float) -> DataFrame:
    """(key, x, level, spot): the lists that hold the rows within ``half`` of each value that is asked for. values: key, x, asked (0 or 1)."""
    values = values.withColumn("cell", F.floor(F.col("x") * FINE))
    near = 1e-9
    low_edge = F.sequence(F.floor((F.col("x") - half - near) * FINE), F.floor((F.col("x") - half + near) * FINE))
    high_edge = F.sequence(F.floor((F.col("x") + half - near) * FINE), F.floor((F.col("x") + half + near) * FINE))
    wanted = values.where("asked = 1").select("key", F.col("x"), low_edge.alias("low"), high_edge.alias("high"))
    inside = wanted.select("key", "x", F.explode(_cover(F.array_max("low") + 1, F.array_min("high") - 1)).alias("at")).select("key", "x", "at.level", F.col("at.cell").cast("double").alias("spot"))
    edges = wanted.select("key", "x", F.explode(F.array_distinct(F.concat("low", "high"))).alias("cell")).join(values.select("key", "cell", F.col("x").alias("spot")), ["key", "cell"])
    return inside.unionByName(edges.where(F.abs(F.col("spot") - F.col("x")) <= half).select("key", "x", F.lit(-1).alias("level"), "spot"))


def band_lists(rows: DataFrame, asks: DataFrame, key: str, axis: Column, half: float) -> tuple[DataFrame, DataFrame]:
    """Lists as in ``latest_in_band``, for ``operators.lists.newest_ids``.

    rows: id, key and what axis reads; asks: at, key and what axis reads. Returns
    (key, level, spot, id) of every row, and (key, level, spot, at, of, x): the lists of
    each band that is asked for, once for each key (of), value (x) and at.
    """
    known = "x is not null and key is not null"
    slim = rows.select("id", F.col(key).alias("key"), axis.alias("x")).where(known)
    bands = asks.select("at", F.col(key).alias("key"), axis.alias("x")).where(known).distinct()
    values = slim.select("key", "x").distinct().withColumn("asked", F.lit(0)).unionByName(bands.select("key", "x").distinct().withColumn("asked", F.lit(1)))
    covers = _band_covers(materialized(values.groupBy("key", "x").agg(F.max("asked").alias("asked")), "values"), half)
    history = slim.select("key", "id", F.explode(_band_levels()).alias("at")).select("key", "at.level", "at.spot", "id")
    return history, bands.join(covers, ["key", "x"]).select("key", "level", "spot", "at", F.col("key").alias("of"), "x")


def decayed_stats(catalog: DataFrame, is_query: Column, keys: list[str], half_life: float, value: str = "lp", date: str = "d") -> DataFrame:
    """Exponentially decayed weight, mean and variance of ``value`` over the prior days of each query's key.

    The weight 2 ** (-age / half_life) splits into a factor of the query's day and
    one of the history's day, so running sums of a daily pre-aggregate serve every
    query of a day: no pair of query and history row is ever formed.
    Returns keys, d, w, mean, variance (floored at 0.01; 0.25 for a single prior row).
    """
    day = F.datediff(F.col(date), F.lit("1995-01-01").cast("date"))
    grow = F.exp(F.log(F.lit(2.0)) * day / half_life)
    daily = catalog.groupBy(*keys, date).agg(
        F.count("*").alias("n"), F.sum(grow).alias("g"), F.sum(grow * F.col(value)).alias("gx"), F.sum(grow * F.col(value) ** 2).alias("gxx"), F.max(is_query.cast("int")).alias("asked")
    )
    prior = Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    run = daily.select(*keys, date, "asked", *[F.sum(c).over(prior).alias(c) for c in ("n", "g", "gx", "gxx")]).where("asked = 1 and n > 0")
    mean = F.col("gx") / F.col("g")
    variance = F.when(F.col("n") == 1, F.lit(0.25)).otherwise(F.greatest(F.col("gxx") / F.col("g") - mean**2, F.lit(0.01)))
    return run.select(*keys, date, F.col("n").alias("n_prior"), (F.col("g") * F.exp(-F.log(F.lit(2.0)) * day / half_life)).alias("w"), mean.alias("mean"), variance.alias("variance"))
