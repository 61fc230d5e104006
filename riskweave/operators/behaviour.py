"""Behavioural features of a sender's transactions.

Frames are closed, [t - w, t]. Ties in time see each other; what needs a
predecessor breaks ties by tx_id. A frame isn't added up row by row: its sums are
differences of running sums, to which a row is added when it comes and from which it
is taken when it leaves, so time grows with the rows however many lie in a frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from riskweave.functions import scalars as S
from riskweave.operators.graph import cut

HOUR = 3_600_000_000
DAY = 24 * HOUR
WINDOWS = {"1h": HOUR, "6h": 6 * HOUR, "24h": DAY, "7d": 7 * DAY, "30d": 30 * DAY}


def ordered(key: str = "sender") -> W:
    return W.partitionBy(key).orderBy("us", "tx_id")


def running_sums(turns: DataFrame, key: str, names: list[str], split: int | None = None) -> DataFrame:
    """The rows of turns that hold a _row, with the key and running sums by it of _d_<name>, in order of _at (ties see each other), as <name>.

    Time grows with the rows alone, and a key is one sort. With split, a key is summed
    up in stretches of that length (in units of _at), to which the sums of the stretches
    before are added, so that a key with a large share of all rows is many tasks; turns
    are written out for that, as they are read twice.
    """
    if split is None:
        upto = W.partitionBy(key).orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
        return turns.select("_row", key, *[F.sum(f"_d_{n}").over(upto).alias(n) for n in names]).where(F.col("_row").isNotNull())
    upto = W.partitionBy(key, "_stretch").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    dealt = cut(turns.withColumn("_stretch", F.floor(F.col("_at") / split)))
    totals = dealt.groupBy(F.col(key).alias("_k"), F.col("_stretch").alias("_s")).agg(*[F.sum(f"_d_{n}").alias(f"_t_{n}") for n in names])
    before = W.partitionBy("_k").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    ahead = totals.select("_k", "_s", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_t_{n}") for n in names])
    inner = dealt.select(key, "_stretch", "_row", *[F.sum(f"_d_{n}").over(upto).alias(f"_i_{n}") for n in names]).where(F.col("_row").isNotNull())
    met = inner.join(ahead, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_stretch") == F.col("_s")))
    return met.select("_row", key, *[(F.col(f"_i_{n}") + F.coalesce(f"_t_{n}", F.lit(0))).alias(n) for n in names])


def held(columns: list[str], key: str, row: str = "_row") -> list[Column]:
    """The columns of a row, the key as it stands beside it: rows dealt by key are known to be so still, and aren't shuffled again."""
    return [F.col(key) if c == key else F.col(f"{row}.{c}") for c in columns]


def trailing_sums(txn: DataFrame, key: str, measures: dict[str, tuple[Column, int]], split: int | None = None, dealt: bool = False) -> DataFrame:
    """txn with, for each name, the sum of a whole-number column over the row's trailing frame [us - width, us] of its key.

    A row adds its number when it comes and takes it back width + 1 later; both are
    running sums by key, of all measures and widths at once. Whole numbers (long or
    decimal) leave nothing behind. Rows are dealt by key before they turn into several,
    unless they are dealt so already.
    """
    columns, widths = txn.columns, sorted({w for _, w in measures.values()})
    txn = txn if dealt or split is not None else txn.repartition(F.col(key))
    given = txn.select(F.struct(*txn.columns).alias("_row"), F.col(key), F.col("us").alias("_us"), *[x.alias(f"_x_{n}") for n, (x, _) in measures.items()])
    turns = given.select("*", F.explode(F.array(F.lit(-1).cast("long"), *[F.lit(w).cast("long") for w in widths])).alias("_w"))
    change = lambda n, w: F.when(F.col("_w") == -1, F.col(f"_x_{n}")).when(F.col("_w") == w, -F.col(f"_x_{n}"))
    # What takes back carries no row.
    turns = turns.select(F.when(F.col("_w") == -1, F.col("_row")).alias("_row"), key, (F.col("_us") + F.col("_w") + 1).alias("_at"), *[change(n, w).alias(f"_d_{n}") for n, (_, w) in measures.items()])
    return running_sums(turns, key, list(measures), split).select(*held(columns, key), *measures)


def fixed(amount: Column) -> Column:
    """An amount in ten-thousandths, as a whole number."""
    return F.round(amount * 10_000).cast("long")


def square(amount: Column) -> Column:
    return (fixed(amount).cast("decimal(18,0)") * fixed(amount).cast("decimal(18,0)")).cast("decimal(28,0)")


def mean_of(n: Column, total: Column) -> Column:
    return total / n / 10_000


def spread_of(n: Column, total: Column, squares: Column) -> Column:
    """Population deviation from counts, sums and sums of squares in ten-thousandths; exactly 0 where all are equal."""
    over = n.cast("decimal(10,0)") * squares.cast("decimal(27,0)") - total.cast("decimal(19,0)") * total.cast("decimal(18,0)")
    return F.sqrt(F.greatest(over.cast("double"), F.lit(0.0))) / n / 10_000


def moments(name: str, width: int) -> dict[str, tuple[Column, int]]:
    """Measures of the amounts of a frame: <name>_n, <name>_sum, <name>_sq."""
    amount = F.col("amount")
    return {f"{name}_n": (F.lit(1).cast("long"), width), f"{name}_sum": (fixed(amount), width), f"{name}_sq": (square(amount), width)}


def velocity_measures() -> dict:
    return {f"tx_velocity_{w}": (F.lit(1).cast("long"), WINDOWS[w]) for w in ("1h", "6h", "24h", "7d")}


def velocity(txn: DataFrame) -> DataFrame:
    return trailing_sums(txn, "sender", velocity_measures())


def amount_measures() -> dict:
    return moments("_week", WINDOWS["7d"]) | moments("_month", WINDOWS["30d"])


def with_amounts(summed: DataFrame) -> DataFrame:
    week, month = ([F.col(f"_{f}_{c}") for c in ("n", "sum", "sq")] for f in ("week", "month"))
    spread = spread_of(*month)
    return summed.select(
        "*", mean_of(*week[:2]).alias("avg_amount_7d"), spread_of(*week).alias("std_amount_7d"), (month[1] / 10_000 / 30).alias("avg_daily_volume_30d"),
        ((F.col("amount") - mean_of(*month[:2])) / F.when(spread > 0, spread).otherwise(F.lit(1.0))).alias("amount_zscore"),
    ).drop(*amount_measures())


def amounts(txn: DataFrame) -> DataFrame:
    return with_amounts(trailing_sums(txn, "sender", amount_measures()))


RATIOS = ("night_tx_ratio", "weekend_tx_ratio", "cross_border_ratio_30d")


def ratio_measures() -> dict:
    flags = (S.is_night(F.col("ts")), S.is_weekend(F.col("ts")), F.col("international"))
    month = WINDOWS["30d"]
    return {f"_r_{name}": (F.coalesce(flag.cast("long"), F.lit(0).cast("long")), month) for name, flag in zip(RATIOS, flags, strict=True)} | {f"_r_n_{name}": (flag.isNotNull().cast("long"), month) for name, flag in zip(RATIOS, flags, strict=True)}


def with_ratios(summed: DataFrame) -> DataFrame:
    share = lambda name: F.when(F.col(f"_r_n_{name}") > 0, F.col(f"_r_{name}") / F.col(f"_r_n_{name}"))
    return summed.select("*", *[share(name).alias(name) for name in RATIOS]).drop(*ratio_measures())


def ratios(txn: DataFrame) -> DataFrame:
    return with_ratios(trailing_sums(txn, "sender", ratio_measures()))


def frame_sums(txn: DataFrame, key: str, value: str, width: int, measures: dict, split: int | None = None, dealt: bool = False) -> DataFrame:
    """txn with, for each name and function f in measures, the sum of f(n) over the values in the row's trailing frame, n being how often each stands there; f(0) is 0. In place of f, (f, width) gives a measure another width.

    A value's count changes when a row with it comes, and width + 1 later. Running
    sums by key and value give the counts before and after each change, and f of them
    what the change is worth; running sums of that by key give the measure. So no row
    holds or counts its frame. f gives whole numbers or decimals, which leave nothing
    behind. Nulls of value count nothing. Rows are dealt by key alone, unless they are
    dealt so already: that serves the windows by key and value as well.
    """
    columns = txn.columns
    txn = txn if dealt or split is not None else txn.repartition(F.col(key))
    plan = {name: f if isinstance(f, tuple) else (f, width) for name, f in measures.items()}
    widths = sorted({w for _, w in plan.values()})
    given = txn.select(F.struct(*txn.columns).alias("_row"), F.col(key), F.col(value).alias("_v"), F.col("us").alias("_us"))
    moves = given.select("*", F.explode(F.array(F.lit(-1).cast("long"), *[F.lit(w).cast("long") for w in widths])).alias("_w")).where((F.col("_w") == -1) | F.col("_v").isNotNull())
    change = lambda w: F.when(F.col("_v").isNull(), 0).when(F.col("_w") == -1, 1).when(F.col("_w") == w, -1).otherwise(0)
    moves = moves.select(F.when(F.col("_w") == -1, F.col("_row")).alias("_row"), key, "_v", "_w", (F.col("_us") + F.col("_w") + 1).alias("_at"), *[change(w).alias(f"_c{w}") for w in widths])
    moves = moves if split is None else moves.repartition(F.col(key), F.col("_v"))
    here, upto = W.partitionBy(key, "_v", "_at"), W.partitionBy(key, "_v").orderBy("_at").rangeBetween(W.unboundedPreceding, 0)
    first = F.row_number().over(here.orderBy("_w")) == 1
    counted = moves.select("_row", key, "_at", (first & F.col("_v").isNotNull()).alias("_first"), *[F.sum(f"_c{w}").over(here.orderBy("_w").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias(f"_c{w}") for w in widths], *[F.sum(f"_c{w}").over(upto).alias(f"_n{w}") for w in widths])
    worth = lambda f, w: f(F.col(f"_n{w}")) - f(F.col(f"_n{w}") - F.col(f"_c{w}"))
    turns = counted.select("_row", key, "_at", *[F.when(F.col("_first"), worth(f, w)).alias(f"_d_{name}") for name, (f, w) in plan.items()])
    return running_sums(turns, key, list(plan), split).select(*held(columns, key), *[F.coalesce(name, F.lit(0)).cast("double").alias(name) for name in plan])


def distinct_count(n: Column) -> Column:
    return (n > 0).cast("long")


def n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0)).cast("decimal(28,10)")


def count_distinct(txn: DataFrame, key: str, value: str, width: int, name: str, dealt: bool = False) -> DataFrame:
    """txn with the number of distinct values in each row's trailing frame."""
    return frame_sums(txn, key, value, width, {name: distinct_count}, dealt=dealt).withColumn(name, F.round(name).cast("int"))


def distincts(txn: DataFrame, dealt: bool = False) -> DataFrame:
    week, month = "beneficiary_count_7d", "beneficiary_count_30d"
    out = frame_sums(txn, "sender", "receiver", WINDOWS["7d"], {week: distinct_count, month: (distinct_count, WINDOWS["30d"])}, dealt=dealt)
    out = out.withColumns({c: F.round(c).cast("int") for c in (week, month)})
    return count_distinct(out, "sender", "ip", WINDOWS["24h"], "ip_change_count_24h", dealt=True)


def travel(txn: DataFrame) -> DataFrame:
    """Gap and distance from the sender's previous transaction; 0 for the first."""
    before = lambda c: F.lag(c).over(ordered())
    gap = F.coalesce(F.greatest(F.lit(0.0), (F.col("us") - before("us")) / 1e6), F.lit(0.0))
    km = F.coalesce(S.haversine_km(before("lat"), before("lon"), F.col("lat"), F.col("lon")), F.lit(0.0))
    out = txn.select("*", gap.alias("tx_gap_seconds"), km.alias("geo_distance_km"))
    return out.withColumn("impossible_travel_flag", S.impossible_travel(F.col("geo_distance_km"), F.col("tx_gap_seconds")))


def switches(txn: DataFrame, split: int | None = None) -> DataFrame:
    """Changes between neighbours that both lie in the trailing week: running changes less those whose former row has left it."""
    names = {"country": "country_switch_count_7d", "device": "device_change_count_7d"}
    before = F.lag("us").over(ordered())
    changed = lambda c: F.coalesce((F.lag(c).over(ordered()) != F.col(c)).cast("long"), F.lit(0).cast("long"))
    marked = txn.select(F.struct(*txn.columns).alias("_row"), "sender", "us", "tx_id", before.alias("_before"), *[changed(c).alias(f"_c_{c}") for c in names])
    upto = ordered().rowsBetween(W.unboundedPreceding, 0)
    marked = marked.select("_row", "sender", "us", "_before", *[f"_c_{c}" for c in names], *[F.sum(f"_c_{c}").over(upto).alias(f"_u_{c}") for c in names])
    both = marked.select(F.struct("_row", *[f"_u_{c}" for c in names]).alias("_row"), "sender", F.explode(F.array(F.struct(F.col("us").alias("at"), F.lit(0).alias("left")), F.struct((F.col("_before") + WINDOWS["7d"] + 1).alias("at"), F.lit(1).alias("left")))).alias("_t"), *[f"_c_{c}" for c in names])
    left = F.col("_t.left") == 1
    turns = both.where(F.col("_t.at").isNotNull()).select(F.when(~left, F.col("_row")).alias("_row"), "sender", F.col("_t.at").alias("_at"), *[F.when(left, F.col(f"_c_{c}")).otherwise(F.lit(0).cast("long")).alias(f"_d_{c}") for c in names])
    met = running_sums(turns, "sender", list(names), split)
    return met.select(*held(txn.columns, "sender", "_row._row"), *[(F.col(f"_row._u_{c}") - F.col(c)).alias(name) for c, name in names.items()])


def devices(txn: DataFrame) -> DataFrame:
    """Whether the sender uses the device for the first time, and how many others have used it so far."""
    first = F.row_number().over(W.partitionBy("sender", "device").orderBy("us", "tx_id")) == 1
    out = txn.withColumn("new_device_flag", first)
    others = F.sum(F.col("new_device_flag").cast("int")).over(W.partitionBy("device").orderBy("us", "tx_id").rowsBetween(W.unboundedPreceding, 0)) - 1
    return out.withColumn("shared_device_count", F.greatest(F.lit(0), others))


def shared_devices(txn: DataFrame, micros: int = DAY) -> DataFrame:
    """tx_id and the shared_device_count of devices(): no other column is shuffled, and a device is counted in stretches of time, to which first uses before them are added."""
    first = F.row_number().over(W.partitionBy("sender", "device").orderBy("us", "tx_id")) == 1
    dealt = cut(txn.select("tx_id", "device", "us", F.floor(F.col("us") / micros).alias("_stretch"), first.cast("int").alias("_first")))
    before = W.partitionBy("_d").orderBy("_s").rowsBetween(W.unboundedPreceding, -1)
    ahead = dealt.groupBy(F.col("device").alias("_d"), F.col("_stretch").alias("_s")).agg(F.sum("_first").alias("_n"))
    ahead = ahead.select("_d", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    inside = F.sum("_first").over(W.partitionBy("device", "_stretch").orderBy("us", "tx_id").rowsBetween(W.unboundedPreceding, 0))
    met = dealt.select("tx_id", "device", "_stretch", inside.alias("_inside")).join(ahead, F.col("device").eqNullSafe(F.col("_d")) & F.col("_stretch").eqNullSafe(F.col("_s")))
    return met.select("tx_id", F.greatest(F.lit(0), F.col("_ahead") + F.col("_inside") - 1).alias("shared_device_count"))


def shared_devices_total(txn: DataFrame) -> DataFrame:
    """The look-ahead form: other senders of the device over all time."""
    totals = txn.groupBy(F.col("device").alias("d")).agg(F.countDistinct("sender").alias("accounts"))
    return txn.join(totals, F.col("device") == F.col("d"), "left").withColumn("shared_device_count_total", F.greatest(F.lit(0), F.col("accounts") - 1)).drop("d", "accounts")


def benford_measures() -> dict:
    digit = S.leading_digit(F.col("amount"))
    return {f"_digit_{d}": ((F.coalesce(digit, F.lit(0)) == d).cast("long"), WINDOWS["30d"]) for d in range(1, 10)}


def digit_measures() -> dict:
    return benford_measures() | {"_digits_n": (F.lit(1).cast("long"), WINDOWS["30d"])}


def with_benford(summed: DataFrame) -> DataFrame:
    """Trailing Benford distance of 30 days."""
    return summed.withColumn("benford_chi2_score", S.benford_chi2([F.col(f"_digit_{d}") for d in range(1, 10)])).drop(*benford_measures())


def with_digits(summed: DataFrame) -> DataFrame:
    """Trailing Benford distance and receiver entropy of 30 days; summed: by sender, as trailing_sums() deals it."""
    out = frame_sums(with_benford(summed), "sender", "receiver", WINDOWS["30d"], {"_nlogn": n_log_n}, dealt=True)
    return out.withColumn("receiver_entropy", F.greatest(F.lit(0.0), F.log2("_digits_n") - F.col("_nlogn") / F.col("_digits_n"))).drop("_digits_n", "_nlogn")


def digits(txn: DataFrame) -> DataFrame:
    return with_digits(trailing_sums(txn, "sender", digit_measures()))


def buckets(txn: DataFrame, days: int = 30) -> DataFrame:
    """Benford distance and receiver entropy by sender and fixed bucket of days from the first transaction."""
    start = txn.agg(F.min("us").alias("start"))
    at = txn.join(F.broadcast(start)).withColumn("bucket", F.floor((F.col("us") - F.col("start")) / (days * DAY)))  # start is one row
    counted = at.groupBy("sender", "bucket", "receiver").agg(F.count("*").alias("n"), *[F.sum((S.leading_digit(F.col("amount")) == d).cast("int")).alias(f"d{d}") for d in range(1, 10)])
    sums = counted.groupBy("sender", "bucket").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("nlogn"), *[F.sum(f"d{d}").alias(f"d{d}") for d in range(1, 10)])
    return sums.select("sender", "bucket", F.col("total").alias("n_tx"), S.benford_chi2([F.col(f"d{d}") for d in range(1, 10)]).alias("benford_chi2"), (F.log2("total") - F.col("nlogn") / F.col("total")).alias("receiver_entropy"))


def row_features(txn: DataFrame) -> DataFrame:
    ts, amount = F.col("ts"), F.col("amount")
    hour, dow = S.hour_of(ts), S.weekday_of(ts)
    (hs, hc), (ds, dc) = S.cyclic(hour, 24), S.cyclic(dow, 7)
    return txn.select(
        "*", hour.alias("hour_of_day"), dow.alias("day_of_week"), S.round_amount(amount).alias("round_amount_flag"), S.sub_threshold(amount).alias("sub_threshold_flag"), S.clipped_digit(amount).alias("amount_leading_digit"),
        S.high_risk(F.col("country"), F.col("receiver_country")).alias("high_risk_country_flag"), amount.alias("amount_raw"), S.log_amount(amount).alias("amount_log"), hs.alias("hour_sin"), hc.alias("hour_cos"), ds.alias("dow_sin"), dc.alias("dow_cos"),
        *S.one_hot(F.col("tx_type" if "tx_type" in txn.columns else "channel"), S.TX_TYPES, "tx_type"), *S.one_hot(F.col("channel"), S.CHANNELS, "channel"),
    )


#: The 45 features in their canonical order (fixed values).
FEATURES = (
    "tx_velocity_1h", "tx_velocity_6h", "tx_velocity_24h", "tx_velocity_7d", "avg_amount_7d", "std_amount_7d", "tx_gap_seconds", "night_tx_ratio", "weekend_tx_ratio", "hour_of_day", "day_of_week",
    "beneficiary_count_7d", "beneficiary_count_30d", "receiver_entropy", "amount_zscore", "avg_daily_volume_30d", "round_amount_flag", "sub_threshold_flag", "amount_leading_digit", "benford_chi2_score",
    "geo_distance_km", "country_switch_count_7d", "impossible_travel_flag", "high_risk_country_flag", "cross_border_ratio_30d",
    "device_change_count_7d", "new_device_flag", "shared_device_count", "ip_change_count_24h",
    "amount_raw", "amount_log", "hour_sin", "hour_cos", "dow_sin", "dow_cos", *(f"tx_type_{t}" for t in S.TX_TYPES), *(f"channel_{c}" for c in S.CHANNELS),
)


def features(txn: DataFrame, dealt: bool = False) -> DataFrame:
    """txn with the 45 behavioural features; all sums and counts of trailing frames are one pass, and all by sender one shuffle, or none if rows are dealt by sender already.

    What a row tells by itself is added at the end, so that no sort carries it. Where
    txn has its shared_device_count already, rows stay dealt by sender to the end.
    """
    out = trailing_sums(txn, "sender", velocity_measures() | amount_measures() | ratio_measures() | digit_measures(), dealt=dealt)
    for block in (with_amounts, with_ratios, with_digits):
        out = block(out)
    out = switches(travel(distincts(out, dealt=True)))
    if "shared_device_count" not in txn.columns:
        return row_features(devices(out))
    return row_features(out.withColumn("new_device_flag", F.row_number().over(W.partitionBy("sender", "device").orderBy("us", "tx_id")) == 1))


def standardise(df: DataFrame, columns: list[str]) -> DataFrame:
    """z_<column> by mean and population deviation; a constant column is divided by 1."""
    stats = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m_{c}") for c in columns], *[F.stddev_pop(F.col(c).cast("double")).alias(f"s_{c}") for c in columns])
    scale = lambda c: F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(F.lit(1.0))
    return df.join(F.broadcast(stats)).select(*df.columns, *[((F.col(c).cast("double") - F.col(f"m_{c}")) / scale(c)).alias(f"z_{c}") for c in columns])  # stats is one row


def profiles(txn: DataFrame) -> DataFrame:
    """Per sender: count, mean, sample deviation (0 for one), 95th percentile, beneficiaries."""
    return txn.groupBy("sender").agg(
        F.count("*").alias("n_tx"), F.avg("amount").alias("mean_amount"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("std_amount"), F.percentile("amount", 0.95).alias("p95_amount"), F.countDistinct("receiver").alias("beneficiaries")
    )
