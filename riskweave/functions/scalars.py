"""Scalar expressions over transactions and scores, as Column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Domain constants that results depend on.
EARTH_RADIUS_KM = 6371.0088
IMPOSSIBLE_SPEED_KMH = 900.0
HIGH_RISK_COUNTRIES = ("AE", "MU", "CN", "NG", "PK")
TX_TYPES = ("NEFT", "RTGS", "IMPS", "Wire", "UPI", "Card")
CHANNELS = ("Mobile", "Web", "ATM", "Branch")
SUB_THRESHOLD = (850_000.0, 999_000.0)
ROUND_UNIT = 100_000
TRUE_WORDS = ("true", "1", "t", "yes", "y")
#: Benford's expectation of leading digits 1 to 9.
BENFORD = tuple(math.log10(1 + 1 / d) for d in range(1, 10))


def hour_of(ts: Column) -> Column:
    return F.hour(ts)


def weekday_of(ts: Column) -> Column:
    """Day of week with Monday as 0."""
    return F.weekday(ts)


def is_night(ts: Column) -> Column:
    return (F.hour(ts) >= 22) | (F.hour(ts) < 6)


def is_weekend(ts: Column) -> Column:
    return F.weekday(ts) >= 5


def round_amount(amount: Column) -> Column:
    return amount % ROUND_UNIT == 0


def sub_threshold(amount: Column) -> Column:
    return amount.between(*SUB_THRESHOLD)


def high_risk(sender: Column, receiver: Column) -> Column:
    return F.coalesce(sender.isin(*HIGH_RISK_COUNTRIES), F.lit(False)) | F.coalesce(receiver.isin(*HIGH_RISK_COUNTRIES), F.lit(False))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(clamp(a, 0.0, 1.0)))


def impossible_travel(km: Column, gap_seconds: Column) -> Column:
    return F.coalesce((gap_seconds > 0) & (F.try_divide(km, gap_seconds / 3600) > IMPOSSIBLE_SPEED_KMH), F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    """x within limits; null stays null, which greatest() and least() would skip."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x)))


def log_amount(amount: Column) -> Column:
    return F.log1p(F.greatest(amount, F.lit(0.0)))


def cyclic(x: Column, period: int) -> tuple[Column, Column]:
    angle = x * (2 * math.pi / period)
    return F.sin(angle), F.cos(angle)


def leading_digit(amount: Column) -> Column:
    """First digit of the whole part; amounts under 1 give 0."""
    return F.substring(F.abs(amount).cast("long").cast("string"), 1, 1).cast("int")


def clipped_digit(amount: Column) -> Column:
    """Leading digit as 1 to 9; what is not positive counts as 1."""
    return F.greatest(F.lit(1), leading_digit(F.greatest(amount, F.lit(0.0))))


def benford_chi2(counts: list[Column], min_rows: int = 5) -> Column:
    """Chi-squared distance of digit counts (1 to 9) from Benford's law; 0 under min_rows digits."""
    n = sum(counts[1:], counts[0])
    parts = [F.pow(c - n * e, 2) / (n * e) for c, e in zip(counts, BENFORD, strict=True)]
    return F.when(n >= min_rows, sum(parts[1:], parts[0])).otherwise(F.lit(0.0))


def one_hot(x: Column, values: tuple[str, ...], prefix: str) -> list[Column]:
    return [F.coalesce(x == v, F.lit(False)).alias(f"{prefix}_{v}") for v in values]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def recalibrate(score: Column, middle: float = 65.0, slope: float = 0.2) -> Column:
    return 100 * sigmoid((score - middle) * slope)


def decision_to_score(decision: Column) -> Column:
    return clamp(50 - 200 * decision, 0, 100)


def reconstruction_to_score(mse: Column, base: Column) -> Column:
    return clamp((mse - base) * 200, 0, 100)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def embedding_drift(a: Column, b: Column) -> Column:
    """Half the cosine distance, in [0, 1]; 1 where a vector is missing or zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.coalesce(F.when(norm > 0, clamp(1 - dot(a, b) / norm, 0, 2) * 0.5), F.lit(1.0))


def link_surprise(a: Column, b: Column) -> Column:
    """1 - sigmoid of the dot product; 1 where a vector is missing."""
    return F.coalesce(1 - sigmoid(dot(a, b)), F.lit(1.0))


def risk_level(score: Column) -> Column:
    s = clamp(score, 0, 100)
    return F.when(s <= 30, "Low").when(s <= 60, "Medium").when(s <= 80, "High").otherwise("Critical")


def parse_list(text: Column) -> Column:
    """A list from JSON, from a list printed with single quotes, or from a bare word; null and blank give an empty one."""
    trimmed = F.trim(text)
    listed = F.coalesce(F.from_json(trimmed, "array<string>"), F.from_json(F.translate(trimmed, "'", '"'), "array<string>"))
    bare = F.when(trimmed.startswith("["), F.array().cast("array<string>")).otherwise(F.array(trimmed))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.coalesce(listed, bare))


def breakdown_field(json: Column, group: str, name: str) -> Column:
    return F.get_json_object(json, f"$.{group}.{name}").cast("double")


def rule_of(pattern: Column) -> Column:
    """Rule id of a pattern such as L1:R02; null for others."""
    found = F.regexp_extract(pattern, r"^L1:(R\d{2})", 1)
    return F.when(found != "", found)


def humanise_amount(amount: Column) -> Column:
    """Rupees in crore, lakh or units."""
    return F.when(amount >= 1e7, F.format_string("%.2f Cr", amount / 1e7)).when(amount >= 1e5, F.format_string("%.2f L", amount / 1e5)).otherwise(F.format_string("%.0f", amount))


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def edge_features(amount: Column, international: Column, port: Column) -> Column:
    return F.array(amount / 1e6, log_amount(amount), international.cast("double"), port / (port + 1.0))
