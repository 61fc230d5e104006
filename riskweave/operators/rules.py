"""The rule engine: fifteen rules as columns, their severities and the rule score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Limits:
    """Thresholds of the rules (fixed values), adjustable for data of another density."""

    large: float = 1_000_000
    structuring_velocity: int = 3
    hour_velocity: int = 10
    day_velocity: int = 50
    dormant_seconds: float = 15_552_000
    dormant_amount: float = 100_000
    device_amount: float = 200_000
    shared_devices: int = 5
    beneficiaries: int = 20
    round_velocity: int = 5
    kyc_amount: float = 500_000
    benford: float = 3.84
    fan_in: int = 5
    fan_in_cv: float = 0.35
    relay_low: float = 0.85
    relay_high: float = 1.0
    relay_seconds: float = 7200


@dataclass(frozen=True)
class Rule:
    id: str
    weight: float
    fires: Callable[[Limits], Column]
    text: Callable[[], Column] = field(default=lambda: F.lit(""))

    @property
    def severity(self) -> float:
        return 50 + 40 * (self.weight - 0.5)


C = F.col
_relay = lambda t: (C("last_inflow_amount") > 0) & C("relay") & F.try_divide(C("amount"), C("last_inflow_amount")).between(t.relay_low, t.relay_high) & (C("last_inflow_gap") < t.relay_seconds)
# Ids, weights and conditions of the rules.
RULES = (
    Rule("R01", 1.0, lambda t: C("amount") > t.large, lambda: F.format_string("Amount %,.0f is over the reporting limit", "amount")),
    Rule("R02", 1.0, lambda t: C("sub_threshold_flag") & (C("tx_velocity_1h") >= t.structuring_velocity), lambda: F.format_string("%d transfers in an hour, this one just under the limit", "tx_velocity_1h")),
    Rule("R03", 0.8, lambda t: (C("tx_velocity_1h") > t.hour_velocity) | (C("tx_velocity_24h") > t.day_velocity), lambda: F.format_string("%d transfers in a day", "tx_velocity_24h")),
    Rule("R04", 0.9, lambda t: (C("tx_gap_seconds") > t.dormant_seconds) & (C("amount") > t.dormant_amount), lambda: F.format_string("First transfer after %.0f days", C("tx_gap_seconds") / 86400)),
    Rule("R05", 0.9, lambda t: C("impossible_travel_flag"), lambda: F.format_string("%.0f km from the transfer before", "geo_distance_km")),
    Rule("R06", 0.7, lambda t: C("high_risk_country_flag") & C("international"), lambda: F.lit("Cross-border transfer with a high-risk country")),
    Rule("R07", 0.6, lambda t: C("new_device_flag") & (C("amount") > t.device_amount), lambda: F.format_string("%,.0f from a new device", "amount")),
    Rule("R08", 0.7, lambda t: C("shared_device_count") > t.shared_devices, lambda: F.format_string("Device shared with %d accounts", "shared_device_count")),
    Rule("R09", 0.8, lambda t: C("beneficiary_count_7d") > t.beneficiaries, lambda: F.format_string("%d beneficiaries in a week", "beneficiary_count_7d")),
    Rule("R10", 1.0, lambda t: C("edge_creates_cycle"), lambda: F.format_string("Closes a cycle of %d transfers", "cycle_length")),
    Rule("R11", 0.6, lambda t: C("round_amount_flag") & (C("tx_velocity_24h") > t.round_velocity), lambda: F.lit("Round amounts in quick succession")),
    Rule("R12", 0.8, lambda t: (C("kyc") == 0) & (C("amount") > t.kyc_amount), lambda: F.format_string("%,.0f without identity checks", "amount")),
    Rule("R13", 0.7, lambda t: C("benford_chi2_score") > t.benford, lambda: F.format_string("Leading digits deviate (%.2f)", "benford_chi2_score")),
    Rule("R14", 0.8, lambda t: (C("in_unique_24h") >= t.fan_in) & (C("inflow_cv") < t.fan_in_cv), lambda: F.format_string("%d sources of like amounts in a day", "in_unique_24h")),
    Rule("R15", 0.9, _relay, lambda: F.format_string("%.0f%% of an inflow passed on", 100 * F.try_divide(C("amount"), C("last_inflow_amount")))),
)


def registry(rules: tuple[Rule, ...] = RULES) -> dict[str, Rule]:
    out = {r.id: r for r in rules}
    if len(out) != len(rules):
        raise ValueError("rule ids must be unique")
    return out


def evaluate(df: DataFrame, rules: tuple[Rule, ...] = RULES, limits: Limits = Limits()) -> DataFrame:
    """df with triggered_rules, rule_texts, rule_weight_sum and rule_score.

    The score is the greatest severity among fired rules, plus 10 for each
    further one up to 30, at most 100; 0 if none fires. A condition that is null
    doesn't fire, nor does one that names a column df lacks.
    """
    registry(rules)
    out = df
    known = []
    for r in rules:
        try:
            out.select(r.fires(limits), r.text())
        except Exception as e:  # a rule that can't be resolved counts as not fired
            if getattr(e, "getCondition", lambda: "")() != "UNRESOLVED_COLUMN.WITH_SUGGESTION":
                raise
            continue
        known.append(r)
    fired = {r.id: F.coalesce(r.fires(limits), F.lit(False)) for r in known}
    if not known:
        none = F.array().cast("array<string>")
        return out.select("*", none.alias("triggered_rules"), none.alias("rule_texts"), F.lit(0.0).alias("rule_weight_sum"), F.lit(0.0).alias("rule_score"))
    severity = F.array_max(F.array(*[F.when(fired[r.id], F.lit(r.severity)).otherwise(F.lit(0.0)) for r in known]))
    out = out.select(
        "*", F.array_compact(F.array(*[F.when(fired[r.id], F.lit(r.id)) for r in known])).alias("triggered_rules"), F.array_compact(F.array(*[F.when(fired[r.id], r.text()) for r in known])).alias("rule_texts"),
        sum((F.when(fired[r.id], F.lit(r.weight)).otherwise(F.lit(0.0)) for r in known[1:]), F.when(fired[known[0].id], F.lit(known[0].weight)).otherwise(F.lit(0.0))).alias("rule_weight_sum"), severity.alias("_severity"),
    )
    n = F.size("triggered_rules")
    score = F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.col("_severity") + F.least(F.lit(30.0), (n - 1) * 10.0)))
    return out.withColumn("rule_score", score).drop("_severity")
