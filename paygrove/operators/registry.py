"""Declared features: what each one computes, over which window and key, and what null means."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field

KINDS = (
    "flag", "count", "sum", "mean_int", "mean", "std", "min", "max", "median", "quantile", "distinct", "lifetime_distinct",
    "first_ever", "recency_hours", "age_days", "quotient", "difference", "row_value", "code", "robust_z", "burstiness",
    "cv", "benford", "graph", "rule",
)
NULL_POLICIES = (
    "never_null", "null_when_window_empty", "null_when_zero_denominator", "null_when_indeterminate",
    "null_without_prior_event", "null_when_balance_absent", "null_when_unobserved", "null_when_no_rule_hit",
)
WINDOWS = {"24h": 86_400_000_000, "30d": 30 * 86_400_000_000, "lifetime": None, "point_in_time": None, "fold_scoped": None}


@dataclass(frozen=True)
class Feature:
    name: str
    group: str
    kind: str
    source: str = ""
    where: str = "always"
    window: str = "point_in_time"
    keys: tuple[str, ...] = ("entity",)
    null: str = "never_null"
    role: str = "feature"
    args: tuple = field(default=())

    @property
    def width(self) -> int | None:
        return WINDOWS[self.window]

    @property
    def needs(self) -> tuple[str, ...]:
        """Names of other features or rows that this one reads."""
        return tuple(a for a in (self.source, self.where, *self.args) if isinstance(a, str) and a)


def _of(group: str, *rows: tuple) -> list[Feature]:
    out = []
    for name, kind, source, where, window, keys, null, role, *args in rows:
        out.append(Feature(name, group, kind, source, where or "always", window, tuple(keys.split()), null, role, tuple(args)))
    return out


E, EC, ED, EP = "entity", "entity currency", "entity direction", "entity counterparty"
N0, NW, NZ, NI, NP, NB, NU, NR = NULL_POLICIES
P, D1, D30, LT, FS = "point_in_time", "24h", "30d", "lifetime", "fold_scoped"
F_, I_ = "feature", "intermediate"
BPS = 10_000

# The declared features, in declared order.
FEATURES: list[Feature] = [
    *_of(
        "volume_value",
        ("is_zero_value", "flag", "zero_amount", "", P, E, N0, I_),
        ("txn_count_in_24h", "count", "", "", D1, E, N0, F_),
        ("txn_count_in_30d", "count", "", "", D30, E, N0, F_),
        ("zero_value_count_30d", "count", "", "is_zero_value", D30, E, N0, F_),
        ("amount_in_24h_minor", "sum", "amount_minor", "is_inflow_nonzero", D1, EC, N0, F_),
        ("amount_in_30d_minor", "sum", "amount_minor", "is_inflow_nonzero", D30, EC, N0, F_),
        ("amount_out_24h_minor", "sum", "amount_minor", "is_outflow_nonzero", D1, EC, N0, F_),
        ("amount_out_30d_minor", "sum", "amount_minor", "is_outflow_nonzero", D30, EC, N0, F_),
        ("inflow_count_30d", "count", "", "is_inflow", D30, E, N0, F_),
        ("net_flow_30d_minor", "difference", "amount_in_30d_minor", "", D30, E, N0, F_, "amount_out_30d_minor"),
        ("typical_movement_30d_minor", "median", "amount_minor", "", D30, ED, NW, F_),
        ("largest_movement_30d_minor", "max", "amount_minor", "", D30, ED, NW, F_),
        ("amount_in_mean_30d_minor", "quotient", "amount_in_30d_minor", "", D30, E, NZ, F_, "inflow_count_30d", 1),
        ("balance_kept_share_30d_bps", "quotient", "net_flow_30d_minor", "", D30, E, NZ, F_, "amount_in_30d_minor", BPS),
        ("amount_robust_z_last", "robust_z", "amount_minor", "is_nonzero", D30, E, NI, F_),
        ("benford_deviation_30d", "benford", "amount_minor", "is_nonzero", D30, E, NI, F_),
        ("nonzero_inflow_count_30d", "count", "", "is_inflow_nonzero", D30, E, N0, I_),
    ),
    *_of(
        "counterparty",
        ("is_self_transfer", "flag", "self_transfer", "", P, E, N0, I_),
        ("not_self_transfer", "flag", "not_self_transfer", "", P, E, N0, I_),
        ("is_reversal", "flag", "reversal_txn", "", P, E, N0, F_),
        ("reversal_linked_count_30d", "count", "", "is_reversal", D30, E, N0, F_),
        ("lifetime_counterparties", "lifetime_distinct", "counterparty", "not_self_transfer", LT, E, N0, F_),
        ("lifetime_inflow_counterparties", "lifetime_distinct", "counterparty", "is_inflow_not_self", LT, E, N0, F_),
        ("lifetime_outflow_counterparties", "lifetime_distinct", "counterparty", "is_outflow_not_self", LT, E, N0, F_),
        ("is_counterparty_first_ever", "first_ever", "counterparty", "not_self_transfer", LT, E, N0, I_),
        ("counterparties_first_seen_30d", "sum", "is_counterparty_first_ever", "", D30, E, N0, F_),
        ("new_counterparty_share_of_network_bps", "quotient", "counterparties_first_seen_30d", "", D30, E, NZ, F_, "lifetime_counterparties", BPS),
        ("nonself_visit_count_30d", "count", "", "not_self_transfer", D30, E, N0, I_),
        ("repeat_visit_count_30d", "difference", "nonself_visit_count_30d", "", D30, E, N0, I_, "counterparties_first_seen_30d"),
        ("repeat_visit_share_30d_bps", "quotient", "repeat_visit_count_30d", "", D30, E, NZ, F_, "txn_count_in_30d", BPS),
        ("pair_visit_count_30d", "count", "", "not_self_transfer", D30, EP, N0, F_),
        ("largest_pair_visit_count_30d", "max", "pair_visit_count_30d", "", D30, E, N0, I_),
        ("top_counterparty_share_30d_bps", "quotient", "largest_pair_visit_count_30d", "", D30, E, NZ, F_, "txn_count_in_30d", BPS),
        ("is_amount_first_ever", "first_ever", "amount_minor", "is_nonzero", LT, E, N0, I_),
        ("amounts_first_seen_30d", "sum", "is_amount_first_ever", "", D30, E, N0, I_),
        ("lifetime_distinct_amounts", "lifetime_distinct", "amount_minor", "is_nonzero", LT, E, N0, F_),
        ("amount_repeat_count_30d", "difference", "nonzero_inflow_count_30d", "", D30, E, N0, I_, "amounts_first_seen_30d"),
        ("amount_repetition_30d_bps", "quotient", "amount_repeat_count_30d", "", D30, E, NZ, F_, "nonzero_inflow_count_30d", BPS),
    ),
    *_of(
        "temporal",
        ("gap_since_previous_event_s", "row_value", "gap_since_previous_event_s", "", P, E, NP, I_),
        ("dormancy_days_before_now", "row_value", "gap_since_previous_event_days", "", P, E, NP, F_),
        ("interarrival_mean_30d_s", "mean_int", "gap_since_previous_event_s", "has_prior_event", D30, E, NW, F_),
        ("interarrival_burstiness_30d", "burstiness", "gap_since_previous_event_s", "has_prior_event", D30, E, NI, F_),
        ("active_days_30d", "distinct", "event_date_local", "", D30, E, N0, F_),
        ("txns_per_active_day_30d_bps", "quotient", "txn_count_in_30d", "", D30, E, NZ, F_, "active_days_30d", BPS),
        ("is_overnight_hour", "flag", "overnight_local_hour", "", P, E, N0, I_),
        ("overnight_count_30d", "count", "", "is_overnight_hour", D30, E, N0, I_),
        ("overnight_share_30d_bps", "quotient", "overnight_count_30d", "", D30, E, NZ, F_, "txn_count_in_30d", BPS),
        ("is_weekend_local_date", "flag", "weekend_local_date", "", P, E, N0, I_),
        ("weekend_count_30d", "count", "", "is_weekend_local_date", D30, E, N0, I_),
        ("weekend_share_30d_bps", "quotient", "weekend_count_30d", "", D30, E, NZ, F_, "txn_count_in_30d", BPS),
        ("local_hour_code", "code", "local_hour", "", P, E, N0, F_),
        ("txn_type_code", "code", "txn_type", "", P, E, N0, F_),
        ("account_age_days", "age_days", "ts_us", "", LT, E, N0, F_),
    ),
    *_of(
        "balance_proxy",
        ("balance_delta_abs_minor", "row_value", "balance_delta_abs_minor", "", P, E, NB, I_),
        ("has_balance_delta", "flag", "has_balance_delta", "", P, E, N0, I_),
        ("is_balance_delta_mismatch", "flag", "balance_delta_mismatch", "", P, E, NB, I_),
        ("balance_mismatch_count_30d", "count", "", "is_balance_delta_mismatch", D30, E, N0, I_),
        ("balance_mismatch_share_30d_bps", "quotient", "balance_mismatch_count_30d", "", D30, E, NZ, F_, "txn_count_in_30d", BPS),
        ("balance_delta_total_30d_minor", "sum", "balance_delta_abs_minor", "has_balance_delta", D30, E, N0, F_),
        ("balance_after_mean_30d_minor", "mean_int", "balance_after", "has_balance", D30, E, NW, F_),
        ("is_zero_balance_after", "flag", "zero_balance_after", "", P, E, NB, I_),
        ("drained_balance_count_30d", "count", "", "is_zero_balance_after", D30, E, N0, F_),
        ("drained_balance_share_30d_bps", "quotient", "drained_balance_count_30d", "", D30, E, NZ, F_, "txn_count_in_30d", BPS),
        ("since_last_drain_hours", "recency_hours", "", "is_zero_balance_after", LT, E, NP, F_),
    ),
    *_of(
        "exposure",
        ("extractable_share_24h_bps", "quotient", "amount_out_24h_minor", "", D1, E, NZ, F_, "amount_in_24h_minor", BPS),
        ("extract_velocity_bps", "quotient", "amount_out_24h_minor", "", D30, E, NZ, F_, "amount_out_30d_minor", BPS),
        ("downstream_outflow_24h_minor", "graph", "downstream_outflow_24h_minor", "", FS, E, NU, F_),
    ),
    *_of(
        "graph_local",
        ("graph_in_degree_30d", "graph", "in_degree", "", FS, E, NU, F_),
        ("graph_out_degree_30d", "graph", "out_degree", "", FS, E, NU, F_),
        ("graph_effective_fan_in_30d", "graph", "fan_in_effective", "", FS, E, NU, F_),
        ("graph_effective_fan_out_30d", "graph", "fan_out_effective", "", FS, E, NU, F_),
        ("graph_local_density_30d_bps", "graph", "local_density_bps", "", FS, E, NU, F_),
        ("graph_self_transfer_count_30d", "graph", "self_transfer_count", "", FS, E, NU, F_),
    ),
    *_of(
        "graph_global",
        ("graph_pagerank", "graph", "pagerank", "", FS, E, NU, F_),
        ("graph_betweenness_approx", "graph", "betweenness_approx", "", FS, E, NU, F_),
        ("graph_k_core_number", "graph", "k_core_number", "", FS, E, NU, F_),
        ("graph_community_size", "graph", "community_size", "", FS, E, NU, F_),
        ("graph_community_id", "graph", "community_id", "", FS, E, NU, F_),
    ),
    *_of(
        "graph_typology",
        ("graph_cycle_participation_count", "graph", "cycle_participation_count", "", FS, E, NU, F_),
        ("graph_max_cycle_retention_bps", "graph", "max_cycle_retention_bps", "", FS, E, NU, F_),
        ("graph_longest_chain_length", "graph", "longest_chain_length", "", FS, E, NU, F_),
        ("graph_is_external", "graph", "is_external", "", FS, E, NU, F_),
    ),
    *_of(
        "rule_derived",
        ("rule_r1_pass_through_severity", "rule", "R1", "", FS, E, NR, F_),
        ("rule_r2_fan_in_severity", "rule", "R2", "", FS, E, NR, F_),
        ("rule_r3_fan_out_severity", "rule", "R3", "", FS, E, NR, F_),
        ("rule_r4_cycle_severity", "rule", "R4", "", FS, E, NR, F_),
        ("rule_r5_structuring_severity", "rule", "R5", "", FS, E, NR, F_),
        ("rule_r6_velocity_severity", "rule", "R6", "", FS, E, NR, F_),
        ("rule_r7_dormant_severity", "rule", "R7", "", FS, E, NR, F_),
        ("rule_r8_odd_hour_severity", "rule", "R8", "", FS, E, NR, F_),
        ("rule_r9_regime_shift_severity", "rule", "R9", "", FS, E, NR, F_),
        ("rule_r10_fast_cash_out_severity", "rule", "R10", "", FS, E, NR, F_),
        ("rule_r11_new_counterparty_severity", "rule", "R11", "", FS, E, NR, F_),
        ("rule_r12_chain_severity", "rule", "R12", "", FS, E, NR, F_),
        ("rule_hit_count", "rule", "COUNT", "", FS, E, NR, F_),
        ("rule_severity_max", "rule", "MAX", "", FS, E, NR, F_),
    ),
]


class RegistryError(ValueError):
    """A declaration that can't be compiled."""


def check(features: list[Feature], row_columns: set[str], predicates: set[str]) -> list[list[Feature]]:
    """The features in dependency layers; refuses unknown kinds, names, windows, policies and labels."""
    names = [f.name for f in features]
    if len(set(names)) != len(names):
        raise RegistryError("a feature is declared twice")
    by = {f.name: f for f in features}
    for f in features:
        if f.kind not in KINDS or f.null not in NULL_POLICIES or f.window not in WINDOWS or f.role not in ("feature", "intermediate", "outcome"):
            raise RegistryError(f"{f.name}: unknown kind, null policy, window or role")
        if any(n.startswith("label_") for n in f.needs):
            raise RegistryError(f"{f.name}: labels never enter the matrix")
        if f.kind in ("graph", "rule"):
            continue
        known = predicates | row_columns | set(by)
        if bad := [n for n in f.needs if n not in known]:
            raise RegistryError(f"{f.name}: unknown {bad}")
    layers, placed, left = [], set(), list(features)
    while left:
        ready = [f for f in left if f.kind in ("graph", "rule") or all(n not in by or n in placed or n == f.name for n in f.needs)]
        if not ready:
            raise RegistryError(f"a cycle among {[f.name for f in left]}")
        layers.append(ready)
        placed |= {f.name for f in ready}
        left = [f for f in left if f.name not in placed]
    return layers


def spec_hash(features: list[Feature]) -> str:
    """Digest of the declarations; a stored table that carries another one is refused."""
    return hashlib.sha256(json.dumps([asdict(f) for f in features], sort_keys=True).encode()).hexdigest()
