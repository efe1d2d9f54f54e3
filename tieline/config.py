"""Parameters of a detection or evaluation run."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal


@dataclass(frozen=True)
class DetectConfig:
    """Everything a run can be tuned by; the defaults are the published ones."""

    risk_threshold: int = 70
    confidence_threshold: Decimal = Decimal("0.6")
    min_cluster_accounts: int = 3
    min_events_per_account: int = 2

    max_accounts_per_node: int = 40
    min_edge_weight: Decimal = Decimal("0.3")
    min_cluster_size: int = 2

    louvain_passes: int = 20
    stability_runs: int = 3

    match_floor: Decimal = Decimal("0.3")
    cost_false_positive: int = 6
    cost_false_negative: int = 10
    cost_abstention: int = 1
    threshold_candidates: tuple[int, ...] = (50, 55, 60, 65, 70, 75, 80, 85, 90)

    # reports
    list_default: int = 50
    list_ceiling: int = 200

    # Links of a component that one Python worker searches or visits in turn
    # (about 300 bytes each); larger components are contracted or visited by
    # joins, with the same result.
    max_group_rows: int = 2_000_000


@dataclass(frozen=True)
class BaselineThresholds:
    """Cut-offs of the per-account baseline, rates in ten-thousandths."""

    return_rate: int = 4500
    refund_share: int = 5000
    min_orders: int = 3
    fast_return_days: int = 5

    return_rate_candidates: tuple[int, ...] = (2500, 3000, 3500, 4000, 4500, 5000, 6000, 7000)
