"""Investigations: from transactions to ranked entities in one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tidemark.functions.stored import stored as shared
from tidemark.operators import aggregate, drift, evidence, filters, graph, profile, rules, stats
from tidemark.operators.features import canonical_input, features_for
from tidemark.operators.filters import TransactionFilter
from tidemark.operators.forest import Forest, score_forest
from tidemark.operators.risk import recommend, score_risk
from tidemark.policy import PATTERN_RULES

KINDS = ("pattern_search", "aggregation", "entity_lookup", "broad_eda")
GRAPH_PATTERNS = ("layering", "cycle", "bipartite", "gather_scatter", "scatter_gather")


@dataclass(frozen=True)
class InvestigationSpec:
    """What to look for. ``iqr`` bounds and ``forest`` come from a calibration table."""

    kind: str
    pattern: str | None = None
    filters: TransactionFilter = field(default_factory=TransactionFilter)
    row_key: str = "txn_id"
    iqr: tuple[float, float] = (float("-inf"), float("inf"))
    forest: Forest | None = None
    group_by: str = "from_account"
    min_count: int = 1
    window_days: int | None = None
    max_entities: int = 20

    def __post_init__(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {', '.join(KINDS)}")
        if self.kind == "entity_lookup" and self.filters.entity_id is None:
            raise ValueError("an entity lookup needs filters.entity_id")
        if self.min_count < 1:
            raise ValueError("min_count must be at least 1")

    @property
    def steps(self) -> list[str]:
        """Detectors this investigation runs, in order."""
        if self.kind == "aggregation":
            return []
        found = []
        if self.kind != "broad_eda" or self.pattern in PATTERN_RULES:
            found.append("rule_engine")
        found.append("statistical")
        if self.kind in ("pattern_search", "broad_eda") and self.forest is not None:
            found.append("ml_engine")
        if self.pattern in GRAPH_PATTERNS:
            found.append("graph")
        return found


def score_transactions(df: DataFrame, spec: InvestigationSpec) -> DataFrame:
    """Filter, add only the features the steps need, run the detectors, fuse and escalate."""
    rows = filters.load_transactions(df, spec.filters)
    steps = spec.steps
    patterns = [spec.pattern] if spec.pattern else None
    scored = features_for(rows, patterns, with_model_features="ml_engine" in steps,
                          row_key=spec.row_key)
    if "rule_engine" in steps:
        scored = rules.apply_rules(scored, patterns)
    scored = stats.add_statistics(scored, spec.iqr, canonical_input(rows))
    if "ml_engine" in steps:
        scored = score_forest(scored, spec.forest)
    return recommend(score_risk(scored, steps))


def investigate(df: DataFrame, spec: InvestigationSpec) -> dict[str, DataFrame]:
    """All results of an investigation as lazy frames."""
    if spec.kind == "aggregation":
        rows = filters.load_transactions(df, spec.filters)
        groups = aggregate.threshold_groups(
            rows, spec.group_by, min_count=spec.min_count, max_amount=spec.filters.max_amount,
            min_amount=spec.filters.min_amount, window_days=spec.window_days)
        return {"groups": aggregate.top_groups(groups, spec.group_by)}
    scored = shared(score_transactions(df, spec))
    out = {"scored": scored,
           "summary": evidence.flag_summary(scored),
           "entities": evidence.flagged_entities(scored, spec.row_key, spec.pattern,
                                                 spec.max_entities)}
    if "graph" in spec.steps:
        rows = filters.load_transactions(df, spec.filters)
        out.update({f"graph_{n}": d for n, d in graph.find_patterns(rows).parts.items()})
    if spec.kind == "broad_eda":
        rows = filters.load_transactions(df, spec.filters)
        out.update({"eda_summary": profile.eda_summary(rows),
                    "daily": profile.daily_counts(rows),
                    "formats": profile.category_top(rows, "payment_format"),
                    "percentiles": profile.amount_percentiles(rows),
                    "histogram": profile.amount_histogram(rows),
                    "volume": profile.customer_volume(rows),
                    "hours": profile.weekday_hour_grid(rows),
                    "missing": profile.missing_counts(rows)})
    return out


def drift_job(baseline: DataFrame, current: DataFrame, row_key: str | None = None) -> DataFrame:
    """Model features of both transaction sets, compared."""
    sides = [shared(features_for(df, [], with_model_features=True, row_key=row_key))
             for df in (baseline, current)]
    return drift.drift_report(*sides)
