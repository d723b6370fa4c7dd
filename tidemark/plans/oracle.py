"""SQL text of the shared views, for checking results in an independent engine."""

from __future__ import annotations

from tidemark import policy as P
from tidemark.plans.views import LEDGER_CTE, TXN_CTE


def quoted(names) -> str:
    return ", ".join("'" + n.replace("'", "''") + "'" for n in names)


_RISKY = quoted(P.HIGH_RISK_COUNTRIES)
COUNTRY = f"(lower(trim(from_country)) IN ({_RISKY}) OR lower(trim(to_country)) IN ({_RISKY}))"

KNOWLEDGE = """knowledge AS (
  SELECT event_id, timestamp, txn_date, from_account, to_account, amount_paid AS amount,
    paying_currency AS payment_currency, receiving_currency AS received_currency, from_country,
    to_country, payment_format, CASE WHEN payment_format <> 'ACH' THEN 1 ELSE 0 END AS is_laundering,
    laundering_type FROM txn)"""


def features(source: str = "txn", name: str = "feat") -> str:
    return f"""{name}_in AS (
  SELECT c.event_id, count(DISTINCT h.from_account) AS fan_in_count FROM {source} c JOIN {source} h
    ON h.to_account = c.to_account AND h.timestamp <= c.timestamp
    AND h.timestamp >= c.timestamp - INTERVAL 48 HOUR GROUP BY c.event_id),
{name}_out AS (
  SELECT c.event_id, count(DISTINCT h.to_account) AS fan_out_count FROM {source} c JOIN {source} h
    ON h.from_account = c.from_account AND h.timestamp <= c.timestamp
    AND h.timestamp >= c.timestamp - INTERVAL 48 HOUR GROUP BY c.event_id),
{name}_flow AS (
  SELECT c.event_id, sum(h.amount_paid) AS recent_inflow_24h FROM {source} c JOIN {source} h
    ON h.to_account = c.from_account AND h.timestamp <= c.timestamp
    AND h.timestamp >= c.timestamp - INTERVAL 24 HOUR GROUP BY c.event_id),
{name}_win AS (
  SELECT *, count(*) OVER w7 AS txn_count_7d, sum(amount_paid) OVER w7 AS rolling_sum_7d,
    CAST(sum(CASE WHEN amount_paid >= 8000 AND amount_paid < 10000 THEN 1 ELSE 0 END) OVER w7
         AS BIGINT) AS near_threshold_count,
    count(*) OVER w1 AS velocity_1hr, sum(amount_paid) OVER w48 AS fan_in_sum_48h,
    avg(amount_paid) OVER wp AS prior_mean
  FROM {source}
  WINDOW w7 AS (PARTITION BY from_account ORDER BY timestamp
                RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW),
         w1 AS (PARTITION BY from_account ORDER BY timestamp
                RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
         w48 AS (PARTITION BY to_account ORDER BY timestamp
                 RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW),
         wp AS (PARTITION BY from_account ORDER BY timestamp, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (
  SELECT t.* EXCLUDE (prior_mean), coalesce(i.fan_in_count, 0) AS fan_in_count,
    coalesce(o.fan_out_count, 0) AS fan_out_count,
    coalesce(f.recent_inflow_24h, 0.0) AS recent_inflow_24h,
    CASE WHEN prior_mean IS NULL OR prior_mean = 0 THEN 0.0
         ELSE abs(amount_paid - prior_mean) / abs(prior_mean) END AS amount_deviation,
    CAST(CASE WHEN trim(from_country) <> '' AND trim(to_country) <> ''
         AND lower(trim(from_country)) <> lower(trim(to_country)) THEN 1 ELSE 0 END AS BIGINT)
      AS cross_border_flag
  FROM {name}_win t LEFT JOIN {name}_in i USING (event_id) LEFT JOIN {name}_out o USING (event_id)
  LEFT JOIN {name}_flow f USING (event_id))"""


RULE_SQL = {
    "structuring": "amount_paid >= 8000 AND amount_paid < 10000 AND near_threshold_count >= 3",
    "smurfing": ("(fan_in_count >= 3 AND fan_in_sum_48h >= 10000) OR "
                 "(lower(trim(payment_format)) = 'cash deposit' AND txn_count_7d >= 3 "
                 "AND rolling_sum_7d >= 10000)"),
    "rapid_cashout": ("lower(trim(payment_format)) IN ('cash withdrawal', 'cash') AND "
                      "(recent_inflow_24h > 0 OR txn_count_7d >= 3)"),
    "single_large": "amount_paid >= 10000",
    "deposit_send": "recent_inflow_24h > 0",
    "fan_in": "fan_in_count >= 3",
    "fan_out": "fan_out_count >= 3",
    "high_risk_country": COUNTRY,
}


def flags(rules: list[str], source: str, name: str = "ruled") -> str:
    """Rows with the fired rules as a list and their share."""
    parts = ", ".join(f"CASE WHEN {RULE_SQL[r]} THEN '{r}' END" for r in rules)
    return f"""{name} AS (
  SELECT *, len(rule_flags) / {len(rules)}.0::DOUBLE AS rule_score FROM (
    SELECT *, list_filter([{parts}], lambda x: x IS NOT NULL) AS rule_flags FROM {source}) q)"""


BOUNDS = """bounds AS (
  SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound
  FROM (SELECT quantile_cont(amount_paid, 0.25) AS q1, quantile_cont(amount_paid, 0.75) AS q3
        FROM txn WHERE is_laundering = 0) q)"""


def statistics(source: str, name: str = "stated", bounds: bool = True) -> str:
    outside = "(amount_paid < lower_bound OR amount_paid > upper_bound)" if bounds else "false"
    join = ", bounds" if bounds else ""
    return f"""{name} AS (
  SELECT *, greatest(least(abs(z_score) / 3, 1.0), CASE WHEN iqr_flag THEN 1.0 ELSE 0.0 END)
    AS stat_score FROM (
    SELECT *, CASE WHEN sd IS NULL OR sd = 0 THEN 0.0 ELSE (amount_paid - mu) / sd END AS z_score,
      {outside} AS iqr_flag
    FROM (SELECT *, avg(amount_paid) OVER (PARTITION BY from_account) AS mu,
            stddev_pop(amount_paid) OVER (PARTITION BY from_account) AS sd FROM {source}) q{join}) q)"""


def risk(source: str, name: str = "scored", rules_ran: bool = True) -> str:
    base = ("(rule_score * 0.40 / 0.65 + stat_score * 0.25 / 0.65)" if rules_ran
            else "stat_score * 0.25 / 0.25")
    return f"""{name} AS (
  SELECT *, CASE WHEN risk_score < 0.35 THEN 'low' WHEN risk_score < 0.70 THEN 'medium'
    ELSE 'high' END AS risk_label,
    CASE WHEN risk_score < 0.40 THEN 'monitor' WHEN risk_score < 0.70 THEN 'flag_for_review'
    ELSE 'report' END AS escalation_action
  FROM (SELECT *, round(greatest(least({base} + CASE WHEN {COUNTRY} THEN 0.10 ELSE 0.0 END, 1.0),
                                 0.0), 12) AS risk_score FROM {source}) q)"""


def best(source: str = "scored", name: str = "best") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
      PARTITION BY from_account ORDER BY risk_score DESC, event_id) AS rn
    FROM {source} WHERE risk_score >= 0.35) q WHERE rn = 1)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ALL_RULES = list(P.RULE_ORDER)
FULL = [TXN_CTE, features(), flags(ALL_RULES, "feat"), BOUNDS, statistics("ruled"),
        risk("stated")]

TYPOLOGY_VALUES = "typologies(typology, typology_name, typology_label, reg_ref) AS (VALUES " + \
    ", ".join("(" + quoted([k, *v]) + ")" for k, v in P.TYPOLOGIES.items()) + ")"
FLAG_CASE = "CASE list_extract(list_filter(rule_flags, lambda x: x <> 'high_risk_country'), 1) " + \
    " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.FLAG_TYPOLOGY.items()) + " END"

ALERTS = """alerts AS (
  SELECT 'ALT-' || upper(substr(sha256(inv || '|' || from_account), 1, 12)) AS alert_id,
    from_account AS entity_id, inv AS investigation_id, risk_score, risk_label,
    escalation_action, '' AS typology, timestamp AS created_at,
    CAST(CASE escalation_action WHEN 'report' THEN 4 WHEN 'flag_for_review' THEN 24 ELSE 72 END
         AS INTEGER) AS sla_hours, 'new' AS status, 'pending' AS disposition
  FROM (SELECT *, 'INV-' || CAST(CAST(substr(from_account, 2) AS BIGINT) % 7 AS VARCHAR) AS inv
        FROM best) q)"""
ACTIONS = """actions AS (
  SELECT 'ALT-' || upper(substr(sha256('INV-' || CAST(user_id % 7 AS VARCHAR) || '|A' ||
      CAST(user_id AS VARCHAR)), 1, 12)) AS alert_id, event_id AS seq,
    CASE event_id % 3 WHEN 0 THEN 'assign' WHEN 1 THEN 'disposition' ELSE 'note' END AS action,
    'analyst_' || CAST(event_id % 4 AS VARCHAR) AS actor,
    CASE event_id % 3 WHEN 0 THEN 'analyst_' || CAST(event_id % 5 AS VARCHAR)
      WHEN 1 THEN CASE event_id % 4 WHEN 0 THEN 'escalated' WHEN 1 THEN 'false_positive'
        WHEN 2 THEN 'true_positive' ELSE 'escalated' END
      ELSE 'note ' || CAST(event_id AS VARCHAR) END AS value, ts AS acted FROM events)"""
FOLDED = """folded AS (
  SELECT a.* EXCLUDE (status, disposition), l.assigned_to, coalesce(l.moved, a.status) AS status,
    coalesce(l.decision, a.disposition) AS disposition, coalesce(l.note_count, 0) AS note_count,
    l.last_note
  FROM alerts a LEFT JOIN (
    SELECT alert_id, arg_max(value, seq) FILTER (WHERE action = 'assign') AS assigned_to,
      arg_max(value, seq) FILTER (WHERE action = 'disposition') AS decision,
      arg_max(CASE WHEN action = 'assign' THEN 'in_review'
                   WHEN value IN ('escalated', 'sar_filed') THEN 'escalated' ELSE 'closed' END, seq)
        FILTER (WHERE action <> 'note') AS moved,
      count(*) FILTER (WHERE action = 'note') AS note_count,
      arg_max('[' || strftime(acted, '%Y-%m-%dT%H:%M:%S') || '] ' || actor || ': ' || value, seq)
        FILTER (WHERE action = 'note') AS last_note
    FROM actions GROUP BY alert_id) l USING (alert_id))"""
QUEUE = [*FULL, best(), ALERTS, ACTIONS, FOLDED]
