"""Review queue as an append-only log: alerts, actions and audit events.

Nothing is updated in place. The state of an alert is a fold over its actions, written as
``max_by`` aggregates that combine on the map side, so an alert with very many actions
costs no more than one with few.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.paging import page
from tidemark.policy import SLA_HOURS

# --- fixed values: statuses, dispositions and orderings -------------------------------
STATUSES = ["new", "in_review", "escalated", "closed"]
STATUS_ORDER = {"escalated": 0, "new": 1, "in_review": 2}
LABEL_ORDER = {"high": 0, "medium": 1}
QUEUE_DISPOSITIONS = {"escalated": "escalated", "sar_filed": "escalated"}
GOVERNED_DISPOSITIONS = {"true_positive": "in_review", "false_positive": "closed",
                         "escalated": "escalated"}
# --- end of fixed values --------------------------------------------------------------


def _pick(column: str | Column, table: dict, default) -> Column:
    value = F.col(column) if isinstance(column, str) else column
    out = F.lit(default)
    for key, result in table.items():
        out = F.when(value == key, result).otherwise(out)
    return out


def alert_id(investigation: Column, entity: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", investigation, entity).cast("binary"), 256)
    return F.concat(F.lit("ALT-"), F.upper(F.substring(digest, 1, 12)))


def alerts_from_findings(findings: DataFrame, investigation_id: str | Column,
                         created_at: datetime | Column) -> DataFrame:
    """One new alert per finding (entity_id, risk_score, risk_label, escalation_action and,
    where known, typology_label)."""
    inv = F.lit(investigation_id) if isinstance(investigation_id, str) else investigation_id
    at = created_at if isinstance(created_at, Column) else F.lit(created_at)
    typology = "typology_label" if "typology_label" in findings.columns else F.lit("")
    return findings.select(
        alert_id(inv, F.col("entity_id")).alias("alert_id"), "entity_id",
        inv.alias("investigation_id"), "risk_score", "risk_label", "escalation_action",
        F.coalesce(typology, F.lit("")).alias("typology"), at.alias("created_at"),
        _pick("escalation_action", SLA_HOURS, None).cast("int").alias("sla_hours"),
        F.lit(None).cast("string").alias("assigned_to"), F.lit("new").alias("status"),
        F.lit("pending").alias("disposition"))


def audit_events(alerts: DataFrame, actions: DataFrame, *, policy_version: str,
                 model_version: str = "", snapshot: str = "",
                 governed: bool = False) -> DataFrame:
    """Audit rows for created alerts, finished investigations and analyst actions.

    The governed variant records the length of a note instead of its text.
    """
    def row(event: Column, actor: Column, inv: Column, alert: Column, at: Column,
            payload: Column) -> list[Column]:
        key = F.concat_ws("|", event, inv, alert, at.cast("string"), payload)
        return [F.concat(F.lit("EVT-"), F.upper(F.substring(F.sha2(key.cast("binary"), 256), 1, 16)))
                 .alias("event_id"), event.alias("event_type"), actor.alias("actor"),
                inv.alias("investigation_id"), alert.alias("alert_id"),
                payload.alias("payload"), F.lit(policy_version).alias("risk_policy_version"),
                F.lit(model_version).alias("model_version"),
                F.lit(snapshot).alias("dataset_snapshot"), at.alias("created_at")]

    none, system = F.lit(None).cast("string"), F.lit("system")
    created = alerts.select(*row(
        F.lit("alert_created"), system, F.col("investigation_id"), F.col("alert_id"),
        F.col("created_at"), F.to_json(F.struct(
            "entity_id", "risk_score", "risk_label",
            F.col("escalation_action").alias("recommended_action")))))
    finished = (alerts.groupBy("investigation_id")
                .agg(F.count("*").alias("flagged"),
                     F.count_if(F.col("risk_label") == "high").alias("high_risk"),
                     F.max("created_at").alias("created_at"))
                .select(*row(F.lit("investigation_completed"), system, F.col("investigation_id"),
                             none, F.col("created_at"),
                             F.to_json(F.struct("flagged", "high_risk")))))
    names = {"assign": "alert_assigned", "disposition": "alert_dispositioned",
             "note": "alert_note_added" if governed else "analyst_note_added"}
    said = (F.struct(F.length("value").alias("note_length")) if governed
            else F.struct(F.trim("value").alias("note")))
    payload = (F.when(F.col("action") == "assign",
                      F.to_json(F.struct(F.col("value").alias("assigned_to"))))
                .when(F.col("action") == "disposition",
                      F.to_json(F.struct(F.col("value").alias("disposition"),
                                         _decided(governed).alias("status"))))
                .otherwise(F.to_json(said)))
    acted = actions.join(alerts.select("alert_id", "investigation_id"), "alert_id").select(*row(
        _pick("action", names, None), F.col("actor"), F.col("investigation_id"),
        F.col("alert_id"), F.col("at"), payload))
    return created.unionByName(finished).unionByName(acted)


def _decided(governed: bool) -> Column:
    """Status a disposition leads to."""
    return _pick("value", GOVERNED_DISPOSITIONS if governed else QUEUE_DISPOSITIONS,
                 None if governed else "closed")


def fold_actions(alerts: DataFrame, actions: DataFrame, *, governed: bool = False) -> DataFrame:
    """Current state of every alert from its action log (alert_id, seq, action, actor,
    value, at).

    Assigning moves an alert into review (in the governed variant only a new one);
    a disposition sets the status its policy names; later actions win.
    """
    assign, decide = F.col("action") == "assign", F.col("action") == "disposition"
    decided = _decided(governed)
    moved = F.when(assign, "in_review").when(decide, decided)
    note = F.col("action") == "note"
    latest = actions.groupBy("alert_id").agg(
        F.max_by("value", F.when(assign, F.col("seq"))).alias("_assignee"),
        F.max_by("value", F.when(decide, F.col("seq"))).alias("_disposition"),
        F.max_by(moved, F.when(assign | decide, F.col("seq"))).alias("_moved"),
        F.max_by(decided, F.when(decide, F.col("seq"))).alias("_decided"),
        F.count_if(assign).alias("_assigns"), F.count_if(note).alias("note_count"),
        F.max_by(note_line(), F.when(note, F.col("seq"))).alias("last_note"))
    status = (F.coalesce("_decided", F.when(F.col("_assigns") > 0, "in_review"), "status")
              if governed else F.coalesce("_moved", "status"))
    return (alerts.join(latest, "alert_id", "left")
                  .withColumn("assigned_to", F.coalesce("_assignee", "assigned_to"))
                  .withColumn("status", status)
                  .withColumn("disposition", F.coalesce("_disposition", "disposition"))
                  .withColumn("note_count", F.coalesce("note_count", F.lit(0)))
                  .drop("_assignee", "_disposition", "_moved", "_decided", "_assigns"))


def note_line() -> Column:
    stamp = F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(F.lit("["), stamp, F.lit("] "), F.col("actor"), F.lit(": "), F.col("value"))


def alert_notes(actions: DataFrame) -> DataFrame:
    """Every note as its own stamped line; ``seq`` gives the order within an alert.

    Kept long: a single text per alert would put all notes of a busy alert into one cell.
    """
    return (actions.where(F.col("action") == "note")
                   .select("alert_id", "seq", note_line().alias("line")))


def notes_page(actions: DataFrame, alert: str, *, limit: int | None = None, offset: int = 0) -> DataFrame:
    """One alert's notes in writing order as one text, or a page of them if ``limit`` is given."""
    shown = (alert_notes(actions).where(F.col("alert_id") == alert)
             .orderBy("seq").offset(offset))
    shown = shown if limit is None else shown.limit(limit)
    lines = F.array_sort(F.collect_list(F.struct("seq", "line")))
    return shown.groupBy("alert_id").agg(
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("notes"))


def queue_view(alerts: DataFrame, as_of: datetime | Column, *, digits: int = 2,
               governed: bool = False) -> DataFrame:
    """Add the age in hours at ``as_of`` and whether the service level is missed.

    The governed variant counts both instants by their whole second.
    """
    now = (as_of if isinstance(as_of, Column) else F.lit(as_of)).cast("timestamp")
    made = F.col("created_at").cast("timestamp")
    seconds = (F.unix_seconds(now) - F.unix_seconds(made) if governed
               else (F.unix_micros(now) - F.unix_micros(made)) / 1e6)
    age = F.greatest(F.lit(0), seconds) / 3600.0
    return (alerts.withColumn("age_hours", F.round(age, digits))
                  .withColumn("sla_breached", (age > F.col("sla_hours"))
                              & (F.col("status") != "closed")))


def rank_queue(alerts: DataFrame, *, status: str | None = None, limit: int = 100) -> DataFrame:
    """Escalated, new, in review, then the rest; highest risk and oldest first."""
    if status is not None:
        alerts = alerts.where(F.col("status") == status)
    return alerts.orderBy(_pick("status", STATUS_ORDER, 3), F.desc("risk_score"),
                          "created_at", "alert_id").limit(limit)


def governed_queue(alerts: DataFrame, *, status: str | None = None,
                   assigned_to: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """By risk label, oldest first; optionally one status or analyst."""
    for name, value in (("status", status), ("assigned_to", assigned_to)):
        if value:
            alerts = alerts.where(F.col(name) == value)
    return (alerts.orderBy(_pick("risk_label", LABEL_ORDER, 2), "created_at", "alert_id")
                  .offset(offset).limit(limit))


def entity_alerts(alerts: DataFrame, k: int = 25) -> DataFrame:
    """The newest k alerts of every entity."""
    rank = Window.partitionBy("entity_id").orderBy(F.desc("created_at"), "alert_id")
    return (alerts.withColumn("position", F.row_number().over(rank))
                  .where(F.col("position") <= k))


def queue_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count("*").alias("total"),
                      *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def investigation_rollup(alerts: DataFrame) -> DataFrame:
    """Status and disposition of every investigation from its alerts."""
    def any_of(test: Column) -> Column:
        return F.coalesce(F.bool_or(test), F.lit(False))

    facts = alerts.groupBy("investigation_id").agg(
        F.count("*").alias("alert_count"),
        any_of(F.col("status") == "escalated").alias("_escalated"),
        any_of(F.col("status").isin("new", "in_review")).alias("_open"),
        any_of(F.col("disposition") == "true_positive").alias("_true"),
        any_of(F.col("disposition") != "pending").alias("_decided"))
    status = (F.when(F.col("_escalated"), "escalated").when(F.col("_open"), "in_review")
               .otherwise("closed"))
    return (facts.withColumn("status", status)
                 .withColumn("disposition", F.when(F.col("status") == "escalated", "escalated")
                             .when((F.col("status") == "closed") & F.col("_true"), "true_positive")
                             .when((F.col("status") == "closed") & F.col("_decided"),
                                   "false_positive").otherwise("pending"))
                 .drop("_escalated", "_open", "_true", "_decided"))


def investigation_list(investigations: DataFrame, alerts: DataFrame, *,
                       dataset_id: str | None = None, status: str | None = None,
                       pattern: str | None = None, limit: int = 50,
                       offset: int = 0) -> DataFrame:
    """Newest investigations with data set and pattern from the payload and alert counts.

    ``investigations``: investigation_id, created_at, status, payload (JSON text).
    """
    counts = alerts.groupBy("investigation_id").agg(F.count("*").alias("alert_count"))
    rows = _payload_fields(investigations)
    if dataset_id is not None:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if pattern is not None:
        rows = rows.where(F.lower("pattern_type") == pattern.lower())
    return (rows.join(counts, "investigation_id", "left")
                .withColumn("alert_count", F.coalesce("alert_count", F.lit(0)))
                .orderBy(F.desc("created_at"), "investigation_id").offset(offset).limit(limit))


def _payload_fields(investigations: DataFrame) -> DataFrame:
    paths = {"dataset_id": "$.dataset_id", "dataset_name": "$.dataset_name",
             "pattern_type": "$.intent.pattern_type"}
    return investigations.withColumns({name: F.get_json_object("payload", path) for name, path in paths.items()})


def investigation_detail(investigations: DataFrame, alerts: DataFrame, investigation_id: str) -> DataFrame:
    """One investigation with its payload, what its payload and its alerts say, or no row.

    ``disposition`` and the counts come from the alerts as they are now; ``flagged_count`` are the entities
    that the payload lists (``flagged_entities``), and its alerts where it lists none. Its alerts themselves are
    the rows of the alert table with its id, as many as there are.
    """
    one = F.col("investigation_id") == investigation_id
    own = alerts.where(one)
    facts = investigation_rollup(own).select("investigation_id", "disposition").join(
        own.groupBy("investigation_id").agg(
            F.count("*").alias("alert_count"), F.count_if(F.col("risk_label") == "high").alias("high_risk_count"),
            F.count_if(F.col("status") != "closed").alias("open_alert_count")), "investigation_id")
    listed = F.json_array_length(F.get_json_object("payload", "$.flagged_entities")).cast("long")
    rows = _payload_fields(investigations.where(one).drop("disposition")).join(facts, "investigation_id", "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("alert_count", "high_risk_count", "open_alert_count")}
    return rows.withColumns(counts | {
        "disposition": F.coalesce("disposition", F.lit("pending")),
        "flagged_count": F.coalesce(listed, "alert_count", F.lit(0))})


def status_summary(investigations: DataFrame, alerts: DataFrame) -> DataFrame:
    """Investigations per status with their alerts and high-risk entities, in one row."""
    per = alerts.groupBy("investigation_id").agg(
        F.count("*").alias("alerts"), F.count_if(F.col("risk_label") == "high").alias("high"))
    return investigations.join(per, "investigation_id", "left").agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("in_review", "escalated", "closed")],
        F.coalesce(F.sum("high"), F.lit(0)).alias("high_risk_entities"),
        F.coalesce(F.sum("alerts"), F.lit(0)).alias("alerts"))


def workload(registry: DataFrame, alerts: DataFrame) -> DataFrame:
    """Data sets per type, governed rows and positives beside the queue counts."""
    kinds = ("primary", "knowledge", "kyc")
    sets = registry.agg(
        *[F.count_if(F.col("dataset_type") == k).alias(f"{k}_sets") for k in kinds],
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("governed_rows"),
        F.coalesce(F.sum("positives"), F.lit(0)).alias("positives"))
    queue = queue_summary(alerts)
    named = [*sets.columns, *queue.columns]
    wide = sets.unionByName(queue, allowMissingColumns=True)
    return wide.agg(*[F.max(c).alias(c) for c in named])


def audit_page(events: DataFrame, *, event_type: str | None = None, alert: str | None = None,
               limit: int = 50, offset: int = 0, total: str | None = None) -> DataFrame:
    """Newest events first. ``total`` names a column for the number of events on all pages."""
    return page(filter_events(events, event_type, alert), [F.desc("created_at"), F.desc("event_id")],
                limit=limit, offset=offset, total=total)


def filter_events(events: DataFrame, event_type: str | None = None,
                  alert: str | None = None) -> DataFrame:
    for name, value in (("event_type", event_type), ("alert_id", alert)):
        if value is not None:
            events = events.where(F.col(name) == value)
    return events
