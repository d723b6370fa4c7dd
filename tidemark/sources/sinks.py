"""Writers: entity, evidence and audit exports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def guard_formulas(df: DataFrame) -> DataFrame:
    """Prefix a quote to text a spreadsheet would run as a formula."""
    fields = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.col(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), F.col(c)))
                               .otherwise(F.col(c)) for c in fields})


def flat_columns(df: DataFrame) -> DataFrame:
    """Lists of text joined with '|', other nested values as JSON."""
    out = {}
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            out[f.name] = F.array_join(f.name, "|")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            out[f.name] = F.to_json(f.name)
    return df.withColumns(out) if out else df


def export_csv(df: DataFrame, path: str) -> None:
    """Flat, guarded CSV parts, each with a header."""
    (guard_formulas(flat_columns(df)).write.mode("overwrite")
     .option("header", True).option("escape", '"').csv(path))


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# --- fixed values: columns of the entity and audit exports ----------------------------
ENTITY_FIELDS = ["entity_id", "risk_score", "risk_label", "escalation_action",
                 "saml_d_typology", "txn_count", "total_amount", "explanation", "citation"]
AUDIT_FIELDS = ["event_id", "event_type", "actor", "investigation_id", "alert_id", "payload",
                "risk_policy_version", "model_version", "dataset_snapshot", "created_at"]
# --- end of fixed values --------------------------------------------------------------


def entity_export(entities: DataFrame, *, full: bool = False) -> DataFrame:
    """Export columns of flagged entities: the nine fixed ones, or everything flattened."""
    named = entities.withColumnRenamed("typology_label", "saml_d_typology")
    if not full:
        return named.select(*ENTITY_FIELDS)
    window = F.concat_ws("|", *[F.date_format(f"observation_window.{side}", "yyyy-MM-dd'T'HH:mm:ss")
                                for side in ("start", "end")])
    return flat_columns(named.withColumn("observation_window", window))


def export_entities(entities: DataFrame, path: str, *, full: bool = False) -> None:
    export_csv(entity_export(entities, full=full), path)


def export_audit(events: DataFrame, path: str, start: date | None = None,
                 end: date | None = None) -> None:
    """Audit rows created in the closed date range."""
    day = F.to_date("created_at")
    if start:
        events = events.where(day >= F.lit(start))
    if end:
        events = events.where(day <= F.lit(end))
    export_csv(events.select(*AUDIT_FIELDS), path)
