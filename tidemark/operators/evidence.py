"""Flagged entities with their evidence, typology, explanation and package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import policy as P
from tidemark.functions.columns import joined, number, rounded_text
from tidemark.functions.text import number_is_known, numbers


def best_rows(scored: DataFrame, row_key: str, floor: float | None = 0.35) -> DataFrame:
    """The highest-risk row of every account (earliest key on ties).

    The rank filter also runs before the shuffle: each map task passes on one row per
    account, however many the account has.
    """
    rows = scored if floor is None else scored.where(F.col("risk_score") >= floor)
    rank = Window.partitionBy("from_account").orderBy(F.desc("risk_score"), row_key)
    return rows.withColumn("_r", F.row_number().over(rank)).where(F.col("_r") == 1).drop("_r")


def flag_summary(scored: DataFrame) -> DataFrame:
    """One row: rows analysed, accounts flagged, accounts at high risk."""
    per_account = scored.groupBy("from_account").agg(
        F.count("*").alias("n"), F.max("risk_score").alias("top"))
    limits = P.RowRiskPolicy()
    return per_account.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_analyzed"),
        F.count_if(F.col("top") >= limits.medium).alias("flagged"),
        F.count_if(F.col("top") >= limits.high).alias("high_risk"))


def top_evidence(scored: DataFrame, row_key: str, k: int = 5) -> DataFrame:
    """The k largest transactions of every account."""
    rank = Window.partitionBy("from_account").orderBy(F.desc("_amount"), row_key)
    return (scored.withColumn("_amount", number(scored, "amount_paid"))
                  .withColumn("position", F.row_number().over(rank))
                  .where(F.col("position") <= k).withColumnRenamed("_amount", "evidence_amount"))


def typology_key(df: DataFrame, pattern: str | None = None) -> Column:
    """First mapped flag, else the searched pattern, else what the scores suggest."""
    names = F.create_map(*[F.lit(x) for pair in P.FLAG_TYPOLOGY.items() for x in pair])
    key = F.lit(None).cast("string")
    if "rule_flags" in df.columns:
        mapped = F.filter(F.transform("rule_flags", lambda f: names[f]), lambda t: t.isNotNull())
        key = F.get(mapped, F.lit(0))
    if pattern is not None:
        return F.coalesce(key, F.lit(P.PATTERN_TYPOLOGY.get(pattern, pattern)))
    rest = F.lit(None).cast("string")
    if "iqr_flag" in df.columns:
        rest = F.when(F.coalesce("iqr_flag", F.lit(False)), "behavioural_change_2")
    weak = (F.when(number(df, "stat_score") > 0, "behavioural_change_1")
             .when(number(df, "ml_score") > 0, "gather_scatter"))
    return F.coalesce(key, rest, weak)


def typology_table(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(k, *v) for k, v in P.TYPOLOGIES.items()],
        "typology string, typology_name string, typology_label string, reg_ref string")


def resolve_typology(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Add ``typology``, its name, label and reference text (28-row dimension join)."""
    keyed = df.withColumn("typology", F.coalesce(typology_key(df, pattern), F.lit("")))
    return (keyed.join(typology_table(df), "typology", "left")
                 .withColumn("typology_name", F.coalesce(
                     "typology_name", F.lit("Unclassified AML anomaly")))
                 .withColumn("typology_label", F.coalesce("typology_label", F.lit("")))
                 .withColumn("reg_ref", F.coalesce("reg_ref", F.lit(P.DEFAULT_CITATION))))


def add_explanations(df: DataFrame) -> DataFrame:
    """Template explanation, report sentence and citation of resolved rows."""
    label = F.when(F.col("typology_label") == "", P.UNCLASSIFIED_LABEL) \
             .otherwise(F.col("typology_label"))
    risk = rounded_text(F.col("risk_score"), "0.0000")
    flags = (F.when(F.size("rule_flags") > 0, F.array_join("rule_flags", ", "))
              .otherwise("none")) if "rule_flags" in df.columns else F.lit("none")
    who = F.col("from_account")
    # --- fixed values: wording of the two sentences ---
    explanation = F.concat(
        F.lit("Entity "), who, F.lit(" received a composite risk score of "), risk,
        F.lit(" from the detectors that ran. Observed rule signals were "), flags,
        F.lit("; the closest grounded SAML-D typology is "), label, F.lit("."))
    sar = F.concat(F.lit("Review entity "), who, F.lit(" for activity consistent with "), label,
                   F.lit("; the observed composite risk score is "), risk, F.lit("."))
    # --- end of fixed values ---
    return (df.withColumn("explanation", explanation).withColumn("sar_draft", sar)
              .withColumn("citation", F.col("reg_ref")))


def explained_entities(scored: DataFrame, row_key: str, pattern: str | None = None,
                       max_entities: int = 20) -> DataFrame:
    if max_entities < 1:
        raise ValueError("max_entities must be positive")
    top = (best_rows(scored, row_key)
           .orderBy(F.desc("risk_score"), row_key).limit(max_entities))
    return add_explanations(resolve_typology(top, pattern))


def flagged_entities(scored: DataFrame, row_key: str, pattern: str | None = None,
                     limit: int | None = 20) -> DataFrame:
    """One nested record per flagged account: scores, contribution, evidence, totals.

    ``scored`` is read three times; hand in a shared one (see ``plans.shared``).
    """
    top = best_rows(scored, row_key)
    if limit is not None:
        top = top.orderBy(F.desc("risk_score"), row_key).limit(limit)
    top = add_explanations(resolve_typology(top, pattern))
    keep = [c for c in ("rule_flags", "rule_score", "stat_score", "ml_score", "risk_contribution")
            if c in scored.columns]
    head = top.select("from_account", "risk_score", "risk_label", "escalation_action", *keep,
                      "typology_label", "explanation", "sar_draft", "citation")
    ids = top.select("from_account")
    rows = scored.join(ids, "from_account", "left_semi")
    totals = rows.groupBy("from_account").agg(
        F.count("*").alias("txn_count"), F.sum("amount_paid").alias("total_amount"),
        F.struct(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"))
         .alias("observation_window"),
        F.count_distinct("to_account").alias("distinct_counterparties"))
    fields = [F.col("position"), F.col(row_key).cast("string").alias("txn_id"),
              F.col("timestamp"), F.col("evidence_amount").alias("amount")]
    fields += [F.col(c) for c in ("payment_format", "to_account", "from_country", "to_country")
               if c in scored.columns]
    if "rule_flags" in scored.columns:
        fields.append(F.col("rule_flags").alias("triggered_rules"))
    listed = (top_evidence(rows, row_key).groupBy("from_account")
              .agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("top_transactions")))
    return (head.join(totals, "from_account").join(listed, "from_account")
                .withColumnRenamed("from_account", "entity_id"))


def narrate(entities: DataFrame) -> DataFrame:
    """Reviewer wording for entities: headline, explanation, points, advice, limits.

    Expects entity_id, risk_score, risk_label, escalation_action, typology_label,
    rule_flags, txn_count, total_amount, observation_window, distinct_counterparties,
    citation and top_transactions.
    """
    topic = F.translate(F.when(F.coalesce("typology_label", F.lit("")) == "", "suspicious activity")
                         .otherwise(F.col("typology_label")), "_", " ")
    flags = F.transform(F.slice("rule_flags", 1, 4), lambda f: F.lower(F.translate(f, "_", " ")))
    window = F.col("observation_window")
    # --- fixed values: wording of the points ---
    points = F.filter(F.array(
        F.when(F.col("txn_count") > 0, F.concat(
            F.lit("Observed "), F.format_number("txn_count", 0), F.lit(" transactions totalling $"),
            F.format_number("total_amount", 2), F.lit("."))),
        F.when(window.isNotNull(), F.concat(
            F.lit("Activity occurred from "), _iso(window["start"]), F.lit(" through "),
            _iso(window["end"]), F.lit("."))),
        F.when(F.col("distinct_counterparties") > 0, F.concat(
            F.lit("Activity involved "), F.format_number("distinct_counterparties", 0),
            F.lit(" distinct counterparties."))),
        F.when(F.size("rule_flags") > 0, F.concat(
            F.lit("Triggered evidence signals: "), F.array_join(flags, ", "), F.lit("."))),
    ), lambda p: p.isNotNull())
    points = F.when(F.size(points) > 0, points).otherwise(F.array(F.lit(P.NO_METRICS_TEXT)))
    text = F.concat(
        F.lit("Entity "), "entity_id", F.lit(" is classified "), "risk_label", F.lit(" risk ("),
        rounded_text(F.col("risk_score") * 100, "0"), F.lit("%) for potential "), topic,
        F.lit(". "), F.array_join("evidence_points", " "), F.lit(" " + P.INDICATOR_TEXT))
    # --- end of fixed values ---
    advice = F.lit(P.ACTION_TEXT_DEFAULT)
    for action, words in P.ACTION_TEXT.items():
        advice = F.when(F.col("escalation_action") == action, words).otherwise(advice)
    cited = F.coalesce("citation", F.lit("")) != ""
    limits = F.filter(F.array(
        F.when(F.coalesce(F.size("top_transactions"), F.lit(0)) <= 0, P.NO_ROWS_TEXT),
        F.when(~cited, P.NO_CITATION_TEXT)), lambda x: x.isNotNull())
    return (entities.withColumn("evidence_points", points).select(
        "entity_id",
        F.concat(F.initcap("risk_label"), F.lit(" risk · "), _title(topic),
                 F.lit(" indicator")).alias("headline"),
        text.alias("explanation"), "evidence_points", advice.alias("recommendation"),
        F.when(cited, F.array("citation")).otherwise(F.array().cast("array<string>"))
         .alias("citations"),
        limits.alias("limitations")))


def audit_numbers(records: DataFrame, key: str, texts: list[str], values: Column) -> DataFrame:
    """(key, part, number_count, unknown_count, grounded): do written texts only name numbers of their record?

    ``texts`` are columns of written text, ``values`` the record's own numbers as an array of doubles. A number is
    known if it lies within a ten-thousandth (0.001 at least) of one of them. One row for each text that is there.
    """
    parts = F.filter(F.array(*(F.struct(F.lit(t).alias("part"), F.col(t).alias("text")) for t in texts)),
                     lambda p: p["text"].isNotNull())
    own = records.select(F.col(key), values.alias("_values"), F.explode(parts).alias("_p"))
    found = own.select(key, "_p.part", "_values", numbers(F.col("_p.text")).alias("_numbers"))
    unknown = F.size(F.filter("_numbers", lambda n: ~number_is_known(n, F.col("_values"))))
    return found.select(key, "part", F.size("_numbers").alias("number_count"), unknown.alias("unknown_count"),
                        (unknown == 0).alias("grounded"))


def _title(text: Column) -> Column:
    """Capitalised words, also after a hyphen."""
    return F.replace(F.initcap(F.replace(text, F.lit("-"), F.lit("- "))), F.lit("- "), F.lit("-"))


def _iso(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss")


def package_findings(entities: DataFrame, investigation_id: str) -> dict[str, DataFrame]:
    """The parts of an investigation package, as tables keyed by the investigation.

    Findings without an entity id are left out with a warning. The checksum covers every
    finding's canonical JSON: sha256 per row, then sha256 over the sorted row hashes in
    buckets, so no task holds the whole package.
    """
    if not investigation_id.strip():
        raise ValueError("investigation_id cannot be blank")
    tagged = entities.withColumn("investigation_id", F.lit(investigation_id.strip()))
    named = F.trim(F.coalesce("entity_id", F.lit(""))) != ""
    kept = tagged.where(named)
    findings = kept.select(
        "investigation_id", "entity_id", "risk_score", "risk_label", "escalation_action",
        "explanation", "rule_flags", "txn_count", "total_amount",
        F.coalesce("citation", F.lit("")).alias("citation"))
    drafts = kept.where((F.trim(F.coalesce("sar_draft", F.lit(""))) != "")
                        & (F.col("risk_label") == "high")
                        & (F.col("escalation_action") == "report")).select(
        "investigation_id", "entity_id", F.col("sar_draft").alias("draft"),
        F.lit(P.SAR_DRAFT_STATUS).alias("status"))
    about = F.concat(F.col("entity_id"), F.lit(": "))
    warned = F.when(~named, F.array(F.lit("A finding without an entity ID was omitted."))).otherwise(
        F.filter(F.array(
            F.when(F.coalesce(F.size("top_transactions"), F.lit(0)) <= 0,
                   F.concat(about, F.lit(P.MISSING_EVIDENCE_TEXT))),
            F.when(F.trim(F.coalesce("citation", F.lit(""))) == "",
                   F.concat(about, F.lit(P.MISSING_CITATION_TEXT)))), lambda w: w.isNotNull()))
    warnings = tagged.select("investigation_id", F.explode(warned).alias("warning"))
    citations = (findings.where(F.trim("citation") != "")
                         .select("investigation_id", "citation").distinct())
    body = F.to_json(F.struct(*sorted(findings.columns)))
    hashed = findings.select("investigation_id", F.sha2(body, 256).alias("h"))
    per_bucket = (hashed.groupBy("investigation_id", F.substring("h", 1, 3).alias("bucket"))
                        .agg(F.count("*").alias("n"),
                             F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256)
                              .alias("bh")))
    checksum = per_bucket.groupBy("investigation_id").agg(
        F.sum("n").alias("findings"),
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("bucket", "bh"))), ""), 256)
         .alias("evidence_checksum"))
    return {"findings": findings, "sar_drafts": drafts, "warnings": warnings,
            "citations": citations, "checksum": checksum}


def joined_flags(df: DataFrame) -> DataFrame:
    return df.withColumn("rule_flags", joined(F.col("rule_flags")))
