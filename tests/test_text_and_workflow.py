import math
import re
from collections import Counter
from datetime import datetime, timedelta

import pytest
from conftest import by_id
from pyspark.sql import functions as F

from tidemark.functions.text import all_numbers_known, numbers, paragraphs
from tidemark.operators import evidence, features, retrieval, risk, rules, stats, workflow
from tidemark.plans import catalogue
from tidemark.plans.investigate import InvestigationSpec, investigate

DOCS = [("g-split", "Splitting deposits", "https://example.org/split", ["structuring"],
         "A limit that is never reached but nearly so, day after day, is one that somebody avoids"),
        ("g-chain", "Chains of accounts", "https://example.org/chain", ["layering"],
         "Money which passes quickly from one hand to the next hides where it came from"),
        ("g-peer", "Comparing peers", "https://example.org/peer", ["single_large"],
         "Only what others of its kind never do makes an account unusual")]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame(DOCS, "doc_id string, title string, source string, "
                                       "typologies array<string>, text string")


def test_idf_search_and_grounding(spark, corpus):
    q = spark.createDataFrame([(1, "avoids a limit", "structuring"), (2, "zebra quantum", None),
                               (3, "Peers?", None)], "query_id int, text string, typology string")
    best = retrieval.idf_search(corpus, q).where("position = 1").orderBy("query_id").collect()
    assert [(r.query_id, r.doc_id) for r in best] == [(1, "g-split"), (3, "g-peer")]
    assert 0 < best[0].score <= 1
    rows = by_id(retrieval.grounding_context(corpus, q), "query_id")
    assert rows[1].supported and rows[1].citations[0] == "https://example.org/split"
    assert rows[1].summary.startswith("Retrieved context for structuring from Splitting deposits")
    assert not rows[2].supported and rows[2].citations == []
    with pytest.raises(ValueError):
        retrieval.idf_search(corpus, q, 11)


def toks(s):
    return re.findall("[a-z0-9]+", s.lower())


def test_bm25_equals_its_formula(spark):
    texts = ["the cat sat on the mat", "the dog", "cat and dog and cat", "the the the", "", "a b c the cat"]
    docs = [toks(t) for t in texts]
    query = "cat the cat dog"
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    idf = {t: math.log(n - f + .5) - math.log(f + .5) for t, f in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {t: (.25 * mean if v < 0 else v) for t, v in idf.items()}
    want = {}
    for i, d in enumerate(docs):
        c = Counter(d)
        s = sum(idf.get(t, 0) * c[t] * 2.5 / (c[t] + 1.5 * (.25 + .75 * len(d) / avg)) for t in toks(query))
        if s > 0:
            want[i] = round(s, 4)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    q = spark.createDataFrame([(1, query)], "query_id int, text string")
    got = {r.doc_id: r.score for r in retrieval.bm25_search(d, q, 10).collect()}
    assert got == pytest.approx(want, abs=1e-4)


def test_paragraphs(spark):
    df = spark.createDataFrame([(1, " one\n\n\n two \n\n   \n\nthree\nfour")], "doc_id int, text string")
    assert df.select(paragraphs(F.col("text"))).first()[0] == ["one", "two", "three\nfour"]


NUMBER = re.compile(r"(?<![\w])\$?-?\d[\d,]*(?:\.\d+)?(?![\w])")
TEXTS = ["paid $1,234.50 and -7 times", "v12 and 12v and 3.5x", "1.2.3 and 4,", "é5 5é 6", "none", "0.001 2", "x=9;(8)"]


def test_numbers_equal_python_regex(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = {r.id: r.n for r in df.select("id", numbers(F.col("text")).alias("n")).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i] == [float(x.replace("$", "").replace(",", "")) for x in NUMBER.findall(t)], t


def test_number_audit_finds_what_a_record_does_not_hold(spark):
    rows = [("a", 0.45, 1200, "score 0.4500 of 1,200.", "about $1,320.10 and 1,200"), ("b", 0.5, 3, None, "no number, B2 is none"),
            ("c", 12_000.0, 0, "12,001 is near enough, -5 is not", "")]
    df = spark.createDataFrame(rows, "id string, score double, n int, one string, two string")
    values = F.array("score", F.col("n").cast("double"))
    got = {(r.id, r.part): (r.number_count, r.unknown_count, r.grounded)
           for r in evidence.audit_numbers(df, "id", ["one", "two"], values).collect()}
    assert got == {("a", "one"): (2, 0, True), ("a", "two"): (2, 1, False), ("b", "two"): (0, 0, True),
                   ("c", "one"): (2, 1, False), ("c", "two"): (0, 0, True)}


def test_grounded_numbers(spark):
    df = spark.createDataFrame([(1, "score 0.7001 of 10000.5"), (2, "score 0.71"), (3, "no number")],
                               "id int, text string")
    allowed = F.array(F.lit(.7), F.lit(10000.0))
    got = {r.id: r.ok for r in df.select("id", all_numbers_known(F.col("text"), allowed).alias("ok")).collect()}
    assert got == {1: True, 2: False, 3: True}


# ---- evidence ------------------------------------------------------------------------

@pytest.fixture(scope="module")
def scored(ledger9):
    df = rules.apply_rules(features.features_for(ledger9, None, row_key="txn_id"), ["structuring"])
    return risk.recommend(risk.score_risk(stats.add_statistics(df, (-1e9, 1e9)))).persist()


def test_best_row_and_top_evidence(scored):
    best = by_id(evidence.best_rows(scored, "txn_id", None), "from_account")
    for r in scored.collect():
        assert r.risk_score <= best[r.from_account].risk_score
    assert [r.txn_id for r in evidence.top_evidence(scored, "txn_id", 2)
            .where("from_account = 'A'").orderBy("position").collect()] == [2, 1]


def test_typology_resolution(spark):
    df = spark.createDataFrame(
        [(1, ["high_risk_country", "fan_in", "smurfing"], False, .1, .0), (2, [], True, .9, .0),
         (3, [], False, .2, .9), (4, ["high_risk_country"], False, .0, .4), (5, [], False, .0, .0)],
        "id int, rule_flags array<string>, iqr_flag boolean, stat_score double, ml_score double")
    got = {k: v.typology for k, v in by_id(evidence.resolve_typology(df), "id").items()}
    assert got == {1: "fan_in", 2: "behavioural_change_2", 3: "behavioural_change_1", 4: "gather_scatter", 5: ""}
    named = by_id(evidence.resolve_typology(df, "layering"), "id")
    assert named[2].typology_label == "Layered_Fan_In" and named[1].typology == "fan_in"
    none = by_id(evidence.resolve_typology(df), "id")[5]
    assert (none.typology_name, none.reg_ref) == ("Unclassified AML anomaly", "Internal AML monitoring policy")


def test_entities_narrative_and_package(scored):
    out = evidence.flagged_entities(scored, "txn_id", "structuring", limit=None)
    top = by_id(out, "entity_id")
    row = top["A"]
    assert (row.txn_count, row.total_amount, row.distinct_counterparties) == (3, 27_300.0, 3)
    assert [x.txn_id for x in row.top_transactions] == ["2", "1", "0"]
    assert row.explanation.startswith("Entity A received a composite risk score of ")
    told = by_id(evidence.narrate(out), "entity_id")["A"]
    assert told.evidence_points[0] == "Observed 3 transactions totalling $27,300.00."
    assert told.evidence_points[1] == ("Activity occurred from 2022-09-01T09:00:00 through 2022-09-03T09:00:00.")
    assert told.limitations == [] and told.explanation.endswith("not a conclusion of illicit activity.")
    parts = evidence.package_findings(out, "INV-1")
    assert parts["findings"].count() == len(top) and parts["warnings"].count() == 0
    again = evidence.package_findings(out.repartition(3), "INV-1")
    assert parts["checksum"].first() == again["checksum"].first()
    changed = evidence.package_findings(out.withColumn("total_amount", F.col("total_amount") + 1), "INV-1")
    assert parts["checksum"].first() != changed["checksum"].first()
    bare = out.withColumn("citation", F.lit("")).withColumn(
        "entity_id", F.when(F.col("entity_id") != "A", F.col("entity_id")))
    found = evidence.package_findings(bare, "INV-1")
    assert "A finding without an entity ID was omitted." in [r.warning for r in found["warnings"].collect()]
    assert found["findings"].count() == len(top) - 1
    with pytest.raises(ValueError):
        evidence.package_findings(out, " ")


def test_flag_summary(scored):
    row = evidence.flag_summary(scored).first()
    best = evidence.best_rows(scored, "txn_id").collect()
    assert (row.total_analyzed, row.flagged) == (9, len(best))
    assert row.high_risk == sum(r.risk_label == "high" for r in best)


@pytest.mark.parametrize("kind,pattern", [("pattern_search", "structuring"), ("broad_eda", None),
                                          ("pattern_search", "cycle"), ("aggregation", None)])
def test_investigations_run(ledger9, kind, pattern):
    df = ledger9.withColumn("txn_date", F.to_date("timestamp")).withColumn("is_laundering", F.lit(0))
    out = investigate(df, InvestigationSpec(kind, pattern))
    if kind == "aggregation":
        assert out["groups"].count() == 7
        return
    assert out["summary"].first().total_analyzed == 9
    assert ("graph_cycles" in out) == (pattern == "cycle")
    assert ("eda_summary" in out) == (kind == "broad_eda")
    if pattern == "structuring":
        assert "A" in [r.entity_id for r in out["entities"].collect()]


def test_bad_investigations():
    with pytest.raises(ValueError):
        InvestigationSpec("guess")
    with pytest.raises(ValueError):
        InvestigationSpec("entity_lookup")


# ---- workflow ------------------------------------------------------------------------

T0 = datetime(2024, 1, 1, 8)


@pytest.fixture(scope="module")
def alerts(spark):
    found = spark.createDataFrame([("E1", .9, "high", "report"), ("E2", .5, "medium", "flag_for_review"),
                                   ("E3", .36, "medium", "monitor")],
                                  "entity_id string, risk_score double, risk_label string, escalation_action string")
    return workflow.alerts_from_findings(found, "INV-1", T0)


def log(spark, alerts, rows):
    ids = {r.entity_id: r.alert_id for r in alerts.collect()}
    return spark.createDataFrame(
        [(ids[e], i, a, "ana", v, T0 + timedelta(hours=i)) for i, (e, a, v) in enumerate(rows, 1)],
        "alert_id string, seq long, action string, actor string, value string, at timestamp")


def test_new_alerts(alerts):
    rows = by_id(alerts, "entity_id")
    assert [rows[e].sla_hours for e in ("E1", "E2", "E3")] == [4, 24, 72]
    assert rows["E1"].status == "new" and rows["E1"].disposition == "pending"
    assert rows["E1"].alert_id.startswith("ALT-")


def test_actions_fold(spark, alerts):
    acts = log(spark, alerts, [("E1", "assign", "kim"), ("E1", "disposition", "false_positive"),
                               ("E2", "disposition", "escalated"), ("E2", "assign", "lee"),
                               ("E1", "note", "first"), ("E1", "note", "second")])
    plain = by_id(workflow.fold_actions(alerts, acts), "entity_id")
    assert (plain["E1"].status, plain["E1"].assigned_to, plain["E1"].note_count) == ("closed", "kim", 2)
    assert plain["E1"].last_note == "[2024-01-01T14:00:00] ana: second"
    assert plain["E2"].status == "in_review" and plain["E3"].status == "new"
    governed = by_id(workflow.fold_actions(alerts, acts, governed=True), "entity_id")
    assert governed["E2"].status == "escalated"
    text = workflow.notes_page(acts, plain["E1"].alert_id).first().notes
    assert text == "[2024-01-01T13:00:00] ana: first\n[2024-01-01T14:00:00] ana: second"
    rolled = workflow.investigation_rollup(workflow.fold_actions(alerts, acts)).first()
    assert (rolled.status, rolled.disposition, rolled.alert_count) == ("in_review", "pending", 3)


@pytest.mark.parametrize("rows,status,disposition", [
    ([("E1", "disposition", "sar_filed")], "escalated", "escalated"),
    ([(e, "disposition", "false_positive") for e in ("E1", "E2", "E3")], "closed", "false_positive"),
    ([("E1", "disposition", "true_positive"), ("E2", "disposition", "false_positive"),
      ("E3", "disposition", "false_positive")], "closed", "true_positive")])
def test_rollup(spark, alerts, rows, status, disposition):
    row = workflow.investigation_rollup(workflow.fold_actions(alerts, log(spark, alerts, rows))).first()
    assert (row.status, row.disposition) == (status, disposition)


def test_queue_views(spark, alerts):
    acts = log(spark, alerts, [("E3", "disposition", "escalated"), ("E1", "assign", "kim")])
    now = workflow.fold_actions(alerts, acts)
    assert [r.entity_id for r in workflow.rank_queue(now).collect()] == ["E3", "E2", "E1"]
    assert [r.entity_id for r in workflow.rank_queue(now, status="new").collect()] == ["E2"]
    assert [r.entity_id for r in workflow.governed_queue(now, assigned_to="kim").collect()] == ["E1"]
    aged = by_id(workflow.queue_view(now, T0 + timedelta(hours=5)), "entity_id")
    assert aged["E1"].age_hours == 5.0 and aged["E1"].sla_breached and not aged["E2"].sla_breached
    row = workflow.queue_summary(now).first()
    assert (row.total, row.new, row.in_review, row.escalated, row.closed) == (3, 1, 1, 1, 0)


def test_audit(spark, alerts):
    acts = log(spark, alerts, [("E1", "assign", "kim"), ("E1", "note", "hello")])
    events = workflow.audit_events(alerts, acts, policy_version="p1")
    kinds = Counter(r.event_type for r in events.collect())
    assert kinds == {"alert_created": 3, "investigation_completed": 1, "alert_assigned": 1, "analyst_note_added": 1}
    newest = workflow.audit_page(events, limit=1).first()
    assert newest.event_type == "analyst_note_added" and newest.payload == '{"note":"hello"}'
    governed = workflow.audit_events(alerts, acts, policy_version="p1", governed=True)
    assert workflow.audit_page(governed, limit=1).first().payload == '{"note_length":5}'
    assert events.select("event_id").distinct().count() == 6


def test_shared_frames_are_checkpointed_where_the_cluster_says_so(spark):
    from tidemark.plans.investigate import shared
    from tidemark.session import checkpoint_dir

    assert checkpoint_dir(spark)
    df = shared(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Scan ExistingRDD" in df._jdf.queryExecution().executedPlan().toString()
    assert df.agg(F.sum("x")).first()[0] == 90


def test_investigation_filters_read_the_payload_of_investigations(spark, tmp_path):
    rows = [(i, T0 + timedelta(hours=i), 1 if i % 2 else 2, "view", 10_000.0 if i == 9 else 10.0, '{"k": 50}')
            for i in range(1, 20)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, "
                                "props string").write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.QUERIES["investigation_list"](spark, str(tmp_path))
    assert "StructsToJson" not in found._jdf.queryExecution().optimizedPlan().toString()  # else run for every transfer
    assert [(r.investigation_id, r.alert_count, r.created_at) for r in found.collect()] == [
        ("INV-1", 1, T0 + timedelta(hours=1))]


def test_investigation_detail(spark):
    rows = [("I1", datetime(2024, 1, 1), "in_review", '{"dataset_id":"d","flagged_entities":[{"a":1},{"a":2},{"a":3}]}'),
            ("I2", datetime(2024, 1, 2), "closed", None), ("I3", None, None, "not json")]
    investigations = spark.createDataFrame(rows, "investigation_id string, created_at timestamp, status string, payload string")
    alerts = spark.createDataFrame([("I1", "high", "new", "pending"), ("I1", "low", "closed", "true_positive"), ("I3", None, None, None)],
                                   "investigation_id string, risk_label string, status string, disposition string")

    def detail(i):
        return [(r.dataset_id, r.disposition, r.flagged_count, r.alert_count, r.high_risk_count, r.open_alert_count)
                for r in workflow.investigation_detail(investigations, alerts, i).collect()]

    assert detail("I1") == [("d", "pending", 3, 2, 1, 1)]
    assert detail("I2") == [(None, "pending", 0, 0, 0, 0)]
    assert detail("I3") == [(None, "pending", 1, 1, 0, 0)]
    assert detail("none") == []


@pytest.mark.parametrize("vocabulary", [0, 1_000])
def test_search_in_blocks_equals_its_formulas(spark, monkeypatch, vocabulary):
    """Several blocks of documents and queries, a document and a query that come twice, ties."""
    import random
    monkeypatch.setattr(retrieval, "DOCUMENTS", 5)
    monkeypatch.setattr(retrieval, "QUERIES", 2)
    monkeypatch.setattr(retrieval, "VOCABULARY", vocabulary)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9))), [rng.choice(["fr", "de"])]) for i in range(24)]
    docs += [docs[3], (99, "", None)]
    asked = [(i, " ".join(rng.choices(words, k=4)), rng.choice(["FR", "de", None])) for i in range(7)] + [(50, "zebra", None)]
    asked += [asked[2]]
    d = spark.createDataFrame(docs, "doc_id long, text string, typologies array<string>")
    q = spark.createDataFrame(asked, "query_id long, text string, typology string")

    body = [(i, set(toks(f"{' '.join(tags or [])} {text}")), tags or []) for i, text, tags in docs]
    df = Counter(t for _, ts, _ in body for t in ts)
    want = {}
    for i, text, kind in asked:
        own = set(toks(f"{text} {kind or ''}"))
        times = sum(a[0] == i for a in asked) ** 2
        for doc in {x[0] for x in body}:
            same = [x for x in body if x[0] == doc]
            raw = times * sum(math.log((len(docs) + 1) / (df[t] + 1)) + 1 for _, ts, _ in same for t in own & ts)
            raw += 2.5 * any(kind and kind.lower() in tags for _, _, tags in same)
            if raw > 0:
                want.setdefault(i, []).append((-round(min(1.0, raw / (len(own) + 2.5)), 6), doc))
    got = {}
    for r in retrieval.idf_search(d, q, 2).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    assert got == {i: sorted(rows)[:2] for i, rows in want.items()}

    n, average = len(docs), sum(len(toks(x[1])) for x in docs) / len(docs)
    df = Counter(t for x in docs for t in set(toks(x[1])))
    idf = {t: math.log(n - f + .5) - math.log(f + .5) for t, f in df.items()}
    low = .25 * sum(idf.values()) / len(idf)
    want = {}
    for i in {x[0] for x in asked}:
        query = [t for x in asked if x[0] == i for t in toks(x[1])]
        for doc in {x[0] for x in docs}:
            same = [toks(x[1]) for x in docs if x[0] == doc]
            tf, size = Counter(t for ts in same for t in ts), len(same[0])
            score = sum((low if idf[t] < 0 else idf[t]) * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * size / average))
                        for t in query if t in tf)
            if score > 0:
                want.setdefault(i, []).append((-round(score, 4), doc))
    got = {}
    for r in retrieval.bm25_search(d, q.drop("typology"), 3).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((-r.score, r.doc_id))
    assert got == {i: sorted(rows)[:3] for i, rows in want.items()}
