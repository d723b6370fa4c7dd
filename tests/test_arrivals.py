import os
import shutil

import pytest
from test_sources_and_streams import HEADER, ROWS, write_csv

from tidemark.streaming import arrivals

GOOD = ["2024-01-02 10:00:00", "1", "A", "2", "B", "5", "USD", "5", "USD", "Wire", "0"]
SAML = ["Time", "Date", "Sender_account", "Receiver_account", "Amount", "Is_laundering", "Laundering_type"]
PLAIN = ["timestamp", "from_account", "to_account", "amount", "extra"]


@pytest.fixture()
def box(tmp_path):
    (tmp_path / "box").mkdir()
    return tmp_path / "box"


def run(spark, box, check="check", **options):
    target = str(box.parent / "out")
    arrivals.ingest_files(spark, str(box), target, str(box.parent / check),
                          **{"min_rows": 1, **options}).awaitTermination()
    found = {}
    for r in arrivals.receipts(spark, target).collect():
        found.setdefault(os.path.basename(r.path), []).append(r)
    return target, found


def good(n, amount="5"):
    return [[*GOOD[:2], f"A{i}", *GOOD[3:7], amount, *GOOD[8:]] for i in range(n)]


def test_every_outcome(spark, box):
    write_csv(box / "a.csv", HEADER, ROWS + good(3))
    write_csv(box / "b [1].csv", PLAIN, [["2024-01-01", "x", "y", "7.5", "?"], ["", "x", "y", "1", ""]])
    write_csv(box / "c.csv", ["what", "is", "this"], [["1", "2", "3"]])
    write_csv(box / "d.csv", HEADER, [])
    (box / "e.csv").write_text("\n")
    write_csv(box / "f.csv", HEADER, good(40))
    target, got = run(spark, box, max_bytes=1500)
    assert {n: [r.status for r in rs] for n, rs in got.items()} == {
        "a.csv": ["loaded"], "b [1].csv": ["loaded"], "c.csv": ["invalid"], "d.csv": ["invalid"],
        "e.csv": ["invalid"], "f.csv": ["invalid"]}
    a, = got["a.csv"]
    assert (a.row_count, a.bad_rows, a.layout, a.same_as, a.batch) == (4, 2, "ibm_aml", None, 0)
    assert got["b [1].csv"][0].layout == "generic_transactions"
    assert "Missing required mappings" in got["c.csv"][0].reason and "header" in got["e.csv"][0].reason
    assert "at least 1" in got["d.csv"][0].reason and "bytes" in got["f.csv"][0].reason
    rows = arrivals.accepted(spark, target)
    assert rows.count() == 5 and rows.where("receipt_id = '" + a.receipt_id + "'").count() == 4
    assert arrivals.quarantined(spark, target).count() == 3


def test_strict_refuses_files_with_bad_rows(spark, box):
    write_csv(box / "a.csv", HEADER, ROWS + good(3))
    write_csv(box / "b.csv", HEADER, good(2))
    target, got = run(spark, box, strict=True)
    assert got["a.csv"][0].status == "invalid" and "2 rows fail" in got["a.csv"][0].reason
    assert arrivals.accepted(spark, target).count() == 2 and arrivals.quarantined(spark, target).isEmpty()


def test_files_load_once_and_copies_count_once(spark, box):
    write_csv(box / "a.csv", HEADER, good(3))
    seen = []
    target, got = run(spark, box, then=lambda rows, receipt: seen.append((receipt, rows.count())))
    assert seen == [(got["a.csv"][0].receipt_id, 3)]
    shutil.copy2(box / "a.csv", box / "z.csv")
    write_csv(box / "b.csv", HEADER, good(2))
    target, got = run(spark, box, then=lambda rows, receipt: seen.append((receipt, rows.count())))
    assert (got["z.csv"][0].status, got["z.csv"][0].same_as) == ("copy", got["a.csv"][0].receipt_id)
    assert arrivals.accepted(spark, target).count() == 5 and [n for _, n in seen] == [3, 2]
    # A lost checkpoint lists all files again, which the ledger knows.
    target, got = run(spark, box, check="other", then=lambda rows, receipt: seen.append((receipt, 0)))
    assert arrivals.accepted(spark, target).count() == 5 and all(len(rs) == 1 for rs in got.values())


def test_a_batch_run_again_ends_the_same(spark, box):
    write_csv(box / "a.csv", HEADER, good(3))
    write_csv(box / "b.csv", HEADER, good(2))

    def fail(rows, receipt):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        run(spark, box, then=fail)
    seen = []
    target, got = run(spark, box, then=lambda rows, receipt: seen.append(rows.count()))
    assert sorted(seen) == [2, 3] and arrivals.accepted(spark, target).count() == 5
    assert [len(rs) for rs in got.values()] == [1, 1]


def test_a_file_that_changes_while_it_loads(spark, box, monkeypatch):
    write_csv(box / "a.csv", HEADER, good(3))
    real, calls = arrivals._load_file, []

    def load(session, version, *args, **kwargs):
        done = real(session, version, *args, **kwargs)
        if not calls:
            write_csv(box / "a.csv", HEADER, good(7))
        calls.append(version["bytes"])
        return done

    monkeypatch.setattr(arrivals, "_load_file", load)
    target, got = run(spark, box)
    assert sorted((r.status, r.row_count) for r in got["a.csv"]) == [("loaded", 7), ("superseded", 3)]
    assert arrivals.accepted(spark, target).count() == 7 and len(calls) == 2


def test_a_newer_version_replaces_the_older(spark, box):
    write_csv(box / "a.csv", HEADER, good(3))
    shutil.copy2(box / "a.csv", box / "b.csv")
    run(spark, box)
    write_csv(box / "a.csv", HEADER, good(4, "6"))
    target, got = run(spark, box, check="other")
    assert sorted((r.status, r.row_count) for r in got["a.csv"]) == [("loaded", 4), ("superseded", 3)]
    # The copy's original is gone, so the copy counts.
    assert arrivals.accepted(spark, target).count() == 7
