"""Sessions, feedback, hooks, and reports that go into a knowledge base."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from quarry.operators import hooks, kb_ingest, sessions
from quarry.sources import versions


def log(spark, *rows):
    """(name, at, kind) and what a record holds."""
    full = [(n, at, kind, "d", f"q{at}", "r.md", more.get("ms"), more.get("claims"), more.get("gaps"), more.get("cites"), more.get("text"), more.get("n"), more.get("agg")) for n, at, kind, *rest in rows for more in [rest[0] if rest else {}]]
    return spark.createDataFrame(full, sessions.COMMANDS)


def test_guarded_transitions(spark):
    kinds = ["record", "create", "create", "record", "reopen", "close", "close", "record", "reopen", "record", "delete", "record", "delete", "reopen", "create", "record", "close", "odd", None]
    done = sessions.judged(log(spark, *[("s", i, k) for i, k in enumerate(kinds)])).orderBy("at").collect()
    assert [r["error"] for r in done] == [
        "not found", None, "already exists", None, "already open", None, "already closed", "closed; reopen it first", None, None, None, "not found", "not found", "not found", None, None, None, "unknown command", "unknown command",
    ]


def test_sessions_records_and_cascade(spark):
    done = sessions.judged(log(
        spark, ("a", 1, "create"), ("a", 2, "record", {"gaps": ["g", "g", "h"], "cites": ["(Pp1:S1)", "(SNAP:x:S2)", "(Pp1:S1)"], "claims": ["c1"], "ms": 10.0, "n": 3, "text": "x" * 600, "agg": True}), ("a", 3, "close"), ("a", 4, "reopen"),
        ("a", 5, "record", {"gaps": ["i", "g"], "claims": ["c2", "c1"], "cites": ["(Pp0:S9)"]}), ("a", 6, "close"), ("b", 1, "create"), ("b", 2, "record"), ("b", 3, "delete"), ("c", 1, "create"), ("c", 2, "record"), ("c", 3, "delete"), ("c", 4, "create"),
    ))
    assert [(r["name"], r["status"], r["created_at"], r["closed_at"], r["query_count"]) for r in sessions.listed(done).collect()] == [("c", "open", 4, None, 0), ("a", "closed", 1, 6, 2)]
    assert [r["name"] for r in sessions.listed(done, "closed").collect()] == ["a"]
    assert sorted((r["name"], r["at"], len(r["synthesis_preview"])) for r in sessions.records(done).collect()) == [("a", 2, 500), ("a", 5, 0)]
    a, c = sessions.summary(done).orderBy("name").collect()
    assert (a["query_count"], a["total_evidence"], a["total_citations"], a["aggregation_used"], a["avg_elapsed_ms"]) == (2, 3, 4, 1, 10.0)
    assert (a["papers"], a["gaps"], a["recurring_gaps"], a["key_claims"]) == (["SNAP:x", "p0", "p1"], ["g", "g", "h", "i", "g"], ["g"], ["c1", "c2", "c1"])
    assert (c["query_count"], c["avg_elapsed_ms"], c["papers"]) == (0, None, [])
    again = sessions.judged(sessions.carried(done).union(log(spark, ("a", 10, "record"), ("c", 10, "record"), ("b", 10, "record"))))
    assert sorted((r["name"], r["error"]) for r in again.where("at = 10").collect()) == [("a", "closed; reopen it first"), ("b", "not found"), ("c", None)]
    assert sessions.records(again).count() == 3 and sessions.listed(done.where("false")).count() == 0


def test_feedback(spark):
    rows = spark.createDataFrame([("s", "user_upvote", None), ("s", "liked", 1.0), (" ", "user_upvote", 1.0), (None, None, 1.0), ("t", None, 2.0)], "source_name string, event_type string, value double")
    told = sessions.feedback(rows)
    assert [(r["accepted"], r["reason"], r["value"]) for r in told.collect()] == [(True, None, 1.0), (False, "unknown event_type", 1.0), (False, "source missing", 1.0), (False, "source missing", 1.0), (False, "unknown event_type", 2.0)]
    known = spark.createDataFrame([("old", 0.9)], "source_name string, score double")
    assert sorted(tuple(r) for r in sessions.known_sources(known, told).collect()) == [("old", 0.9), ("s", 0.5)]


def test_hooks(spark):
    def slow(run):
        time.sleep(30)

    allowed = {"fine": lambda run: [{"fired": run["metric"] > 1, "observed": {"m": run["metric"]}}], "slow": slow, "none": lambda run: None, "bad": lambda run: [{"severity": "x"}, 3], "empty": lambda run: [], "fails": lambda run: 1 / 0}
    runs = spark.createDataFrame([("t", "r1", 0.5), ("t", "r2", 2.0)], "topic string, run_id string, metric double")
    began = time.time()
    found = hooks.decisions(runs, allowed, ["fine", "slow", "none", "bad", "empty", "fails", "secret"], seconds=0.3).collect()
    assert time.time() - began < 25
    one = [(r["hook"], r["trigger_id"], r["severity"], r["fired"], r["observed"], r["error"]) for r in found if r["run_id"] == "r2"]
    none = (None,) * 4
    assert one == [("fine", "custom_hook_trigger", "low", True, '{"m": 2.0}', None), ("slow", *none, "timeout"), ("none", *none, "output must be a list"), ("bad", *none, "invalid severity 'x'"), ("bad", *none, "decision must be a dict"), ("fails", *none, "failed: division by zero"), ("secret", *none, "hook not allowed")]


REPORT = "# T\n- no claim (Px:S1)\n## Key  Claims \n- Models improve at 5.0 fps. (Px:S1) (Px:S1)\n* Never without cost;(SNAP:n:S2)\nplain line\n-  (Px:S1)\n- no citation here\n### Deeper\n  - Nested bullet (Py:S3):\n## Next\n- not this (Px:S1)"


def test_key_claims(spark):
    told = spark.createDataFrame([(REPORT,), (None,), ("## key claims",), ("text\n- a (Px:S1)",)], "m string").select(kb_ingest.key_claims(F.col("m")).alias("c")).collect()
    assert [[(c["claim"], c["citations"]) for c in r["c"]] for r in told] == [
        [("Models improve at 5.0 fps", ["(Px:S1)"]), ("Never without cost", ["(SNAP:n:S2)"]), ("no citation here", []), ("Nested bullet", ["(Py:S3)"])], [], [], [],
    ]


def packs(spark, *rows):
    schema = "id string, topic string, markdown string, text string, listed array<string>, experiments array<struct<proposal:string,citations:array<string>>>, direct boolean, coverage double"
    return spark.createDataFrame([(i, t, "## Key Claims\n" + "\n".join(f"- {c} (Px:S1)" for c in claims), more.get("text", "Not found in sources."), more.get("listed", []), more.get("exp", []), False, more.get("cov", 1.0)) for i, t, claims, *rest in rows for more in [rest[0] if rest else {}]], schema)


def evidence(spark, *ids):
    return spark.createDataFrame([(i, "Px:S1", 1.0, "the model is fast on 5 devices") for i in ids], "id string, snippet_id string, score double, text string")


def held(spark, base):
    return {(r["topic"], r["claim"]): (r["status"], r["confidence"], r["run"]) for r in base.table(spark, "claims").collect()}


DAY = dt.datetime(2024, 3, 1)


def test_ingest_decays_confirms_disputes_and_keeps_other_topics(spark, tmp_path):
    base = kb_ingest.KnowledgeBase(f"file://{tmp_path}")
    kb_ingest.ingest(spark, base, packs(spark, ("r1", "t", ["the model is fast on devices", "old claim of little use"]), ("r2", "u", ["other topic"])), evidence(spark, "r1", "r2"), "one", DAY)
    first = 0.35 * 0.5 + 0.25 * 0.9 + 0.4
    assert held(spark, base) == {("t", "the model is fast on devices"): ("active", first, "one"), ("t", "old claim of little use"): ("active", first, "one"), ("u", "other topic"): ("active", first, "one")}
    kb_ingest.ingest(spark, base, packs(spark, ("r3", "t", ["the model is not fast on devices", "The model is fast on devices", "the model is fast on devices!"], {"cov": 0.5})), evidence(spark, "r3"), "two", DAY + dt.timedelta(days=60))
    now = held(spark, base)
    assert now[("t", "old claim of little use")] == ("stale", round(first * 0.98**60, 4), "one") and now[("u", "other topic")] == ("active", first, "one")
    assert now[("t", "the model is not fast on devices")] == now[("t", "the model is fast on devices!")] == ("disputed", round(first - 0.04, 4), "two") and len(now) == 4
    change = {r["run"]: (len(r["added"]), len(r["updated"]), len(r["disputed"])) for r in base.table(spark, "changes").where("topic = 't'").collect()}
    assert change == {"one": (2, 0, 0), "two": (1, 1, 2)}
    made = sorted((r["run"], r["at"], r["reason"]) for r in base.table(spark, "claim_versions").where("topic = 't'").collect())
    assert made == [("one", 0, "added"), ("one", 1, "added"), ("two", 0, "added"), ("two", 1, "updated"), ("two", 2, "updated")]
    assert base.table(spark, "contradictions").count() == 1 and base.table(spark, "evidence").count() == 5 and base.table(spark, "notes").count() == 3


def test_ingest_leaves_no_tables_in_between(spark, tmp_path, monkeypatch):
    """Topics of few claims are compared by a task each, with the pairs of the join by words; tables in between go."""
    from quarry.operators import knowledge
    from quarry.sources import shared

    rows = [(f"t{i % 7}", i, f"{'not ' if i % 3 == 0 else ''}word{i % 5} other{i % 4} and more{i % 2}", i % 2 == 0) for i in range(120)] + [("alone", 500 + i, "word1 other", True) for i in range(5)]
    claims = spark.createDataFrame(rows, "topic string, claim_id long, claim string, fresh boolean")
    own = sorted(map(tuple, knowledge.contradictions(claims, fresh=F.col("fresh")).collect()))
    monkeypatch.setattr(knowledge, "SMALL", 0)
    assert own and own == sorted(map(tuple, knowledge.contradictions(claims, fresh=F.col("fresh")).collect()))
    monkeypatch.setattr(kb_ingest, "written", lambda df, name="table": df.localCheckpoint())
    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}/shared")
    base = kb_ingest.KnowledgeBase(f"file://{tmp_path}/kb")
    packs = spark.createDataFrame([("a", "t", "## Key claims\n- it grows (Pa:S1)\n- it never grows (Pa:S1)", "Insufficient evidence (Pa:S1)", ["(Pa:S1)"], [], False, 1.0)], "id string, topic string, markdown string, text string, listed array<string>, experiments array<struct<proposal:string,citations:array<string>>>, direct boolean, coverage double")
    evidence = spark.createDataFrame([("a", "Pa:S1", 1.0, "it grows")], "id string, snippet_id string, score double, text string")
    kb_ingest.ingest(spark, base, packs, evidence, "r", dt.datetime(2024, 1, 1))
    assert base.table(spark, "contradictions").count() == 1
    assert [str(p) for p in (tmp_path / "shared").rglob("*.parquet")] == []


def test_ingest_refuses_and_stays_whole(spark, tmp_path, monkeypatch):
    base = kb_ingest.KnowledgeBase(f"file://{tmp_path}")
    rows = packs(spark, ("ok", "a", ["fine claim"]), ("num", "b", ["x"], {"text": "Not found in sources. 77"}), ("none", "c", []), ("cite", "d", ["y"], {"text": "line (Pz:S1)"}), ("far", "e", ["z"], {"text": "unrelated words altogether (Px:S1)", "listed": ["(Px:S1)"]}), ("exp", "f", ["w"], {"exp": [("try it", [])]}))
    bad = kb_ingest.ingest(spark, base, rows, evidence(spark, "ok", "num", "none", "cite", "far", "exp"), "one", DAY)
    assert {r["id"]: r["reasons"] for r in bad.collect()} == {"num": "number:77", "none": "no_key_claims", "cite": "not_listed,support:missing", "far": "support:low", "exp": "experiment_without"}
    before = held(spark, base)
    assert list(before) == [("a", "fine claim")]
    with pytest.raises(ValueError, match="one report a topic"):
        kb_ingest.ingest(spark, base, packs(spark, ("p", "a", ["q"]), ("q", "a", ["q"])), evidence(spark, "p"), "two", DAY)

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(kb_ingest.versions, "commit", dies)
    with pytest.raises(RuntimeError):
        kb_ingest.ingest(spark, base, packs(spark, ("p", "a", ["new claim"])), evidence(spark, "p"), "two", DAY)
    monkeypatch.undo()
    assert held(spark, base) == before and versions.latest(spark, f"{base.place}/manifest") == 1


def test_backfill_takes_the_newest_first(spark, tmp_path):
    base = kb_ingest.KnowledgeBase(f"file://{tmp_path}")
    rows = packs(spark, ("r1", "t", ["oldest"]), ("r2", "t", ["middle"]), ("r3", "t", ["newest"]), ("s1", "u", ["other"])).withColumn("modified", F.expr("CASE id WHEN 'r1' THEN 1 WHEN 'r2' THEN 2 WHEN 'r3' THEN 3 ELSE 9 END"))
    assert kb_ingest.backfill(spark, base, rows, evidence(spark, "r1", "r2", "r3", "s1"), DAY, last=2) == 2
    assert {k: v[2] for k, v in held(spark, base).items()} == {("t", "newest"): "backfill-0001", ("t", "middle"): "backfill-0002", ("u", "other"): "backfill-0001"}
