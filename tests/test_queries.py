"""Registered queries against their SQL at the smallest scale, and operators on small frames."""

import glob
import os

import pandas as pd
import pytest

from quarry import jobs

SF = "/root/testdata/sf0.001"


def rounded(v):
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(jobs.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    found = jobs.queries()[name](spark, SF)
    wanted = con.execute(jobs.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(columns) == sorted(found.columns)
    own = sorted(repr([rounded(v) for v in row]) for row in wanted.fetchall())
    assert sorted(repr([rounded(v) for v in row]) for row in found.select(columns).collect()) == own


def test_noise_control_trace(spark):
    from quarry.operators.monitoring import noise_control

    at = pd.Timestamp("2024-01-01")
    fired = [(0, True), (60, True), (120, True), (180, True), (600, True), (660, False), (720, True)]
    rows = [("t", (at + pd.Timedelta(minutes=m)).to_pydatetime(), f) for m, f in fired]
    out = noise_control(spark.createDataFrame(rows, "topic string, at timestamp, fired boolean"), 2, 360).orderBy("at").collect()
    assert [(r["emitted"], r["suppressed_by"]) for r in out] == [(False, "hysteresis"), (True, None), (False, "hysteresis"), (False, "cooldown"), (True, None), (False, "not_fired"), (False, "hysteresis")]


def test_text_columns(spark):
    from pyspark.sql import functions as F

    from quarry.functions import text

    one = spark.createDataFrame([("  In 10.0  cases: NOT slow. ", "https://doi.org/10.1/AB/", "<p>a<script>x</script> b</p>")], "c string, d string, h string")
    row = one.select(text.canonical_claim(F.col("c")), text.normal_doi(F.col("d")), text.strip_html(F.col("h"))).first()
    assert tuple(row) == ("in 10 cases not slow", "10.1/ab", "a b")


def test_array_functions_do_not_take_places_for_arguments(spark):
    from pyspark.sql import functions as F

    from quarry.functions import text

    lines = "\n".join(f"{i}: value {i}" for i in range(30))
    assert spark.createDataFrame([(f" \n{lines}\n",)], "t string").select(text.full_lines(F.col("t"))).first()[0] == lines.split("\n")


def test_sections_and_paragraphs(spark):
    from quarry.operators import chunking

    told = "before\n1.2 Introduction\nfirst line\nsecond line.\n\nMethodology:\nit works, as we say in results.\nRESULTS\n" + "w " * 250 + "\nresults of this are long, and so no heading."
    rows = chunking.chunks(spark.createDataFrame([(1, told), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id", "chunk").collect()
    assert [(r["section"], r["n_words"]) for r in rows] == [("body", 1), ("introduction", 4), ("method", 7), ("results", 120), ("results", 120), ("results", 19)]


def test_query_plan_keeps_the_higher_boost(spark):
    from quarry.operators import expansion

    asked = spark.createDataFrame([(1, "Matting segmentation mobile mobile"), (2, ""), (3, "real-time")], "qid long, question string")
    found = {(r["qid"], r["term"]): r["boost"] for r in expansion.plan(asked).collect()}
    assert found[1, "segmentation"] == 1.0 and found[1, "alpha"] == 0.75 and found[1, "realtime"] == 0.75 and (1, "fps") not in found
    assert {k[1] for k in found if k[0] == 3} == {"real", "time"} and not [k for k in found if k[0] == 2]


def test_index_policy(spark):
    from quarry.operators import index

    def act(*kinds):
        return index.action(spark.createDataFrame([(str(i), k) for i, k in enumerate(kinds)], "snippet_id string, change string")).first()["action"]

    assert (act(), act("added"), act("added", "changed"), act("removed")) == ("noop", "append", "full", "full")


def test_clusters_of_chained_items(spark):
    from quarry.operators import clusters

    e = lambda r, s, t, v: (1, r, f"s{r}", f"p{r % 2}", s, t, v)
    rows = [e(1, 0.1, "a b c more", [1.0, 0.0]), e(2, 0.9, "a b c less", [0.8, 0.6]), e(3, 0.9, "not a b c", [0.28, 0.96]), e(4, 0.2, "z", [-1.0, 0.0]), e(5, 0.2, "z", None)]
    found = clusters.clusters(spark.createDataFrame(rows, "pack long, rank int, snippet_id string, paper_id string, score double, text string, vector array<double>")).orderBy("place").collect()
    assert [(r["cluster"], r["items"], r["label"], r["snippet_id"]) for r in found] == [(4, 1, "consensus", "s4"), (5, 1, "consensus", "s5"), (1, 3, "conflict", "s2")]


def test_routes_of_arithmetic(spark):
    from quarry.operators import routing

    asked = {"2 + 3 * (4 - 1)": "ask", "2 + 3 * (4 - 1) / 7 - 1": "research", "what is 2+2": "ask", "12": "ask", "2 + * 3": "research", "1 2": "research", "-3.5/.5 = ?": "ask", "": "research", "Track 5 + 5": "monitor", "tracking it": "research"}
    frame = spark.createDataFrame([(i, q, None) for i, q in enumerate(asked)], "qid long, question string, explicit string")
    assert {r["qid"]: r["mode"] for r in routing.routed(frame).collect()} == dict(enumerate(asked.values()))


def test_rules_with_thresholds_of_zero(spark):
    from quarry.operators import alerts

    runs = spark.sql("SELECT 't' AS topic, 'r' AS run_id, CAST(NULL AS INT) AS new_sources, 9 AS added, 0 AS updated, 0 AS disputed, map('m', 2.0D) AS metrics, map('synthesis', 'An ALERT') AS texts")
    rule = lambda i, kind, **k: tuple({"trigger_id": i, "type": kind, **k}.get(n.split()[0]) for n in alerts.RULE.split(", "))
    rules = [rule("a", "kb_diff_count", min_added=0, min_updated=0), rule("b", "kb_diff_count", min_added=9), rule("c", "metric_threshold", metric="m", op="gte", value="2"), rule("d", "keyword_presence", keywords=["", "alert"]), rule("e", None), rule("f", "new_documents", min_new=0)]
    found = {r["trigger_id"]: r["fired"] for r in alerts.decisions(runs, spark.createDataFrame(rules, alerts.RULE)).collect()}
    assert found == {"a": False, "b": True, "c": True, "d": True, "e": None, "f": True}


def test_inverted_abstract_and_ordered_needles(spark):
    from pyspark.sql import functions as F

    from quarry.operators import extraction, papers

    one = spark.createDataFrame([('{"i": {"b": [1, 3], "a": [0], "c": []}}', "abcab")], "j string, t string")
    has = lambda *n: extraction.ordered_contains(F.col("t"), F.array(*map(F.lit, n)))
    assert tuple(one.select(papers.uninverted(F.col("j"), "$.i"), has("ab", "bc", "ab"), has("bc", "bc"), has("ca", "abc")).first()) == ("a b b", True, False, False)


def test_snapshots_and_entries_of_edge_cases(spark):
    from pyspark.sql import functions as F

    from quarry.operators import exports, snapshots

    held = spark.createDataFrame([("a", [("s", None), ("s", "<b>one</b> two"), ("s", "three")]), ("b", []), ("c", None)], "snapshot_id string, items array<struct<source string, text string>>")
    assert sorted((r.snippet_id, r.text, r.token_count) for r in snapshots.snippets(held, 2).collect()) == [("SNAP:a:S2", "one two", 2)]
    seen = spark.sql("SELECT * FROM VALUES ('k', timestamp'2024-01-01 00:00:00'), ('k', timestamp'2024-01-01 00:00:10'), ('o', timestamp'2023-01-01 00:00:00') AS t(key, retrieved_at)")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    assert [(r.key, r.retrieved_at.second) for r in snapshots.cached(seen, now, 50).collect()] == [("k", 10)]
    assert snapshots.cached(seen, now, 49).count() == snapshots.cached(seen, now, 0).count() == 0
    papers = spark.createDataFrame([("x", "The Old Sea", ["Ann B. Cole"], 2001, None, "10.1/2", None, ""), ("y", None, [], None, "", None, "2101.1", None)], "paper_id string, title string, authors array<string>, year int, venue string, doi string, arxiv_id string, url string")
    found = {r.paper_id: r for r in exports.bibtex(papers).collect()}
    assert found["x"].entry == "@article{cole2001old,\n  title     = {The Old Sea},\n  author    = {Ann B. Cole},\n  year      = {2001},\n  doi       = {10.1/2},\n}"
    assert found["y"].cite_key == "nd" and found["y"].entry == "@article{nd,\n  eprint    = {2101.1},\n  archiveprefix = {arXiv},\n}"
