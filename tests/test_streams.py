"""Streams: noise control with state across batches and restarts; a watched folder taken once, whatever is repeated."""

import datetime as dt
import json
import os
import random

from pyspark.sql import functions as F

from quarry.operators import index, monitoring
from quarry.streaming import noise, watch

LOG = "topic string, at timestamp, fired boolean"


def decisions(spark, seed=3):
    r, start = random.Random(seed), dt.datetime(2024, 1, 1)
    rows = [(t, start + dt.timedelta(minutes=30 * i + j), r.random() < 0.7) for i in range(40) for j, t in enumerate("abc")]
    return spark.createDataFrame(rows + [("b", start + dt.timedelta(days=9), None)], LOG), start


def rounds(df):
    return sorted((r["topic"], r["at"], r["fired"], r["emitted"], r["suppressed_by"]) for r in df.collect())


def test_stream_equals_the_fold_over_the_log(spark, tmp_path):
    log, start = decisions(spark)
    place = f"file://{tmp_path}"
    for low, high in ((0, 4), (4, 5), (5, 300)):
        log.where(F.col("at").between(start + dt.timedelta(hours=low), start + dt.timedelta(hours=high, seconds=-1))).write.mode("append").parquet(f"{place}/log")
        noise.drain(spark, spark.readStream.schema(LOG).parquet(f"{place}/log"), place, 2, 90)
    noise.drain(spark, spark.readStream.schema(LOG).parquet(f"{place}/log"), place, 2, 90)  # nothing new
    found = rounds(spark.read.parquet(f"{place}/rows"))
    want = rounds(monitoring.noise_control(log.fillna({"fired": False}), 2, 90))
    assert found == want and {r[4] for r in found} == {None, "hysteresis", "cooldown", "not_fired"}
    assert noise.STORE not in dict(spark.sparkContext.getConf().getAll())


def paper(name, text, section="body"):
    return {"paper": {"paper_id": name, "title": name.upper()}, "snippets": [{"snippet_id": f"P{name}:S1", "paper_id": name, "section": section, "text": text}]}


def put(folder, name, *papers, at):
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{name}"
    with open(path, "w") as f:
        f.write("\n".join(p if isinstance(p, str) else json.dumps(p) for p in papers))
    os.utime(path, (at, at))


def state(spark, own):
    texts = {r["snippet_id"]: r["text"] for r in own.snippets(spark).collect()}
    manifest = {r["snippet_id"] for r in own.index(spark).table(spark, "manifest").collect()}
    terms = {r["term"]: r["df"] for r in own.index(spark).table(spark, "terms").collect()}
    return texts, manifest, terms


def test_watched_folder(spark, tmp_path):
    folder, own = f"{tmp_path}/in", watch.Watch(f"file://{tmp_path}/in", f"file://{tmp_path}/kept")
    put(folder, "a.json", paper("one", "alpha beta"), "not json", at=1000)
    put(f"{folder}/deep", "b.json", paper("two", "beta"), at=1001)
    assert watch.run(spark, own) == 1
    assert state(spark, own) == ({"Pone:S1": "alpha beta", "Ptwo:S1": "beta"}, {"Pone:S1", "Ptwo:S1"}, {"alpha": 1, "beta": 2})
    assert watch.run(spark, own) == 0  # nothing new
    put(folder, "c.json", paper("three", "gamma"), paper("one", "older than what is there"), at=900)
    assert watch.run(spark, own) == 1
    assert state(spark, own)[0] == {"Pone:S1": "alpha beta", "Ptwo:S1": "beta", "Pthree:S1": "gamma"}
    put(folder, "a.json", paper("one", "delta"), at=2000)  # changed in place
    assert watch.run(spark, own) == 1
    texts, manifest, terms = state(spark, own)
    assert texts["Pone:S1"] == "delta" and terms == {"delta": 1, "beta": 1, "gamma": 1} and len(manifest) == 3
    assert watch.run(spark, own) == 0


def test_repeated_and_half_done_batches(spark, tmp_path, monkeypatch):
    folder, own = f"{tmp_path}/in", watch.Watch(f"file://{tmp_path}/in", f"file://{tmp_path}/kept")
    put(folder, "a.json", paper("one", "alpha"), at=1000)
    rows = watch._rows(spark.read.schema(watch.corpus_files.SCHEMA).json(f"{folder}/a.json"))

    def dies(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(watch.index, "refresh", dies)
    try:
        watch.take(spark, own, rows, "stream-0")
    except RuntimeError:
        pass
    assert own.log(spark).count() == 0 and own.papers(spark).count() == 0  # nothing of it is seen
    monkeypatch.undo()
    assert watch.take(spark, own, rows, "stream-0")
    before = state(spark, own)
    assert not watch.take(spark, own, rows, "stream-0")  # the same batch
    assert not watch.take(spark, own, rows, "stream-1")  # the same files
    assert state(spark, own) == before and own.log(spark).count() == 1
    assert index.opened(spark, f"{own.place}/index").segments


def test_empty_watch(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    own = watch.Watch(f"file://{tmp_path}/in", f"file://{tmp_path}/kept")
    assert watch.run(spark, own) == 0 and own.index(spark) is None and own.papers(spark).count() == 0
