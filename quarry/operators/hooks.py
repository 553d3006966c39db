"""Decisions by functions of the user's own, as a table function: checked rows, and a budget of time for each call."""

from __future__ import annotations

import json
import signal
import threading
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISION = "hook string, trigger_id string, severity string, fired boolean, reason string, observed string, threshold string, error string"
SEVERITIES = ("low", "medium", "high")
Hook = Callable[[dict], list[dict]]


class Late(Exception):
    pass


def within(seconds: float, call: Callable[[], Any]) -> Any:
    """call(), or Late after so many seconds. A worker's tasks run in its main thread; elsewhere the call is watched from beside."""
    if threading.current_thread() is threading.main_thread():
        def stop(*_):
            raise Late

        before = signal.signal(signal.SIGALRM, stop)
        signal.setitimer(signal.ITIMER_REAL, seconds)
        try:
            return call()
        finally:
            signal.setitimer(signal.ITIMER_REAL, 0)
            signal.signal(signal.SIGALRM, before)
    out: dict = {}

    def run() -> None:
        try:
            out["value"] = call()
        except Exception as e:  # handed on below
            out["error"] = e

    beside = threading.Thread(target=run, daemon=True)
    beside.start()
    beside.join(seconds)
    if beside.is_alive():
        raise Late
    if "error" in out:
        raise out["error"]
    return out["value"]


def checked(name: str, raw: Any) -> tuple:
    """A decision as a row, or a row that says what is wrong with it."""
    if not isinstance(raw, dict):
        return name, None, None, None, None, None, None, "decision must be a dict"
    severity = str(raw.get("severity") or "low").lower()
    if severity not in SEVERITIES:
        return name, None, None, None, None, None, None, f"invalid severity '{severity}'"
    plain = lambda k: json.dumps(raw.get(k, {}), sort_keys=True)
    return name, str(raw.get("trigger_id") or "custom_hook_trigger"), severity, bool(raw.get("fired", False)), str(raw.get("reason", "")), plain("observed"), plain("threshold"), None


def table_function(hooks: dict[str, Hook], asked: list[str], seconds: float):
    """The table function that calls the asked hooks with a row's context, a JSON object."""

    class Decisions:
        def eval(self, context: str) -> Iterator[tuple]:
            held = json.loads(context)
            for name in asked:
                bad = lambda e: (name, None, None, None, None, None, None, e)  # noqa: B023, E731
                if name not in hooks:
                    yield bad("hook not allowed")
                    continue
                try:
                    found = within(seconds, lambda: hooks[name](held))  # noqa: B023
                except Late:
                    yield bad("timeout")
                except Exception as e:
                    yield bad(f"failed: {e}")
                else:
                    if isinstance(found, list):
                        yield from (checked(name, raw) for raw in found)
                    else:
                        yield bad("output must be a list")

    return F.udtf(Decisions, returnType=DECISION)


def decisions(runs: DataFrame, hooks: dict[str, Hook], asked: list[str], seconds: float = 5.0) -> DataFrame:
    """topic, run_id and the decisions of the asked hooks, in their order, on each row of runs(topic, run_id, ...), whose columns are the hooks' context.

    hooks: those that are allowed, by name. A hook that isn't allowed, fails, takes longer than seconds or returns something
    else than a list of decisions gives a row with error, and the others go on. A late hook of a worker's main thread is
    interrupted.
    """
    spark = runs.sparkSession
    spark.udtf.register("hook_decisions", table_function(hooks, asked, seconds))
    runs.select("topic", "run_id", F.to_json(F.struct("*")).alias("context")).createOrReplaceTempView("hook_runs")
    return spark.sql("SELECT r.topic, r.run_id, d.* FROM hook_runs r, LATERAL hook_decisions(r.context) d")
