"""A page's assets under a budget: a fold over each run's captures in order of arrival, with a memory of answers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webstrata.functions.texts import PRIORITY, fetch_priority
from webstrata.functions.urlspec import points_inside

#: Most assets a capture, bytes of one, bytes of a capture's, and silences in a row after which nothing is asked.
MOST, ASSET_BYTES, CAPTURE_BYTES, SILENCES = 128, 8 * 1024 * 1024, 32 * 1024 * 1024, 3


def asked(url: str, answers: dict, allow_private: bool) -> tuple[dict, int, str]:
    """(outcome, bytes transferred, answered | silent | nothing_sent) of one fetch from recorded answers."""
    if not allow_private and points_inside(url):
        return {"reason": "inside_a_network"}, 0, "nothing_sent"
    answer = answers.get(url)
    if answer is None or answer.get("failure"):
        return {"reason": "no_response", "detail": (answer or {}).get("failure")}, 0, "silent"
    size = int(answer["byte_len"])
    if not allow_private and points_inside(answer["final_url"]):
        return {"reason": "inside_a_network"}, size, "answered"
    if answer.get("truncated"):
        return {"reason": "arrived_short", "byte_len": size}, size, "answered"
    if size > ASSET_BYTES:
        return {"reason": "too_large", "byte_len": size}, size, "answered"
    return {"reason": None, "byte_len": size, "final_url": answer["final_url"], "status": answer.get("status")}, size, "answered"


class Budget:
    """One capture's budget, asked for its references by priority, then in page order. known is the run's memory; deadline is how many requests time allows, else null."""

    def __init__(self, known: dict[str, dict], deadline: int | None = None):
        self.known, self.deadline = known, deadline
        self.dealt = self.transferred = self.silences = self.sent = 0

    def outcome(self, url: str, ask: Callable[[str], tuple[dict, int, str]]) -> dict:
        if url in self.known:
            return self.known[url]
        self.dealt += 1
        if self.dealt > MOST:
            return {"reason": "count_ceiling_reached"}
        if self.transferred >= CAPTURE_BYTES:
            return {"reason": "byte_ceiling_reached"}
        if self.silences >= SILENCES:
            return {"reason": "nothing_was_answering"}
        if self.deadline is not None and self.sent >= self.deadline:
            return {"reason": "deadline_reached"}
        out, size, kind = ask(url)
        self.transferred += size
        self.sent += 1
        self.silences = self.silences + 1 if kind == "silent" else 0 if kind == "answered" else self.silences
        self.known[url] = out
        return out


def fold(references: list[tuple[str, str]], answers: dict, known: dict[str, dict], deadline: int | None = None, allow_private: bool = False) -> list[dict]:
    """Outcomes of one capture's (url, kind) in page order. known is the run's memory; deadline is how many requests time allows, else null."""
    order = sorted(range(len(references)), key=lambda i: PRIORITY.index(references[i][1]) if references[i][1] in PRIORITY else len(PRIORITY))
    out: list[dict] = [{}] * len(references)
    budget = Budget(known, deadline)
    for i in order:
        out[i] = budget.outcome(references[i][0], lambda url: asked(url, answers, allow_private))
    return out


RESULT = "run_id string, capture_id string, place int, url string, kind string, reason string, detail string, byte_len long, final_url string, status int"


#: Addresses whose answers a task remembers, whatever its runs.
SETTLED = 1 << 16


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Outcomes of references that come by run, capture, priority and place, with their answers. A batch and the memory of one run are held at a time."""
    settled: dict[str, tuple[dict, int, str]] = {}
    run = capture = object()
    known: dict[str, dict] = {}
    for batch in batches:
        column = dict(zip(batch.schema.names, batch.columns))
        answer, out = column["answer"], []

        def ask(url: str) -> tuple[dict, int, str]:
            if url not in settled:
                if len(settled) >= SETTLED:
                    settled.clear()
                a = answer[at].as_py()
                settled[url] = asked(url, {url: a | {"byte_len": a["byte_len"] or 0}} if a else {}, False)
            return settled[url]

        for at, (own_run, own_capture, url) in enumerate(zip(*(column[c].to_pylist() for c in ("run_id", "capture_id", "url")))):
            if own_run != run:
                run, capture, known = own_run, object(), {}
            if own_capture != capture:
                capture, budget = own_capture, Budget(known)
            out.append(budget.outcome(url, ask))
        text = column["url"].type
        found = {c: pa.array([o.get(c) for o in out], t) for c, t in (("reason", text), ("detail", text), ("byte_len", pa.int64()), ("final_url", text), ("status", pa.int32()))}
        own = {c: column[c] for c in ("run_id", "capture_id", "place", "url", "kind")}
        yield pa.RecordBatch.from_pydict(own | found)


def budgeted(references: DataFrame, answers: DataFrame) -> DataFrame:
    """Outcomes of references (run_id, capture_id, place, url, kind) against answers (url, final_url, status, byte_len, truncated, failure).

    The fold is in the order of captures within a run, so a run stays in one task; runs are independent, and stream through
    it sorted. Answers are joined to references before, so that only those asked for travel.
    """
    facts = answers.dropDuplicates(["url"]).select("url", F.struct("final_url", F.col("status").cast("int").alias("status"), F.col("byte_len").cast("long").alias("byte_len"), "truncated", "failure").alias("answer"))
    own = references.select(*(F.col(c).cast(t).alias(c) for c, t in (x.split() for x in RESULT.split(", ")[:5])))
    rows = own.join(facts, "url", "left").withColumn("priority", fetch_priority(F.col("kind")))
    ordered = rows.repartition("run_id").sortWithinPartitions("run_id", F.asc_nulls_last("capture_id"), "priority", F.asc_nulls_last("place"))
    return ordered.drop("priority").mapInArrow(folded, RESULT)


def recoverable(misses: DataFrame, kinds: DataFrame) -> DataFrame:
    """Misses (capture_id, url, reason, byte_len) worth asking again, with their role; the last of several roles counts, an unknown one is an image."""
    from webstrata.functions.texts import retryable

    roles = kinds.groupBy("capture_id", "url").agg(F.max_by("kind", "place").alias("kind"))
    return misses.where(retryable(F.col("reason"), F.col("byte_len"))).join(roles, ["capture_id", "url"], "left").withColumn("kind", F.coalesce("kind", F.lit("image")))
