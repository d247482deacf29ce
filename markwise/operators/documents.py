"""Audit logs inside JSON documents, as events in rows.

One pass over a document gives its state digest and its events in canonical form; everything else is columns over the exploded
events: the hash of an event is compared with the digest of what it signs, its link with the event before it. Rebuilding a
chain is a fold, since each hash covers the one before it, and runs per document.
"""

from __future__ import annotations

import json
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwise.functions.hashing import digest
from markwise.operators.nested import complete
from markwise.session import shipped_here

#: The fields that a chain writes itself.
SEALS = ("previous_hash", "event_hash", "state_hash")
_OPENED = "struct<whole:boolean,listed:boolean,state:string,log:array<struct<previous:string,own:string,state:string,signed:string>>>"


def _opened(text: str | None) -> dict | None:
    document = None if text is None else complete(text)
    if not isinstance(document, dict):
        return {"whole": False, "listed": False, "state": None, "log": []}
    log = document.pop("audit_log", [])
    state = digest(document)
    if not isinstance(log, list):
        return {"whole": True, "listed": False, "state": state, "log": []}
    text_of = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    rows = [{"previous": text_of(e.get("previous_hash")), "own": text_of(e.get("event_hash")), "state": text_of(e.get("state_hash")), "signed": digest({k: v for k, v in e.items() if k != "event_hash"})} if isinstance(e, dict) else None for e in log]
    return {"whole": True, "listed": True, "state": state, "log": rows}


def opened(payload: Column) -> Column:
    """What a check needs of a document: whether it is an object, whether its log is a list, its state digest, its events."""

    shipped_here()

    @F.pandas_udf(_OPENED)
    def run(texts):
        import pandas as pd

        return pd.DataFrame([_opened(t) for t in texts], columns=["whole", "listed", "state", "log"])

    return run(payload)


def events(documents: DataFrame) -> DataFrame:
    """doc_id, event_pos (from 0), event (previous, own, state, signed), last (of its document), document_state."""
    rows = documents.select("doc_id", opened(F.col("payload")).alias("d"))
    spread = rows.select("doc_id", F.col("d.state").alias("document_state"), F.size("d.log").alias("n"), F.posexplode("d.log").alias("event_pos", "event"))
    return spread.select("doc_id", "event_pos", "event", (F.col("event_pos") == F.col("n") - 1).alias("last"), "document_state")


def verified(documents: DataFrame) -> DataFrame:
    """doc_id, fault of every fault in the logs of (doc_id, payload), whose ids must be unique.

    An event may be no object, be linked to another event than the one before it, or carry another hash than its content gives;
    the last event must be bound to the state of its document. A broken payload, a log that is no list and an empty log are
    one fault each.
    """
    rows = documents.select("doc_id", opened(F.col("payload")).alias("d"))
    whole = F.when(~F.col("d.whole"), "payload: no JSON object").when(~F.col("d.listed"), "audit_log: no list").when(F.size("d.log") == 0, "audit_log: empty")
    # an event that is no object passes on the hash before it
    linked = events(documents).withColumn("own", F.col("event.own")).withColumn("before", F.lag("own").over(Window.partitionBy("doc_id", F.col("event").isNull()).orderBy("event_pos")))
    at = F.concat(F.lit("audit_log["), F.col("event_pos").cast("string"), F.lit("]: "))
    wrong = F.array_compact(
        F.array(
            F.when(F.col("event").isNull(), F.concat(at, F.lit("no object"))),
            F.when(F.col("event").isNotNull() & ~F.col("event.previous").eqNullSafe(F.col("before")), F.concat(at, F.lit("previous_hash"))),
            F.when(F.col("event").isNotNull() & ~F.col("own").eqNullSafe(F.col("event.signed")), F.concat(at, F.lit("event_hash"))),
            F.when(F.col("last") & (F.coalesce("event.state", F.lit("")) == ""), "audit_log: state missing").when(F.col("last") & (F.col("event.state") != F.col("document_state")), "audit_log: state differs"),
        )
    )
    return rows.select("doc_id", whole.alias("fault")).where("fault is not null").unionByName(linked.select("doc_id", F.explode(wrong).alias("fault")))


def chained(bodies: list[dict], start: str | None = None) -> list[dict]:
    """Events from their bodies, each linked to the one before it and sealed with its hash."""

    def seal(before: dict, body: dict) -> dict:
        event = {**body, "previous_hash": before["event_hash"]}
        return {**event, "event_hash": digest(event)}

    return list(accumulate(bodies, seal, initial={"event_hash": start}))[1:]


def with_event(document: dict, body: dict) -> dict:
    """The document with one more event, bound to its state."""
    log = document.get("audit_log") or []
    state = digest({k: v for k, v in document.items() if k != "audit_log"})
    return {**document, "audit_log": [*log, *chained([{**body, "state_hash": state}], log[-1]["event_hash"] if log else None)]}


def repaired(documents: DataFrame, at: str, actor: str = "system") -> DataFrame:
    """doc_id, payload with every log built anew, and one last event (audit.recomputed) that says so.

    Seals of the old events are dropped, states too, since they describe what is gone. Payloads that are no objects, or whose
    log is no list of objects, stay as they are.
    """

    def rebuilt(doc_id: str, text: str | None) -> str | None:
        document = None if text is None else complete(text)
        log = document.get("audit_log", []) if isinstance(document, dict) else None
        if not isinstance(log, list) or not all(isinstance(e, dict) for e in log):
            return text
        chain = chained([{k: v for k, v in e.items() if k not in SEALS} for e in log])
        note = {"event_id": "evt-" + digest([doc_id, at])[7:39], "timestamp": at, "event_type": "audit.recomputed", "actor_ref": actor, "payload_hash": digest({"previous_head": chain[-1]["event_hash"] if chain else None, "event_count": len(chain)})}
        return json.dumps(with_event({**document, "audit_log": chain}, note), ensure_ascii=False)

    shipped_here()

    @F.arrow_udf("string")
    def run(ids: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([rebuilt(i, t) for i, t in zip(ids.to_pylist(), texts.to_pylist(), strict=True)], pa.string())

    return documents.select("doc_id", run("doc_id", "payload").alias("payload"))
