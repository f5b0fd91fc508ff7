"""Analysis state: legal transitions, compare-and-set, recovery, and keyed table changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import vocab
from . import rules, skew

ALLOWED = {"pending": ("in_progress",), "in_progress": ("completed", "failed"), "completed": (), "failed": ()}


def state_violations(state: DataFrame) -> DataFrame:
    c = F.col
    _, rows = rules.apply_rules(state, "state", c("analysis_id"), {
        "status": rules.one_of(c("status"), vocab.STATUSES),
        "payload_with_status": (c("status") == "completed") == c("result_payload").isNotNull()})
    return rows


def legal_request() -> Column:
    """A transition request that the state machine and the payload rule allow at all."""
    c = F.col
    allowed = F.lit(False)
    for current, targets in ALLOWED.items():
        if targets:
            allowed = allowed | ((c("expected") == current) & c("target").isin(*targets))
    payload_fits = (c("target") == "completed") == c("payload").isNotNull()
    return allowed & payload_fits


def fold_transitions(events: DataFrame, hot_rows: int = skew.HOT_ROWS) -> DataFrame:
    """Each event with its outcome: 'applied', 'conflict' or 'invalid'.

    ``events``: analysis_id, seq (unique per analysis), expected, target, payload. A row with
    expected null and target 'pending' creates the analysis. The machine only moves forward
    (created -> started -> ended), so the events that apply are the first creation, the first
    legal start after it and the first legal end after that: three minima, each a partial
    aggregate, instead of an ordered fold over all events of a key.
    """
    c = F.col
    create = c("expected").isNull() & (c("target") == "pending") & c("payload").isNull()
    typed = events.withColumn("_create", create).withColumn("_legal", F.coalesce(legal_request(), F.lit(False)))

    def first(df: DataFrame, condition: Column, name: str) -> DataFrame:
        per = df.groupBy("analysis_id").agg(
            F.min(F.when(condition, c("seq"))).alias(name), F.count(F.lit(1)).alias("_size"))
        return skew.lookup(df, per, ["analysis_id"], "_size", hot_rows, spread_by=["seq"]).drop("_size")

    a = first(typed, c("_create"), "_created")
    b = first(a, c("_legal") & (c("expected") == "pending") & (c("seq") > c("_created")), "_started")
    d = first(b, c("_legal") & (c("expected") == "in_progress") & (c("seq") > c("_started")), "_ended")
    applied = (
        (c("_create") & (c("seq") == c("_created")))
        | ((c("expected") == "pending") & (c("seq") == c("_started")))
        | ((c("expected") == "in_progress") & (c("seq") == c("_ended"))))
    outcome = (
        F.when(F.coalesce(applied, F.lit(False)), "applied").when(c("_create") | c("_legal"), "conflict").otherwise("invalid"))
    return d.withColumn("outcome", outcome).select(*events.columns, "outcome")


def final_state(folded: DataFrame) -> DataFrame:
    """Current status (and payload) per analysis from applied events; at most three per key."""
    applied = folded.filter(F.col("outcome") == "applied")
    return applied.groupBy("analysis_id").agg(
        F.max_by("target", "seq").alias("status"), F.max_by("payload", "seq").alias("result_payload"),
        F.max("seq").alias("last_seq"))


def fail_interrupted(state: DataFrame) -> DataFrame:
    """Unfinished analyses without payload become failed; ``recovered`` marks them."""
    stuck = F.col("status").isin("pending", "in_progress") & F.col("result_payload").isNull()
    return state.withColumn("recovered", stuck).withColumn(
        "status", F.when(stuck, "failed").otherwise(F.col("status")))


def status_view(state: DataFrame) -> DataFrame:
    return state.select("analysis_id", "status", "item_ids")


# -- keyed changes of a table --------------------------------------------------------------

def insert_pending(existing: DataFrame, incoming: DataFrame, hot_rows: int = skew.HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Rows to insert, and the incoming rows whose key exists already (or comes twice).

    ``incoming``: analysis_id, request_no (unique per analysis), ... ; the first request wins.
    """
    taken = existing.select("analysis_id", F.lit(True).alias("_taken")).distinct()
    first = incoming.groupBy("analysis_id").agg(F.min("request_no").alias("_first"), F.count(F.lit(1)).alias("_size"))
    known = first.join(taken, "analysis_id", "left")
    marked = skew.lookup(incoming, known, ["analysis_id"], "_size", hot_rows, spread_by=["request_no"])
    wins = F.col("_taken").isNull() & (F.col("request_no") == F.col("_first"))
    fresh = marked.filter(wins).select(*incoming.columns, F.lit("pending").alias("status"))
    return fresh, marked.filter(~wins).select(*incoming.columns)


def delete_keys(existing: DataFrame, keys: DataFrame) -> DataFrame:
    return existing.join(keys.select("analysis_id").distinct(), "analysis_id", "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, version: str) -> DataFrame:
    """Replace rows by key; the highest ``version`` wins among incoming rows of one key."""
    rest = [x for x in existing.columns if x != "analysis_id"]
    newest = incoming.groupBy("analysis_id").agg(F.max_by(F.struct(*rest), version).alias("_r")).select(
        "analysis_id", "_r.*")
    return delete_keys(existing, newest).unionByName(newest.select(*existing.columns))
