"""Structured Streaming jobs over the driver's tables, run to the end of what is there."""

from __future__ import annotations

from caseweave.plans.base import table
from caseweave.plans.registry import query
from caseweave.plans.timelines import mentions
from caseweave.session import scratch_path
from caseweave.streaming import audit, dialogue


def stream_of(spark, sf: str, name: str):
    """The table's files, one or a folder of them, as a file stream whose first trigger takes all there are.

    A pattern names the path, as a plain one has to be a folder.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


def run(spark, stream, mode: str = "append"):
    out, state = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-state")
    audit.run_to_table(stream, out, state, mode)
    return spark.read.schema(stream.schema).parquet(out)


@query("sm1_dialogue_context", "SELECT conv_id, turn, person, place, prev_person, prev_place FROM carried", ("carried",))
def _(spark, sf):
    # a session's turns may lie in any of the files: all there are make one trigger
    return run(spark, dialogue.carry_context_stream(mentions(stream_of(spark, sf, "conversations"))))


@query("sm2_audit_log", "SELECT event_id, ts, event_type, user_id FROM events")
def _(spark, sf):
    return run(spark, stream_of(spark, sf, "events").select("event_id", "ts", "event_type", "user_id"))


@query("sm2_audit_window_counts", """SELECT w AS window_start, event_type, COUNT(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS w, event_type FROM events) GROUP BY ALL
    HAVING w + INTERVAL 1 DAY <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR""")
def _(spark, sf):
    # a window appears once the watermark (latest event minus one hour) has passed its end
    return run(spark, audit.windowed_counts(stream_of(spark, sf, "events"), "ts", ["event_type"], "1 day", "1 hour"))
