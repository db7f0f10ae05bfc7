"""The event log of user actions and the states it leads to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Events that move a posting to ``to_state``: a mark and its undoing tell of the same move as the change written beside them.
MOVES = ("state_change", "mark_applied", "mark_dismissed", "un_apply", "un_dismiss")
FINAL = ("applied", "dismissed")


def moves(events: DataFrame) -> DataFrame:
    """The events that move a posting."""
    return events.where(F.col("event_type").isin(*MOVES) & F.col("job_id").isNotNull() & F.col("to_state").isNotNull())


def override_reason(to_state: Column, specialty: Column) -> Column:
    """acted_on_unclassified for a final state of a posting without a specialty."""
    return F.when(to_state.isin(*FINAL) & (specialty.isNull() | (specialty == "Unclassified")), "acted_on_unclassified")


def current_state(jobs: DataFrame, events: DataFrame) -> DataFrame:
    """(job_id, state): where the last recorded move led, else the stored state."""
    last = moves(events).groupBy("job_id").agg(F.max_by("to_state", F.struct("recorded_at", "event_id")).alias("_to"))
    return jobs.select("job_id", "state").join(last, "job_id", "left").select("job_id", F.coalesce("_to", "state").alias("state"))


def once(events: DataFrame) -> DataFrame:
    """Events that were delivered twice, once."""
    return events.dropDuplicates(["event_id"])


def dwell_times(events: DataFrame) -> DataFrame:
    """(event_id, dwell_ms): each close with the time since the last open of the same user and job, not below 0.

    A close without an open since the close before it has none.
    """
    views = once(events).where("event_type IN ('detail_view_open', 'detail_view_close') AND job_id IS NOT NULL")
    before = Window.partitionBy("user_id", "job_id").orderBy("recorded_at", "event_id")
    previous = views.select("event_id", "event_type", "recorded_at", F.lag("event_type").over(before).alias("_type"), F.lag("recorded_at").over(before).alias("_at"))
    took = F.greatest(F.lit(0), F.floor((F.unix_micros("recorded_at") - F.unix_micros("_at")) / 1000)).cast("long")
    return previous.where("event_type = 'detail_view_close'").select("event_id", F.when(F.col("_type") == "detail_view_open", took).alias("dwell_ms"))


def auto_review_events(opens: DataFrame) -> DataFrame:
    """What opening a posting writes: new postings turn reviewed first, then the view is noted."""
    change = F.struct(F.lit("state_change").alias("event_type"), F.lit("new").alias("from_state"), F.lit("reviewed").alias("to_state"))
    none = F.lit(None).cast("string")
    view = F.struct(F.lit("detail_view_open").alias("event_type"), none.alias("from_state"), none.alias("to_state"))
    rows = F.array_compact(F.array(F.when(F.col("state") == "new", change), view))
    return opens.select("job_id", F.posexplode(rows).alias("step", "e")).select("job_id", "step", "e.*")


def transition_events(changes: DataFrame) -> DataFrame:
    """What a change of state writes. Applying and dismissing note the mark first; taking either back notes the change first."""
    mark = F.when(F.col("to_state") == "applied", "mark_applied").when(F.col("to_state") == "dismissed", "mark_dismissed")
    back = F.col("to_state").isin("new", "reviewed")
    undo = F.when(back & (F.col("from_state") == "applied"), "un_apply").when(back & (F.col("from_state") == "dismissed"), "un_dismiss")
    names = F.array_compact(F.array(mark, F.lit("state_change"), undo))
    return changes.select("event_id", "job_id", "from_state", "to_state", F.posexplode(names).alias("step", "written"))


def override_rate_weekly(events: DataFrame) -> DataFrame:
    """Extension: per week, moves to a final state and the share of them on unclassified postings; a mark and its change within a minute are one move."""
    final = moves(once(events)).where(F.col("to_state").isin(*FINAL))
    hit = F.when(F.col("specialty_name").isNull() | (F.col("specialty_name") == "Unclassified"), 1).otherwise(0)
    acts = final.groupBy("user_id", "job_id", "to_state", F.date_trunc("minute", "recorded_at").alias("at")).agg(F.max(hit).alias("hit"))
    return acts.groupBy(F.date_format(F.date_trunc("week", "at"), "yyyy-MM-dd").alias("week")).agg(F.count("*").alias("n_final"), F.sum("hit").alias("n_override"), F.round(F.avg("hit"), 6).alias("override_rate"))
