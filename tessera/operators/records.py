"""Transitions and sessions as keyed tables of a store: appended, measured later, moved through their states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera import schemas
from tessera.sources.audio import write_wavs
from tessera.sources.versions import Change, Store, Version

#: What an evaluation adds to a transition after it was rendered.
METRICS = tuple(c.split()[0] for c in schemas.TRANSITIONS_MEASURED.removeprefix(schemas.TRANSITIONS + ", ").split(", "))
#: Legal moves of a session's status.
MOVES = {None: ("RENDERING",), "RENDERING": ("RENDERING", "READY", "PARTIAL", "FAILED")}
ONCE = ("config_snapshot",)


def save_transitions(change: Change, rows: DataFrame) -> Change:
    """New transitions; columns that ``rows`` lacks are null."""
    return change.append("transitions", schemas.upgraded(rows, "transitions"), "transition_id")


def transitions(version: Version, ids: DataFrame | None = None) -> DataFrame:
    """All transitions, or those of ``ids`` (transition_id) from their file groups alone."""
    if "transitions" not in version.tables:
        return schemas.empty(version.store.spark, "transitions")
    return version.read("transitions") if ids is None else version.find("transitions", ids)


def attach_metrics(change: Change, metrics: DataFrame) -> Change:
    """Adds metrics to transitions that are there; what ``metrics`` has no column for stays."""
    if unknown := set(metrics.columns) - {"transition_id", *METRICS}:
        raise ValueError(f"no metrics: {sorted(unknown)}")
    types = schemas.schema("transitions")
    return change.merge("transitions", metrics.select(*[F.col(c).cast(types[c].dataType).alias(c) for c in metrics.columns]), insert=False)


def publish_renders(store: Store, mixes: DataFrame, base: Version | None = None) -> Version:
    """Rows and audio of rendered transitions, visible together or not at all.

    mixes: the columns of a transition with samples, channels and rate; a row
    with a failure_reason has no audio and is stored as FAILED.  Tasks write the
    audio to a new folder of the change; a job that dies leaves nothing that a
    version names.
    """
    change = store.change(base)
    folder = change.folder("audio")
    named = mixes.withColumn("name", F.concat("transition_id", F.lit(".wav")))
    files = write_wavs(named.where("failure_reason is null"), folder.removeprefix("file:").replace("//", "/"))
    rows = named.join(files.select("name", F.col("path").alias("wav_path")), "name", "left")
    rows = rows.withColumn("status", F.when(F.col("failure_reason").isNull(), "RENDERED").otherwise("FAILED"))
    save_transitions(change, rows.select(*[c for c in rows.columns if c in schemas.schema("transitions").names]))
    change.attach_folder("transition_audio", folder)
    return change.commit()


def moved(sessions: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(moves that are legal, refused ones with a failure_reason) of asked session rows; of several for one session all are refused.

    A new session starts as RENDERING; from there it ends as READY, PARTIAL or
    FAILED, and an ended one stays as it is.
    """
    old = sessions.select("session_id", F.col("status").alias("__from"))
    several = asked.groupBy("session_id").agg((F.count("*") > 1).alias("__several"))
    # neither is broadcast: small files may hold millions of sessions
    rows = asked.join(several.hint("merge"), "session_id", "left").join(old.hint("merge"), "session_id", "left")
    legal = F.lit(False)
    for start, ends in MOVES.items():
        legal = legal | (F.col("__from").eqNullSafe(F.lit(start)) & F.coalesce(F.col("status").isin(*ends), F.lit(False)))
    reason = F.when(F.col("session_id").isNull(), "MISSING_ID").when(F.col("__several"), "SEVERAL_MOVES").when(~legal, "ILLEGAL_MOVE")
    rows = rows.withColumn("failure_reason", reason)
    refused = rows.where("failure_reason is not null").select("session_id", F.col("__from").alias("from_status"), F.col("status").alias("to_status"), "failure_reason")
    return rows.where("failure_reason is null").select(*asked.columns), refused


def save_sessions(store: Store, asked: DataFrame, base: Version | None = None) -> tuple[Version, DataFrame]:
    """(version with the legal moves, the refused ones); the configuration is kept as it was first saved."""
    change = store.change(base)
    if "sessions" not in change.tables:
        change.replace("sessions", schemas.empty(store.spark, "sessions"), "session_id")
        change = store.change(change.commit())
    good, refused = moved(change.base.read("sessions"), schemas.upgraded(asked, "sessions"))
    return change.merge("sessions", good, on_insert=ONCE).commit(), refused


def session(version: Version, ids: DataFrame) -> DataFrame:
    """Point look-up of sessions (session_id)."""
    return version.find("sessions", ids)
