"""Packet life after compilation: store, versions, journals, history, status."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions.text import classify_outcome, clean_source, payload_format

EPOCH = "1970-01-01T00:00:00.000Z"


def upsert(current: DataFrame, new: DataFrame, invalid: DataFrame | None = None) -> DataFrame:
    """The packet table after storing `new`; invalid packets are not stored.

    Adds `action`: create, replace or keep.
    """
    if invalid is not None:
        new = new.join(invalid.select("packet_id").distinct(), "packet_id", "left_anti")
    cols = [c for c in current.columns if c != "packet_id"]
    old = current.select("packet_id", F.struct(*cols).alias("old"))
    fresh = new.select("packet_id", F.struct(*cols).alias("new"))
    return old.join(fresh, "packet_id", "full_outer").select(
        "packet_id", F.coalesce("new", "old").alias("row"),
        F.when(F.col("new").isNull(), "keep").when(F.col("old").isNull(), "create")
        .otherwise("replace").alias("action"),
    ).select("packet_id", "row.*", "action")


def replace_warnings(packets: DataFrame, warnings: DataFrame, updates: DataFrame,
                     now: str) -> tuple[DataFrame, DataFrame]:
    """(packets, warnings) after replacing the warnings of the packets named in
    `updates`; their `updated_at` is bumped. A packet can be given no warnings by
    a row whose `code` is NULL."""
    ids = updates.select("packet_id").distinct()
    kept = warnings.join(ids, "packet_id", "left_anti")
    out = kept.unionByName(updates.where("code IS NOT NULL").select(*warnings.columns))
    touched = packets.join(ids.withColumn("hit", F.lit(True)), "packet_id", "left")
    bumped = F.when(F.col("hit"), F.lit(now)).otherwise(F.col("updated_at"))
    return touched.withColumn("updated_at", bumped).drop("hit"), out


def snapshot_versions(versions: DataFrame, current: DataFrame) -> DataFrame:
    """New version rows: the next number, only where the content has changed.

    `versions`: packet_id, version, digest; `current`: packet_id, digest.
    """
    last = versions.groupBy("packet_id").agg(
        F.max(F.struct("version", "digest")).alias("last")
    )
    return (
        current.join(last, "packet_id", "left")
        .where(~F.col("digest").eqNullSafe(F.col("last.digest")))
        .select("packet_id",
                (F.coalesce(F.col("last.version"), F.lit(0)) + 1).cast("bigint").alias("version"),
                "digest")
    )


def ingest_outcomes(raw: DataFrame, packets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(journal rows, rejects): outcomes are stored only for known packets."""
    ids = packets.select("packet_id")
    valid = raw.where(F.col("packet_id").rlike(K.ID_PATTERN))
    tool = clean_source(F.col("source_tool"))
    slug = F.translate("created_at", ":.", "--")
    rows = valid.join(ids, "packet_id", "left_semi").select(
        "seq", "id", "packet_id", tool.alias("source_tool"),
        classify_outcome(F.col("body")).alias("classification"),
        payload_format(F.col("body")).alias("format"),
        F.concat(F.lit("outcomes/"), slug, F.lit("-"), tool, F.lit(".json")).alias("outcome_path"),
        "created_at",
    )
    return rows, raw.join(ids, "packet_id", "left_anti")


def latest_by_packet(journal: DataFrame) -> DataFrame:
    """The last journal row of each packet, by place in the journal and not by
    time stamp. A map-side combined aggregate: no packet is sorted or gathered."""
    rest = [c for c in journal.columns if c not in ("packet_id", "seq")]
    return journal.groupBy("packet_id").agg(
        F.max_by(F.struct("seq", *rest), "seq").alias("x")
    ).select("packet_id", "x.*")


def packet_status(index: DataFrame, dispatches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Summary of each packet with its latest dispatch and outcome, newest first."""
    d = latest_by_packet(dispatches).select(
        F.col("packet_id").alias("id"), F.col("id").alias("receipt_id"), "target_tool", "adapter",
        F.col("status").alias("dispatch_status"), F.col("created_at").alias("dispatched_at"),
    )
    o = latest_by_packet(outcomes).select(
        F.col("packet_id").alias("id"), F.col("id").alias("outcome_id"), "classification",
        F.col("created_at").alias("outcome_at"),
    )
    return (
        index.drop("confidence_score", "created_at")
        .join(d, "id", "left").join(o, "id", "left")
        .orderBy(F.desc("updated_at"), "id")
    )


def packet_history(versions: DataFrame, dispatches: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One timeline of versions, dispatches and outcomes, ordered by the text of
    the time stamp; empty stamps come first, equal ones keep this order."""
    def part(df: DataFrame, rank: int, kind: str, at: Column, **cols: Column) -> DataFrame:
        names = ["ref", "label", "target"]
        return df.select(
            "packet_id", F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), at.alias("at"),
            F.col("seq"), *[cols.get(n, F.lit(None).cast("string")).alias(n) for n in names],
        )

    at = F.coalesce("created_at", F.lit(""))
    rows = part(
        versions, 0, "version", F.coalesce(F.nullif("updated_at", F.lit("")), F.lit(EPOCH)),
        ref=F.concat(F.lit("v"), F.col("version").cast("string")), label=F.col("status"),
        target=F.col("validation_level"),
    ).unionByName(part(dispatches, 1, "dispatch", at, ref=F.col("id"), label=F.col("status"),
                       target=F.col("target_tool"))
    ).unionByName(part(outcomes, 2, "outcome", at, ref=F.col("id"), label=F.col("classification"),
                       target=F.col("source_tool")))
    return rows.orderBy("packet_id", "at", "rank", "seq").drop("rank")


def history_summary(versions: DataFrame, dispatches: DataFrame, outcomes: DataFrame) -> DataFrame:
    def kind(df: DataFrame, k: str) -> DataFrame:
        return df.select("packet_id", F.lit(k).alias("kind"))

    rows = kind(versions, "version").unionByName(kind(dispatches, "dispatch")).unionByName(
        kind(outcomes, "outcome")
    )
    return rows.groupBy("packet_id").agg(*[
        F.count_if(F.col("kind") == k).alias(f"{k}_count")
        for k in ("version", "dispatch", "outcome")
    ])


# Status a packet moves to on an outcome, where that transition is legal.
OUTCOME_STATUS = {
    "success": "completed", "failure": "needs_clarification", "incomplete": "ready_for_export",
}


def legal(prior: Column, current: Column) -> Column:
    edges = [f"{a}>{b}" for a, out in K.TRANSITIONS.items() for b in out]
    return F.concat(prior, F.lit(">"), current).isin(edges)


def advance_status(packets: DataFrame, outcomes: DataFrame,
                   targets: dict[str, str] = OUTCOME_STATUS) -> DataFrame:
    """`packet_id, prior_status, status` after the latest outcome of each packet."""
    last = latest_by_packet(outcomes).select("packet_id", "classification")
    wanted = F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])
    moved = packets.select("packet_id", "status").join(last, "packet_id", "left").withColumn(
        "wanted", F.try_element_at(wanted, F.col("classification"))
    )
    return moved.select(
        "packet_id", F.col("status").alias("prior_status"),
        F.when(legal(F.col("status"), F.col("wanted")), F.col("wanted"))
        .otherwise(F.col("status")).alias("status"),
    )


@dataclass(frozen=True)
class Migration:
    source: str
    target: str
    up: Callable[[DataFrame], DataFrame]


# Registered schema migrations; the current version maps to itself.
MIGRATIONS: list[Migration] = [Migration(K.SCHEMA_VERSION, K.SCHEMA_VERSION, lambda df: df)]


def migration_chain(source: str, target: str, steps: list[Migration]) -> list[Migration] | None:
    """Shortest chain of steps, by breadth-first search over the registry."""
    if source == target:
        return [m for m in steps if m.source == source and m.target == target][:1]
    seen, queue = {source}, [(source, [])]
    while queue:
        version, path = queue.pop(0)
        for m in steps:
            if m.source != version or m.target in seen:
                continue
            if m.target == target:
                return [*path, m]
            seen.add(m.target)
            queue.append((m.target, [*path, m]))
    return None


def migrate(packets: DataFrame, target: str = K.SCHEMA_VERSION,
            steps: list[Migration] | None = None) -> tuple[DataFrame, DataFrame]:
    """(migrated, no path). Only versions the registry knows can be migrated, so
    the chains follow from the registry and no data is collected for them."""
    steps = MIGRATIONS if steps is None else steps
    known = dict.fromkeys([target, *[m.source for m in steps]])
    out: DataFrame | None = None
    reachable = []
    for version in known:
        chain = migration_chain(version, target, steps)
        if chain is None:
            continue
        reachable.append(version)
        part = packets.where(F.col("schema_version") == version)
        for step in chain:
            part = step.up(part)
        part = part.withColumn("schema_version", F.lit(target)).select(*packets.columns)
        out = part if out is None else out.unionByName(part)
    lost = packets.where(~F.coalesce(F.col("schema_version").isin(reachable), F.lit(False)))
    return out, lost


def normalize_line_ends(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def gap_sessions(events: DataFrame, key: str, ts: str, gap_seconds: int) -> DataFrame:
    """Activity sessions: a pause of at least `gap_seconds` ends a session.

    Events are first combined (map-side) into time slots as long as the gap; all
    events of a slot are in one session. Only slots, whose number is bounded by
    the time range, meet in the window of a key.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = gap_seconds * 1_000_000
    slots = events.select(key, micros.alias("at")).groupBy(
        key, F.floor(F.col("at") / gap).alias("slot")
    ).agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("slot")
    opens = F.coalesce(F.col("lo") - F.lag("hi").over(w) >= gap, F.lit(True)).cast("bigint")
    return (
        slots.withColumn("opens", opens)
        .withColumn("session", F.sum("opens").over(
            w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .groupBy(key, "session")
        .agg(F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("events"))
    )
