"""From session files to stored packets: parse, draft, link, collect, validate, store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans.compile import compile_fast, merge_artifacts, merge_links, provenance_links
from sessionloom.plans.lifecycle import upsert
from sessionloom.plans.packets import PacketSet
from sessionloom.plans.schema_rules import schema_violations
from sessionloom.session import materialize
from sessionloom.sources.sessions import parse_sessions


@dataclass
class Compiled:
    """`packets` with the `action` of each, the links and artifacts that go with
    them, and the schema violations that kept a draft from being stored."""

    packets: DataFrame
    links: DataFrame
    artifacts: DataFrame
    violations: DataFrame


def compile_packets(
    lines: DataFrame, stored: PacketSet, current: DataFrame, columns: list[str],
    policy: dict[str, str], repos: DataFrame | None = None, now: str = "1970-01-01T00:00:00.000Z",
) -> Compiled:
    """Compile all sessions of a line table against the packets stored so far.

    `stored` gives the packet lists, `current` the stored packets (priors), of
    which `columns` are kept. Links carry the byte spans of the parsers; those of
    the artifact that is compiled replace the stored ones.
    """
    messages = materialize(
        parse_sessions(lines).withColumnRenamed("artifact_id", "session_id"), "messages-linked")
    sessions = messages.select("session_id").distinct().withColumn("packet_id", F.col("session_id"))
    drafts = materialize(
        compile_fast(messages, sessions, current, repos, now)
        .select("*", *[F.expr(e).alias(n) for n, e in policy.items()]), "drafts-linked")
    named = drafts.withColumn(
        "artifact_id", F.concat(F.lit("transcript-"), F.left(F.md5(F.col("packet_id")), F.lit(16))))
    ids = drafts.select("packet_id")
    items = stored.context_items.join(ids, "packet_id", "left_semi")
    links = merge_links(stored.provenance_links, provenance_links(named, items, messages))
    fresh = named.select(
        "packet_id", F.col("artifact_id").alias("id"), F.lit("transcript").alias("type"),
        F.lit("cli").alias("source_tool"), F.concat(F.lit("transcript:"), "packet_id").alias("uri"))
    have = stored.source_artifacts.select("packet_id", "id", "type", "source_tool", "uri")
    violations = schema_violations(
        PacketSet(**{**vars(stored.restricted_to(ids)), "packets": drafts}))
    packets = upsert(current.select("packet_id", *columns), drafts.select("packet_id", *columns), violations)
    return Compiled(packets, links, merge_artifacts(have, fresh), violations)
