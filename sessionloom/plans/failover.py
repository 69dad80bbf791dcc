"""From session files to gated handoffs in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.plans import lint as L
from sessionloom.plans.compile import compile_fast
from sessionloom.plans.packets import PacketSet
from sessionloom.plans.render import render
from sessionloom.plans.schema_rules import schema_violations
from sessionloom.session import materialize
from sessionloom.sources.sessions import parse_sessions

POLICY = {
    "has_policy": "false", "approval_required": "false", "dispatch_allowed": "true",
    "policy_reasons": "''", "context_budget": "cast(null as bigint)",
    "include_provenance": "false", "repo": "root",
}


def compile_lines(lines: DataFrame, priors: DataFrame | None = None,
                  repos: DataFrame | None = None, now: str = "1970-01-01T00:00:00.000Z") -> DataFrame:
    """Packet drafts of all sessions of a line table; the artifact is the packet."""
    turns = parse_sessions(lines).withColumnRenamed("artifact_id", "session_id")
    sessions = turns.select("session_id").distinct().withColumn("packet_id", F.col("session_id"))
    return compile_fast(turns, sessions, priors, repos, now)


def gate(ps: PacketSet, state: L.RepoState | None = None) -> DataFrame:
    """`packet_id, errors, passed`: errors of any rule and schema violations block."""
    found = L.every_finding(ps, state or L.RepoState(), schema_violations(ps))
    counts = found.groupBy("packet_id").agg(F.count_if(L.is_error()).alias("errors"))
    return ps.packets.select("packet_id").join(counts, "packet_id", "left").select(
        "packet_id", F.coalesce("errors", F.lit(0)).alias("errors"),
        (F.coalesce("errors", F.lit(0)) == 0).alias("passed"))


def failover(lines: DataFrame, lists: PacketSet, target: str = "generic",
             priors: DataFrame | None = None, repos: DataFrame | None = None,
             now: str = "1970-01-01T00:00:00.000Z", state: L.RepoState | None = None) -> DataFrame:
    """Compile, check and render: text only for packets that pass the gate.

    `state` holds what the rules on repository, history and approvals look at.

    `lists` gives the packet lists carried over from earlier compiles.
    """
    drafts = compile_lines(lines, priors, repos, now)
    drafts = materialize(
        drafts.select("*", *[F.expr(e).alias(n) for n, e in POLICY.items()]), "drafts")
    ps = PacketSet(**{**vars(lists), "packets": drafts})
    gated = materialize(gate(ps, state), "gate")
    texts = render(ps.restricted_to(gated.where("passed")), target)
    return gated.join(texts, "packet_id", "left").select(
        "packet_id", "errors", "passed", F.lit(target).alias("target"), "part_no", "markdown",
        "chars")
