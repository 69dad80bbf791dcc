"""Fast compile: session turns to packet drafts, with provenance.

Turns: `session_id, ord, role, text` and, for provenance, `artifact_id,
span_start, span_end`. Priors: packet scalars keyed by `packet_id`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionloom import constants as K
from sessionloom.functions.text import derive_title, full_trim, is_tool_placeholder, non_blank

PRIOR_FIELDS = [
    "title", "status", "validation_level", "task_type", "objective", "current_state",
    "next_action", "confidence_score", "created_at",
]
REPO_FIELDS = ["root", "branch", "base_branch", "commit", "base_commit"]


def session_ends(turns: DataFrame) -> DataFrame:
    """First user, first and last prose assistant text of each session.

    Plain aggregates: every task keeps three texts per session, so sessions of
    any length are combined map-side and never sorted or gathered.
    """
    user = F.col("role") == "user"
    prose = (F.col("role") == "assistant") & ~is_tool_placeholder(F.col("text"))
    return (
        turns.where(F.col("role").isin("user", "assistant"))
        .select(
            "session_id", "text",
            F.when(user, F.col("ord")).alias("user_ord"),
            F.when(prose, F.col("ord")).alias("prose_ord"),
        )
        .groupBy("session_id")
        .agg(
            F.min_by("text", "user_ord").alias("first_user"),
            F.min_by("text", "prose_ord").alias("first_prose"),
            F.max_by("text", "prose_ord").alias("last_prose"),
        )
    )


def prior_mismatch(priors: DataFrame) -> DataFrame:
    """Warning rows for priors of another schema version."""
    v = F.col("schema_version")
    return priors.where(~v.eqNullSafe(K.SCHEMA_VERSION)).select(
        "packet_id", F.lit("COMPILE_PRIOR_SCHEMA_MISMATCH").alias("code"),
        F.lit("warning").alias("severity"),
        F.concat(
            F.lit("Prior packet has schema_version='"), v, F.lit("', current is '"),
            F.lit(K.SCHEMA_VERSION),
            F.lit("'. Discarding prior narrative; rebuilding from scratch."),
        ).alias("message"),
    )


def compile_fast(
    turns: DataFrame,
    sessions: DataFrame,
    priors: DataFrame | None = None,
    repos: DataFrame | None = None,
    now: Column | str = "1970-01-01T00:00:00.000Z",
) -> DataFrame:
    """One packet draft per session of `sessions` (`session_id, packet_id`).

    Prior narrative wins over the transcript; a prior of another schema version
    is dropped. `repos` has `packet_id` and the repository fields of attached
    packets; the others get the unattached constants.
    """
    now = F.lit(now) if isinstance(now, str) else now
    df = sessions.join(session_ends(turns), "session_id", "left")
    if priors is not None:
        usable = priors.where(F.col("schema_version") == K.SCHEMA_VERSION)
        df = df.join(
            usable.select("packet_id", *[F.col(f).alias(f"prior_{f}") for f in PRIOR_FIELDS]),
            "packet_id", "left",
        )
    else:
        df = df.select("*", *[
            F.lit(None).cast("double" if f == "confidence_score" else "string").alias(f"prior_{f}")
            for f in PRIOR_FIELDS
        ])
    if repos is not None:
        df = df.join(
            repos.select("packet_id", *[F.col(f).alias(f"repo_{f}") for f in REPO_FIELDS],
                         F.col("dirty").alias("repo_dirty"), F.lit(True).alias("repo_on")),
            "packet_id", "left",
        )
    else:
        df = df.select(
            "*", *[F.lit(None).cast("string").alias(f"repo_{f}") for f in REPO_FIELDS],
            F.lit(None).cast("boolean").alias("repo_dirty"), F.lit(False).alias("repo_on"),
        )

    def first_of(field: str, *others: Column) -> Column:
        return F.coalesce(non_blank(F.col(f"prior_{field}")), *others).alias(field)

    def prior_or(field: str, default: Column | str | float) -> Column:
        return F.coalesce(F.col(f"prior_{field}"), F.lit(default) if not isinstance(
            default, Column) else default).alias(field)

    on = F.coalesce("repo_on", F.lit(False))
    seed = F.coalesce("first_user", "first_prose", "packet_id")
    return df.select(
        "packet_id", "session_id",
        F.lit(K.SCHEMA_VERSION).alias("schema_version"),
        first_of("title", derive_title(seed)),
        prior_or("status", "draft"),
        prior_or("validation_level", "draft"),
        prior_or("task_type", "generic"),
        first_of("objective", non_blank(F.col("first_user")), F.lit(K.DEFAULT_OBJECTIVE)),
        first_of("current_state", non_blank(F.col("last_prose")), non_blank(F.col("first_prose")),
                 F.lit(K.DEFAULT_STATE)),
        first_of("next_action", F.lit(K.DEFAULT_NEXT)),
        prior_or("confidence_score", 0.5),
        on.alias("attached"),
        F.when(on, F.coalesce("repo_root", F.lit(""))).alias("root"),
        F.when(on, "git").otherwise("none").alias("vcs"),
        *[F.when(on, F.col(f"repo_{f}")).alias(f) for f in REPO_FIELDS[1:]],
        (on & F.coalesce("repo_dirty", F.lit(False))).alias("dirty"),
        prior_or("created_at", now),
        now.alias("updated_at"),
    )


def base_branch(refs: DataFrame, explicit: DataFrame | None = None) -> DataFrame:
    """Base branch of each repository: explicit, else `main`, else `master`."""
    branch = refs.where("kind = 'branch'").groupBy("repo").agg(
        F.coalesce(
            F.max(F.when(F.col("ref") == "main", "main")),
            F.max(F.when(F.col("ref") == "master", "master")),
        ).alias("found")
    )
    repos = refs.select("repo").distinct().join(branch, "repo", "left")
    if explicit is None:
        return repos.select("repo", F.col("found").alias("base_branch"))
    return repos.join(explicit.select("repo", "base_branch"), "repo", "full_outer").select(
        "repo", F.coalesce(F.nullif("base_branch", F.lit("")), "found").alias("base_branch")
    )


def link_id(field: Column, artifact: Column, start: Column, end: Column) -> Column:
    span = F.when(
        start.isNotNull() & end.isNotNull(),
        F.concat(start.cast("string"), F.lit("-"), end.cast("string")),
    ).otherwise("whole")
    digest = F.sha2(F.concat_ws("|", field, artifact, span), 256)
    return F.concat(F.lit("pl-"), F.left(digest, F.lit(16)))


def provenance_links(packets: DataFrame, items: DataFrame, turns: DataFrame) -> DataFrame:
    """Links of the narrative fields and context items to the session artifact.

    `packets` has `packet_id, session_id, artifact_id` and the narrative. A
    narrative field gets the span of the first turn with the same trimmed text.
    Turns are first cut down to one row per session and text digest, so neither a
    long session nor a text repeated many times makes a hot join key.
    """
    fields = ["objective", "current_state", "next_action"]
    values = packets.select(
        "packet_id", "session_id", "artifact_id",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("pos"), F.lit(f).alias("field_name"), F.col(f).alias("value"))
            for i, f in enumerate(fields)
        ])),
    ).where(F.col("value") != "").select(
        "packet_id", "session_id", "artifact_id", "pos", "field_name",
        F.when(full_trim("value") != "", F.sha2(full_trim("value"), 256)).alias("digest"),
    )
    first = (
        turns.where(F.col("span_start").isNotNull() & F.col("span_end").isNotNull())
        .select("session_id", F.sha2(full_trim("text"), 256).alias("digest"), "ord", "span_start",
                "span_end")
        .groupBy("session_id", "digest")
        .agg(
            F.min(F.struct("ord", "span_start", "span_end")).alias("at"),
        )
    )
    narrative = values.join(first, ["session_id", "digest"], "left").select(
        "packet_id", "artifact_id", F.col("pos").cast("bigint").alias("pos"), "field_name",
        F.concat(F.lit("transcript:"), F.col("artifact_id")).alias("ref"),
        F.col("at.span_start").alias("span_start"), F.col("at.span_end").alias("span_end"),
    )
    of_items = items.join(packets.select("packet_id", "artifact_id"), "packet_id").select(
        "packet_id", "artifact_id", (F.col("pos") + len(fields)).alias("pos"),
        F.concat(F.lit("context_items["), F.col("pos").cast("string"), F.lit("]")).alias("field_name"),
        "ref", F.lit(None).cast("bigint").alias("span_start"),
        F.lit(None).cast("bigint").alias("span_end"),
    )
    return narrative.unionByName(of_items).select(
        "packet_id", "pos",
        link_id(F.col("field_name"), F.col("artifact_id"), F.col("span_start"), F.col("span_end"))
        .alias("id"),
        "field_name", "artifact_id", F.lit("transcript").alias("source_type"), "ref",
        "span_start", "span_end",
    )


def merge_links(carried: DataFrame, fresh: DataFrame) -> DataFrame:
    """Links of other artifacts are kept, links of the compiled artifact are
    replaced, and of equal ids within a packet the first one wins."""
    current = fresh.select("packet_id", "artifact_id").distinct()
    kept = carried.join(current, ["packet_id", "artifact_id"], "left_anti")
    cols = ["field_name", "artifact_id", "source_type", "ref", "span_start", "span_end"]
    both = kept.select("packet_id", "pos", "id", *cols, F.lit(0).alias("rank")).unionByName(
        fresh.select("packet_id", "pos", "id", *cols, F.lit(1).alias("rank"))
    )
    return both.groupBy("packet_id", "id").agg(
        F.min(F.struct("rank", "pos", *cols)).alias("x")
    ).select("packet_id", "id", *[F.col(f"x.{c}").alias(c) for c in cols])


def merge_artifacts(existing: DataFrame, fresh: DataFrame) -> DataFrame:
    """Append the source artifacts that a packet does not have yet."""
    added = fresh.dropDuplicates(["packet_id", "id"]).join(
        existing.select("packet_id", "id"), ["packet_id", "id"], "left_anti"
    )
    return existing.unionByName(added, allowMissingColumns=True)


def span_union(links: DataFrame, key: list[str]) -> DataFrame:
    """Smallest span that covers all valid spans of a key; null if there is none."""
    ok = (F.col("span_start").isNotNull() & F.col("span_end").isNotNull()
          & (F.col("span_end") >= F.col("span_start")))
    return links.groupBy(*key).agg(
        F.min(F.when(ok, F.col("span_start"))).alias("span_start"),
        F.max(F.when(ok, F.col("span_end"))).alias("span_end"),
    )


def last_transcripts(artifacts: DataFrame, packets: DataFrame) -> DataFrame:
    """Artifacts of each packet in numbers, and the transcript that is compiled.

    An artifact without a packet belongs to every packet. It is not paired with
    each of them: the artifacts without packet are reduced to one row that all
    packets look up. The latest transcript by `(ingested_at, artifact_id)` wins.
    """
    # Fixed-width text so that the order of the struct is the order of the pair.
    newest = F.max(
        F.when(F.col("kind") == "transcript", F.struct("ingested_at", "artifact_id"))
    ).alias("newest")
    shared = artifacts.where("packet_id IS NULL").agg(
        F.struct(F.count("*").alias("n"), newest).alias("s")
    )
    own = artifacts.where("packet_id IS NOT NULL").groupBy("packet_id").agg(
        F.count("*").alias("n_own"), newest
    )
    return (
        packets.select("packet_id")
        .join(own, "packet_id", "left")
        .withColumn("shared", shared.scalar())
        .select(
            "packet_id", F.coalesce("n_own", F.lit(0)).alias("n_own"),
            F.col("shared.n").alias("n_shared"),
            F.greatest("newest", F.col("shared.newest"))["artifact_id"].alias("transcript_id"),
        )
    )


def tail_turns(turns: DataFrame, n: int = K.TAIL_TURNS) -> DataFrame:
    """The last `n` turns of each session. Spark cuts every task down to `n`
    rows per session before the shuffle (window group limit)."""
    w = Window.partitionBy("session_id").orderBy(F.col("ord").desc())
    return turns.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tail_excerpt(turns: DataFrame, n: int = K.TAIL_TURNS) -> DataFrame:
    """`session_id, excerpt`: the last turns as `ROLE: text` blocks."""
    line = F.concat(F.upper("role"), F.lit(": "), F.col("text"))
    return tail_turns(turns, n).groupBy("session_id").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))),
                lambda x: x["line"],
            ),
            "\n\n",
        ).alias("excerpt")
    )
