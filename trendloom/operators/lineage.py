"""Git lineage over edge tables: commit_parents (repo, sha, parent_sha) and commit_files (repo, sha,
committed_at, filename, previous_filename, status, patch)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.operators import ancestry, gates
from trendloom.sources.shared import materialize


def descendants(parents: DataFrame, anchors: DataFrame, most: int = 10_000) -> DataFrame:
    """(repo, anchor_sha, sha, depth) of all commits below each anchor (repo, sha). A step is a join with the
    frontier; commits already reached are left out, so merges don't multiply paths. A step writes its frontier
    alone; every sixteen of them become one table. A history deeper than most raises an error."""
    frontier = anchors.select("repo", F.col("sha").alias("anchor_sha"), "sha", F.lit(0).alias("depth"))
    parts, depth = [frontier], 0
    while depth < most:
        depth += 1
        step = frontier.select("repo", "anchor_sha", F.col("sha").alias("parent_sha")).join(parents, ["repo", "parent_sha"]).select("repo", "anchor_sha", "sha").distinct()
        reached = reduce(DataFrame.union, parts)
        frontier = materialize(step.join(reached, ["repo", "anchor_sha", "sha"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        if frontier.isEmpty():
            return reached
        parts.append(frontier)
        if len(parts) > 16:
            parts = [materialize(reduce(DataFrame.union, parts), "reached")]
    raise ValueError("history is deeper than allowed")


def _below(below: DataFrame | ancestry.Labels, pairs: DataFrame) -> DataFrame:
    """repo, up, down, among them all pairs (repo, up, down) of which up is an ancestor of down."""
    if isinstance(below, ancestry.Labels):
        return ancestry.ahead(pairs, below)
    return below.where("depth > 0").select("repo", F.col("anchor_sha").alias("up"), F.col("sha").alias("down"))


def rename_chain(starts: DataFrame, files: DataFrame, below: DataFrame | ancestry.Labels, max_hops: int = 3) -> DataFrame:
    """starts (case_id, repo, anchor_sha, anchor_at, candidate_sha, candidate_at, path) with path as it is at the
    candidate, hops and reason. A hop is the earliest rename of the current path after the last one and before
    the candidate, on a commit below the last one (below: ``ancestry.labels``, or ``descendants`` of all commits) and above
    the candidate. More hops than max_hops leave the chain incomplete."""
    moved = files.where("status = 'renamed' and previous_filename is not null").select("repo", F.col("sha").alias("hop_sha"), F.col("committed_at").alias("hop_at"), F.col("previous_filename").alias("path"), F.col("filename").alias("to_path"))
    now = starts.select("*", F.col("anchor_sha").alias("at_sha"), F.col("anchor_at").alias("at_time"), F.lit(0).alias("hops"), F.lit(None).cast("string").alias("reason"))
    for _ in range(max_hops):
        hits = now.where("reason is null").join(moved, ["repo", "path"]).where("hop_at > at_time and hop_at < candidate_at")
        hits = materialize(hits.select("case_id", "repo", "at_sha", "candidate_sha", "hop_at", "hop_sha", "to_path"), "hits")
        ends = _below(below, hits.select("repo", F.col("at_sha").alias("up"), F.col("hop_sha").alias("down")).union(hits.select("repo", "hop_sha", "candidate_sha")))
        link = lambda up, down: ends.select("repo", F.col("up").alias(up), F.col("down").alias(down))
        hits = hits.join(link("at_sha", "hop_sha"), ["repo", "at_sha", "hop_sha"], "left_semi").join(link("hop_sha", "candidate_sha"), ["repo", "hop_sha", "candidate_sha"], "left_semi")
        first = hits.groupBy("case_id").agg(F.min(F.struct("hop_at", "hop_sha", "to_path")).alias("hop"))
        now = now.join(first, "case_id", "left")
        some = F.col("hop").isNotNull()
        now = materialize(
            now.select(
                *(c for c in starts.columns if c != "path"),
                F.when(some, F.col("hop.to_path")).otherwise(F.col("path")).alias("path"),
                F.when(some, F.col("hop.hop_sha")).otherwise(F.col("at_sha")).alias("at_sha"),
                F.when(some, F.col("hop.hop_at")).otherwise(F.col("at_time")).alias("at_time"),
                (F.col("hops") + some.cast("int")).alias("hops"),
                F.when(F.col("reason").isNull() & ~some, "no_more_verified_renames").otherwise(F.col("reason")).alias("reason"),
            ),
            "renames",
        )
    return now.withColumn("reason", F.coalesce("reason", F.lit("max_rename_hops_reached"))).drop("at_sha", "at_time")


def added_code(patch: Column) -> Column:
    """Added lines of a patch that aren't comments, whole."""
    added = F.filter(F.split(patch, "\n"), lambda x: x.startswith("+") & ~x.startswith("+++"))
    return F.filter(F.transform(added, lambda x: F.trim(F.substring(x, F.lit(2), F.length(x)))), lambda x: (x != "") & ~x.rlike(r"^(#|//|\*|/\*)"))


def verdicts(cases: DataFrame, files: DataFrame, below: DataFrame | ancestry.Labels) -> DataFrame:
    """cases (case_id, technology_direction, anchor_repo, anchor_sha, anchor_at, anchor_kind, anchor_title,
    anchor_text, anchor_diff, repo, sha, at, kind) with verdict and reason, in the order in which rules are
    tried: the candidate must be a later commit of the same repository below an anchor whose technology is
    verified, and change executable, technology-specific lines of one of its modules."""
    gate = gates.event_gate(cases.select("case_id", F.col("technology_direction").alias("direction"), F.col("anchor_title").alias("title"), F.coalesce("anchor_text", "anchor_title").alias("text"), F.col("anchor_diff").alias("source_diff"))).select("case_id", (F.col("status") == "eligible").alias("eligible"))
    df = cases.join(gate, "case_id").withColumn("paths", F.coalesce(gates.anchor_paths(F.col("anchor_diff")), F.array().cast("array<string>")))
    asked = cases.select(F.col("anchor_repo").alias("repo"), F.col("anchor_sha").alias("up"), F.col("sha").alias("down"))
    ahead = _below(below, asked).select(F.col("repo").alias("anchor_repo"), F.col("up").alias("anchor_sha"), F.col("down").alias("sha"), F.lit(True).alias("ahead"))
    df = df.join(ahead, ["anchor_repo", "anchor_sha", "sha"], "left")
    lora = F.lower("technology_direction").rlike("lora|low-rank")
    changed = files.select("repo", "sha", "filename", "previous_filename", F.col("status").alias("file_status"), added_code(F.col("patch")).alias("code"))
    each = df.join(changed, ["repo", "sha"])
    name = F.lower(F.element_at(F.split("filename", "/"), -1))
    named = F.when(lora, name.rlike("lora|peft|adapter")).otherwise(name.rlike("rag|retriev|vector|query"))
    spoken = F.exists("code", lambda x: F.when(lora, x.rlike("(?i)lora|peft|adapter")).otherwise(x.rlike("(?i)rag|retriev|vector|embedding|knowledge.graph")))
    own = F.array_contains("paths", F.col("filename")) | ((F.col("file_status") == "renamed") & F.array_contains("paths", F.col("previous_filename")))
    support = gates.module_file(F.col("filename")) & own & (F.size("code") > 0) & (named | spoken)
    found = each.groupBy("case_id").agg(F.max(F.coalesce(support, F.lit(False))).alias("support"))
    df = df.join(found, "case_id", "left")
    reason = (
        F.when(F.col("anchor_repo") != F.col("repo"), "cross_repository")
        .when((F.col("anchor_kind") != "commit") | (F.col("kind") != "commit"), "only_commit_ancestry_supported")
        .when(F.col("anchor_sha") == F.col("sha"), "same_commit_is_not_supporting_activity")
        .when(F.col("at") <= F.col("anchor_at"), "candidate_not_later_than_verified_anchor")
        .when(F.size("paths") == 0, "no_verified_anchor_source_paths")
        .when(~F.col("eligible"), "anchor_not_technology_verified")
        .when(F.col("ahead").isNull(), "not_confirmed_descendant")
        .when(F.col("support").isNull(), "missing_immutable_candidate_files")
        .when(~F.col("support"), "no_executable_changes_to_confirmed_module")
        .otherwise("confirmed_ancestor_and_same_module_source_change")
    )
    df = df.withColumn("reason", reason)
    review = F.col("reason").isin("no_verified_anchor_source_paths", "anchor_not_technology_verified", "missing_immutable_candidate_files")
    return df.select("case_id", F.when(F.col("reason") == "confirmed_ancestor_and_same_module_source_change", "supporting").when(review, "review_required").otherwise("rejected").alias("verdict"), "reason")
