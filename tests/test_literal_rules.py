"""Rules on literal rows, with results worked out apart from the engine."""

from pyspark.sql import functions as F

from trendloom.functions import text
from trendloom.operators import lineage, routing


def test_keys_of_observations(spark):
    """Full width, sharp s, ligatures, final sigma, mixed case in ids; expected by hashlib and unicodedata."""
    rows = [(1, "ＡＩ Agents for Straßenbau", "Big_data-sets", "Ada  Löwe", " ORCID:0000-Ä "), (2, "ai agents for STRASSENBAU", "big data sets", "ＡＤＡ löwe", ""), (3, "Ünïcode ﬁne-tuning of LLMs №5", None, "  ", None), (4, "a", "", None, "X-ẞ"), (5, "ΣΊΣΥΦΟΣ and σίσυφος", None, "Jean_Luc  D'Or", None)]
    d = spark.createDataFrame(rows, "id int, title string, body string, name string, external_id string")
    simhash = F.lower(F.lpad(F.hex(text.simhash(text.blake2b_longs(text.token_set(F.col("title"))))), 16, "0"))
    actors = F.array_join(text.actor_keys(F.array(F.struct("name", "external_id"))), "|")
    got = d.select("id", text.content_hash(F.col("title"), F.col("body")), simhash, actors).orderBy("id").collect()
    same = "83de6a5c87dc8e464bd37baad317a4a19e01fc7f79ff58e39e4d57649b220248"
    assert [tuple(r) for r in got] == [
        (1, same, "3df9df77ffc28a2f", "id:orcid:0000-ä"), (2, same, "3df9df77ffc28a2f", "name:ada löwe"), (3, "a8f5b579517af1fbea813ce15b7e47852f3e2007b8ce69149d288cc1aa9c8c35", "bb1fe7c2e767fafb", ""),
        (4, "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb", "40f89e395b66422f", "id:x-ss"), (5, "d93c58ebb035b2314d3dd7a16137dc9a201e21e5e40fb373d2fb0f6a927371e5", "ffff5efbd5a7df37", "name:jean luc d or"),
    ]


def test_router_on_named_directions(spark):
    rows = [(1, "AI agent framework"), (2, "solid-state battery electrolyte"), (3, "gene editing therapy"), (4, "quantum processor chip"), (5, "maintenance of bridges"), (6, "AI drug discovery protein software"), (7, "ИИ агент")]
    d = routing.classify(spark.createDataFrame(rows, "id int, direction string"), routing.signals(spark))
    assert [(r.profile, r.confidence, "|".join(r.matched)) for r in d.orderBy("id").collect()] == [
        ("software_ai", 0.95, "framework|ai agent|ai"), ("materials_energy", 0.95, "solid-state battery|electrolyte|battery"), ("bio_medtech", 0.95, "gene editing|therapy"), ("hardware_semiconductor", 0.95, "quantum processor|processor|chip"),
        ("mixed", 0.25, ""), ("mixed", 0.55, "drug discovery|software|protein|ai"), ("software_ai", 0.95, "ии агент|ии"),
    ]


def test_renames_follow_the_branch_of_the_case(spark):
    parents = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b"), ("r", "d", "c"), ("r", "x", "a"), ("r", "e", "d")], "repo string, sha string, parent_sha string")
    rows = [("r", "b", 2, "m2.py", "m1.py", "renamed"), ("r", "x", 3, "z.py", "m2.py", "renamed"), ("r", "c", 3, "m3.py", "m2.py", "renamed"), ("r", "e", 5, "m3.py", None, "modified")]
    files = spark.createDataFrame(rows, "repo string, sha string, committed_at int, filename string, previous_filename string, status string")
    cases = [(1, "r", "a", 1, "e", 5, "m1.py"), (2, "r", "c", 3, "e", 5, "m3.py"), (3, "r", "a", 1, "x", 9, "m1.py")]
    starts = spark.createDataFrame(cases, "case_id int, repo string, anchor_sha string, anchor_at int, candidate_sha string, candidate_at int, path string")
    nodes = parents.select("repo", "sha").union(parents.select("repo", "parent_sha")).distinct()
    got = lineage.rename_chain(starts, files, lineage.descendants(parents, nodes)).orderBy("case_id").collect()
    assert [(r.path, r.hops, r.reason) for r in got] == [("m3.py", 2, "no_more_verified_renames"), ("m3.py", 0, "no_more_verified_renames"), ("m1.py", 0, "no_more_verified_renames")]


def test_verdicts_on_supporting_changes(spark):
    """Modules in Java aren't followed, and an anchor that changes nothing but docs has none."""
    parents = spark.createDataFrame([("r", "b", "a"), ("r", "c", "b"), ("r", "x", "z")], "repo string, sha string, parent_sha string")
    below = lineage.descendants(parents, parents.select("repo", F.col("parent_sha").alias("sha")).distinct())
    patch = "+class LoraLayer:\n+    pass"
    changed = [("b", "peft/lora.py"), ("b", "peft/Lora.java"), ("c", "docs/lora.md"), ("x", "peft/lora.py")]
    files = spark.createDataFrame([("r", sha, name, None, "modified", patch) for sha, name in changed], "repo string, sha string, filename string, previous_filename string, status string, patch string")
    diff = "FILE peft/lora.py\n+class LoraConfig:"
    base = ("Low-rank adaptation for language models", "r", "a", 1, "commit", "Add LoRA fine-tuning for LLM adapters", None)
    ends = [(diff, "r", "b", 2), (diff, "r", "c", 3), (diff, "r", "x", 3), (diff, "q", "b", 2), (diff, "r", "b", 1), (diff, "r", "a", 2), (None, "r", "b", 2)]
    ends += [("FILE peft/Lora.java\n+class LoraConfig:\nFILE peft/other.py\n+x", "r", "b", 2), ("FILE docs/lora.py\n+class LoraConfig:", "r", "b", 2)]
    shape = "case_id int, technology_direction string, anchor_repo string, anchor_sha string, anchor_at int, anchor_kind string, anchor_title string, anchor_text string, anchor_diff string, repo string, sha string, at int, kind string"
    cases = spark.createDataFrame([(i, *base, *end, "commit") for i, end in enumerate(ends, 1)], shape)
    assert [(r.verdict, r.reason) for r in lineage.verdicts(cases, files, below).orderBy("case_id").collect()] == [
        ("supporting", "confirmed_ancestor_and_same_module_source_change"), ("rejected", "no_executable_changes_to_confirmed_module"), ("rejected", "not_confirmed_descendant"), ("rejected", "cross_repository"),
        ("rejected", "candidate_not_later_than_verified_anchor"), ("rejected", "same_commit_is_not_supporting_activity"), ("review_required", "no_verified_anchor_source_paths"),
        ("rejected", "no_executable_changes_to_confirmed_module"), ("review_required", "no_verified_anchor_source_paths"),
    ]
