"""Provider records as observations: works, repositories, git events, patents.

A record that lacks a required field raises an error when it is read; ``contract`` lists violations instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.functions import scalars, text

#: Evidence types of the contract (fixed values).
EVIDENCE_TYPES = ("research", "patent", "implementation", "product", "adoption", "investment", "regulation", "analysis", "other")
WORK = """id string, doi string, title string, display_name string, publication_date string, publication_year int, language string, cited_by_count long, is_retracted boolean,
  abstract_inverted_index map<string, array<int>>, primary_location struct<landing_page_url: string, license: string>, open_access struct<is_oa: boolean, oa_status: string>,
  authorships array<struct<author: struct<id: string, display_name: string>, institutions: array<struct<id: string, display_name: string, country_code: string>>>>,
  topics array<struct<id: string, display_name: string>>"""
ACTOR = "array<struct<name:string,kind:string,external_id:string,country:string>>"


def abstract(index: Column) -> Column:
    """The text of an inverted index: words by position."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " ")


def short_id(x: Column) -> Column:
    return F.element_at(F.split(F.rtrim(x, F.lit("/")), "/"), -1)


def distinct_by(rows: Column, key) -> Column:
    """The first element of each key."""
    keys = F.transform(rows, key)
    return F.filter(rows, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def work_actors(authorships: Column, most: int = 20) -> Column:
    """Authors, then institutions, each distinct by id or name, most of each."""
    empty = F.lit(None).cast("string")
    person = F.transform(authorships, lambda a: F.struct(a["author"]["display_name"].alias("name"), F.lit("person").alias("kind"), short_id(a["author"]["id"]).alias("external_id"), empty.alias("country")))
    place = F.flatten(F.transform(authorships, lambda a: F.transform(a["institutions"], lambda i: F.struct(i["display_name"].alias("name"), F.lit("institution").alias("kind"), short_id(i["id"]).alias("external_id"), i["country_code"].alias("country")))))
    key = lambda x: F.coalesce(x["external_id"], F.lower(x["name"]))
    named = lambda rows: F.filter(rows, lambda x: F.coalesce(F.trim(x["name"]), F.lit("")) != "")
    return F.concat(F.slice(distinct_by(named(person), key), 1, most), F.slice(distinct_by(named(place), key), 1, most)).cast(ACTOR)


def work_observations(works: DataFrame, observed_at: str, direction: str = "", query_id: str = "") -> DataFrame:
    """Research works (schema WORK); the DOI is the canonical address if there is one, and a work without a date
    is dated by its year's first day."""
    day = F.coalesce(F.col("publication_date"), F.make_date(F.col("publication_year"), F.lit(1), F.lit(1)).cast("string"))
    metrics = scalars.without_nulls(F.create_map(F.lit("cited_by_count"), F.col("cited_by_count").cast("string"), F.lit("is_oa"), F.col("open_access.is_oa").cast("string"), F.lit("is_retracted"), F.col("is_retracted").cast("string")))
    doi = text.normalise_doi(F.col("doi"))
    return works.select(
        F.lit("0.2.0").alias("schema_version"),
        F.concat(F.lit("openalex:"), short_id(scalars.required(F.col("id"), "id"))).alias("observation_id"),
        F.lit("openalex").alias("provider"), F.lit("research").alias("evidence_type"), F.lit("paper").alias("artifact_kind"),
        short_id(F.col("id")).alias("external_id"),
        F.coalesce(scalars.non_empty(F.col("title")), scalars.non_empty(F.col("display_name"))).alias("title"),
        F.coalesce(F.concat(F.lit("https://doi.org/"), doi), F.col("primary_location.landing_page_url"), F.col("id")).alias("canonical_url"),
        abstract(F.col("abstract_inverted_index")).alias("text"), "language", day.alias("published_at"), F.lit(observed_at).alias("observed_at"),
        work_actors(F.col("authorships")).alias("actors"),
        F.transform(F.slice("topics", 1, 10), lambda t: t["display_name"]).alias("source_topics"),
        metrics.alias("metrics"), F.struct(F.lit(direction).alias("technology_direction"), F.lit(query_id).alias("query_id")).alias("collection_context"),
    )


def repository_observations(repos: DataFrame, observed_at: str) -> DataFrame:
    """Repositories (full_name, html_url, description, language, topics, stargazers_count, forks_count, fork,
    archived, license, page, pos). A repository is counted once, where it first comes, before forks and archived
    ones go. What it says of itself today dates nothing, so published_at is null."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("full_name").orderBy("page", "pos"))
    kept = repos.withColumn("rn_", first).where("rn_ = 1 and not coalesce(fork, false) and not coalesce(archived, false)")
    count = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).try_cast("int"), F.lit(0))).cast("string")
    return kept.select(
        F.concat(F.lit("github:"), "full_name").alias("observation_id"), F.lit("github").alias("provider"), F.lit("implementation").alias("evidence_type"), F.lit("repository").alias("artifact_kind"),
        F.col("full_name").alias("external_id"), F.col("full_name").alias("title"), F.col("html_url").alias("canonical_url"), F.col("description").alias("text"), "language",
        F.lit(None).cast("string").alias("published_at"), F.lit(observed_at).alias("observed_at"), F.array_distinct("topics").alias("source_topics"),
        F.create_map(F.lit("stars"), count("stargazers_count"), F.lit("forks"), count("forks_count")).alias("metrics"), F.nullif("license", F.lit("NOASSERTION")).alias("license"),
    )


def git_events(commits: DataFrame, releases: DataFrame, terms: Column, most: int = 24, patches: DataFrame | None = None, most_patches: int = 6) -> DataFrame:
    """The earliest dated events of each repository that match terms (an array): commits (repo, sha, message,
    committed_at, authored_at), releases (repo, release_id, name, tag, body, published_at, html_url, draft). Tags
    have no date of their own and give none. The first most_patches commits get their patch's text."""
    from pyspark.sql import Window

    c = commits.select("repo", F.lit("commit").alias("kind"), F.col("sha").alias("event_id"), F.coalesce("committed_at", "authored_at").alias("occurred_at"), text.first_line(F.col("message")).alias("title"), F.col("message").alias("body"))
    r = releases.where("not coalesce(draft, false) and published_at is not null and html_url is not null and release_id is not null").select("repo", F.lit("release").alias("kind"), F.col("release_id").cast("string").alias("event_id"), F.col("published_at").alias("occurred_at"), F.coalesce("name", "tag").alias("title"), F.concat_ws(" ", "name", "tag", "body").alias("body"))
    hit = F.exists(terms, lambda t: F.contains(F.lower("body"), F.lower(t)))
    # of rows that name one event, the last by time and text counts, in every run
    last = F.max(F.struct("occurred_at", "title", "body")).alias("e")
    each = c.unionByName(r).where(hit).groupBy("repo", "kind", "event_id").agg(last).select("repo", "kind", "event_id", "e.*")
    order = Window.partitionBy("repo").orderBy("occurred_at", "kind", "event_id")
    pool = each.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    if patches is None:
        return pool
    nth = F.count_if(F.col("kind") == "commit").over(order.rowsBetween(Window.unboundedPreceding, 0))
    pool = pool.withColumn("nth_", nth)
    return pool.join(patches.select("repo", F.col("sha").alias("event_id"), "source_diff"), ["repo", "event_id"], "left").withColumn("source_diff", F.when((F.col("kind") == "commit") & (F.col("nth_") <= most_patches), F.col("source_diff"))).drop("nth_")


def earliest_events(pool: DataFrame) -> DataFrame:
    return pool.groupBy("repo").agg(F.min(F.struct("occurred_at", "kind", "event_id", "title")).alias("e")).select("repo", "e.*")


def event_observations(events: DataFrame, direction: str, profile: str, query_id: str, observed_at: str) -> DataFrame:
    """Observations of verified dated events (repo, kind, event_id, occurred_at, title, body, matched_terms), each
    linked to its repository."""
    name = F.concat("repo", F.lit(":"), "kind", F.lit(":"), "event_id")
    owner = F.substring_index("repo", "/", 1)
    return events.select(
        F.concat(F.lit("github:"), name).alias("observation_id"), F.lit("github").alias("provider"), F.lit("implementation").alias("evidence_type"), F.col("kind").alias("artifact_kind"), name.alias("external_id"),
        "title", F.coalesce(F.nullif("body", F.lit("")), "title").alias("text"), F.col("occurred_at").alias("published_at"), F.lit(observed_at).alias("observed_at"), F.lit("en").alias("language"),
        F.array(F.struct(owner.alias("name"), F.lit("organization").alias("kind"), owner.alias("external_id"), F.lit(None).cast("string").alias("country"))).alias("actors"),
        F.array_distinct(F.concat(F.array(F.lit(direction)), "matched_terms")).alias("source_topics"),
        F.array(F.struct(F.lit("belongs_to_repository").alias("type"), F.concat(F.lit("github:"), "repo").alias("target_id"))).alias("relationships"),
        F.struct(F.lit(True).alias("historical_timestamp_verified"), F.lit(False).alias("mutable_repository_metadata_used_for_timestamp")).alias("quality_flags"),
        F.struct(F.lit(direction).alias("technology_direction"), F.lit(profile).alias("source_profile"), F.lit(query_id).alias("query_id"), F.col("matched_terms")).alias("collection_context"),
    )


def patent_observations(pages: DataFrame, column: str = "xml", observed_at: str = "") -> DataFrame:
    """Patents of XML documents, one a row. Documents over 3 MB, or with a DOCTYPE or ENTITY, are left out before
    any is parsed. English titles and abstracts come first; applicants are distinct."""
    safe = pages.where((F.octet_length(column) <= 3_000_000) & ~F.col(column).rlike("(?i)<!(DOCTYPE|ENTITY)"))
    x = lambda path: F.xpath_string(column, F.lit(path))
    first = lambda *paths: F.coalesce(*(F.nullif(F.trim(x(p)), F.lit("")) for p in paths))
    doc = "//*[local-name()='exchange-document']"
    number = F.concat(x(f"{doc}/@country"), x(f"{doc}/@doc-number"), x(f"{doc}/@kind"))
    stated = first(f"{doc}//*[local-name()='publication-reference']//*[local-name()='date'][1]")
    day = F.try_to_timestamp(F.when(stated.rlike("^[0-9]{8}$"), stated), F.lit("yyyyMMdd")).cast("date").cast("string")
    names = F.xpath(column, F.lit(f"{doc}//*[local-name()='applicant']//*[local-name()='name']/text()"))
    distinct = F.array_distinct(F.filter(F.transform(names, lambda n: F.trim(n)), lambda n: n != ""))
    codes = F.array_distinct(F.transform(F.xpath(column, F.lit(f"{doc}//*[local-name()='classification-ipcr']/*[local-name()='text']/text()")), lambda n: F.regexp_replace(F.trim(n), r"\s+", " ")))
    return safe.where(number != "").select(
        F.concat(F.lit("epo_ops:"), number).alias("observation_id"), F.lit("epo_ops").alias("provider"), F.lit("patent").alias("evidence_type"), F.lit("patent").alias("artifact_kind"), number.alias("external_id"),
        first(f"{doc}//*[local-name()='invention-title'][@lang='en']", f"{doc}//*[local-name()='invention-title']").alias("title"),
        first(f"{doc}//*[local-name()='abstract'][@lang='en']", f"{doc}//*[local-name()='abstract']").alias("text"),
        F.lit(None).cast("string").alias("canonical_url"), day.alias("published_at"), F.lit(observed_at).alias("observed_at"), distinct.alias("applicants"), codes.alias("classifications"),
    )


def contract(observations: DataFrame) -> DataFrame:
    """observation_id and violations of each row that breaks the observation contract."""
    blank = lambda c: F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
    rules = [(f"{c} is required", blank(c)) for c in ("observation_id", "provider", "evidence_type", "artifact_kind", "external_id", "title", "observed_at")]
    rules += [
        ("evidence_type is unknown", ~F.col("evidence_type").isin(*EVIDENCE_TYPES)),
        ("observation_id is too short", F.length("observation_id") < 3),
        ("observed_at is no time", F.col("observed_at").isNotNull() & scalars.canonical_time(F.col("observed_at")).isNull()),
        ("published_at is no time", F.col("published_at").isNotNull() & scalars.canonical_time(F.col("published_at")).isNull()),
    ]
    found = F.array_compact(F.array(*(F.when(cond, name) for name, cond in rules)))
    return observations.select("observation_id", found.alias("violations")).where(F.size("violations") > 0)


def narrative_check(responses: DataFrame) -> DataFrame:
    """responses (trend_id, content, allowed_refs) with ok and problem: a JSON object of strings whose fields are
    filled and whose source_refs are all allowed."""
    shape = "problem string, advantage string, description string, name string, case_example string, limitations string, source_refs array<string>"
    df = responses.withColumn("n", F.from_json("content", shape))
    empty = F.lit(False)
    for f in ("problem", "advantage", "description", "name", "case_example", "limitations"):
        empty = empty | (F.coalesce(F.trim(F.col(f"n.{f}")), F.lit("")) == "")
    unknown = F.size(F.array_except(F.coalesce("n.source_refs", F.array().cast("array<string>")), "allowed_refs")) > 0
    problem = F.when(F.col("n").isNull(), "no JSON object").when(empty, "a field is empty").when(F.size("n.source_refs") < 1, "no source").when(unknown, "unknown source")
    return df.select("trend_id", problem.isNull().alias("ok"), problem.alias("problem"))
