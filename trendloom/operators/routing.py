"""Routing: which source profile a technology direction belongs to, and which providers serve it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trendloom.functions.text import collapse

# Signals of each profile (fixed values).
SIGNALS = {
    "software_ai": (
        "artificial intelligence", "ai", "machine learning", "deep learning", "large language model", "llm", "ai agent", "agentic", "software", "framework", "developer tool",
        "искусственный интеллект", "ии", "машинное обучение", "нейросет", "языковая модель", "ии агент", "агентн", "программ",
    ),
    "hardware_semiconductor": (
        "semiconductor", "chip", "processor", "accelerator", "neuromorphic", "photonic", "microelectronics", "compute hardware", "quantum processor",
        "полупровод", "чип", "процессор", "ускорител", "нейроморф", "фотоник", "микроэлектрон", "квантовый процессор",
    ),
    "materials_energy": (
        "material", "battery", "batteries", "solid-state battery", "solid-state batteries", "electrolyte", "lithium", "sodium ion", "hydrogen", "energy storage", "solar cell", "catalyst",
        "материал", "батар", "батареи", "аккумулятор", "твердотел", "электролит", "литий", "натрий", "водород", "накоплен", "солнечн", "катализ",
    ),
    "bio_medtech": (
        "biotech", "biotechnology", "medical", "medtech", "diagnostic", "therapy", "therapeutic", "genomic", "gene editing", "drug discovery", "protein",
        "био", "медицин", "диагност", "терап", "геном", "генн", "лекарств", "белок", "фарма",
    ),
}


def direction_key(x: Column) -> Column:
    return collapse(F.regexp_replace(x, "-", " "))


def signals(spark: SparkSession, table: dict[str, tuple[str, ...]] = SIGNALS) -> DataFrame:
    """profile, place, signal, needle, weight: a dimension of fixed size."""
    rows = [(p, i, s) for i, (p, found) in enumerate(table.items()) for s in found]
    df = spark.createDataFrame(rows, "profile string, place int, signal string")
    return df.select("*", direction_key(F.col("signal")).alias("needle"), F.least(F.lit(2.0), 1 + F.length("signal") / 24).alias("weight"))


def signal_hit(text: Column, needle: str) -> Column:
    """A needle of up to three characters must be a word; a longer one may be any part."""
    if len(needle) > 3:
        return F.contains(text, F.lit(needle))
    return F.contains(F.concat(F.lit(" "), F.regexp_replace(text, r"(?U)\W", " "), F.lit(" ")), F.lit(f" {needle} "))


def classify(directions: DataFrame, dimension: DataFrame, column: str = "direction") -> DataFrame:
    """directions with profile, confidence and matched signals. The two best profiles decide: none matches: mixed,
    0.25; the second is within 80 % of the first: mixed, 0.55; else the first. The signals, of fixed number, become
    literals of one projection, so directions are neither joined nor shuffled; a null direction is mixed."""
    signals_of: dict[tuple[int, str], list] = {}
    for r in dimension.orderBy("place", "signal").collect():
        signals_of.setdefault((r.place, r.profile), []).append(r)
    text = F.col("text_")
    profiles = []
    for (place, profile), table in signals_of.items():
        hits = [signal_hit(text, r.needle) for r in table]
        score = sum((F.when(h, r.weight).otherwise(0.0) for h, r in zip(hits, table)), F.lit(0.0))
        found = F.array_compact(F.array(*(F.when(h, r.signal) for h, r in zip(hits, table))))
        profiles.append(F.struct(score.alias("score"), F.lit(-place).alias("order"), F.lit(profile).alias("profile"), found.alias("found")))
    ranked = F.sort_array(F.filter(F.array(*profiles), lambda p: p["score"] > 0), asc=False)
    df = directions.withColumn("text_", direction_key(F.col(column))).withColumn("ranked_", ranked)
    first, second = F.get("ranked_", F.lit(0)), F.get("ranked_", F.lit(1))
    both = F.coalesce(second["score"] >= 0.8 * first["score"], F.lit(False))
    sure = F.round(F.least(F.lit(0.95), 0.55 + 0.12 * first["score"] + 0.06 * (first["score"] - F.coalesce(second["score"], F.lit(0.0)))), 3)
    found = F.when(both, F.array_union(first["found"], second["found"])).otherwise(F.coalesce(first["found"], F.array().cast("array<string>")))
    longest = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return df.select(
        *directions.columns,
        F.when(first.isNull() | both, "mixed").otherwise(first["profile"]).alias("profile"),
        F.when(first.isNull(), 0.25).when(both, 0.55).otherwise(sure).alias("confidence"),
        F.array_sort(found, longest).alias("matched"),
    )


def routes(policies: DataFrame, providers: DataFrame) -> DataFrame:
    """Provider routes of each profile by falling priority. A policy for an unknown provider raises an error."""
    joined = policies.join(providers, "provider", "left")
    known = F.when(F.col("evidence_type").isNull(), F.raise_error(F.concat(F.lit("unknown provider: "), F.col("provider")))).otherwise(F.col("evidence_type"))
    ready = F.coalesce("execution_status", F.lit("ready"))
    out = joined.select("profile", "provider", F.coalesce("enabled", F.lit(True)).alias("enabled"), F.coalesce("role", "default_role", F.lit("discovery")).alias("role"), known.alias("evidence_type"), "collection_priority", ready.alias("execution_status"))
    order = Window.partitionBy("profile").orderBy(F.desc("collection_priority"), "provider")
    return out.withColumns({"collectable": F.col("enabled") & (F.col("execution_status") == "ready"), "place": F.row_number().over(order)})


def match_case(cases: DataFrame, asked: str | None) -> DataFrame:
    """The first of cases (pos, id, label, aliases) that has the text asked for in its names, or whose id is in that
    text, in any case of letters; no row for a blank text."""
    needle = F.lit((asked or "").strip().lower())
    names = F.lower(F.concat_ws(" ", "id", "label", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " ")))
    return cases.where((needle != "") & (F.contains(names, needle) | F.contains(needle, F.lower("id")))).orderBy("pos").limit(1)
