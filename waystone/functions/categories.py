"""Column functions on categories, states and maps (CAT-01 to CAT-06, MAP-01, MAP-02)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (tag, pattern): a place gets all tags whose patterns its category matches.
TAG_RULES = (("bulk", "LARGE|ECONOMY"), ("compact", "SMALL"), ("offer", "PROMO|ECONOMY"), ("standard", "STANDARD"))
#: (genre, pattern).
GENRES = (("heavy", "LARGE|MEDIUM"), ("light", "SMALL"), ("plain", "STANDARD|PROMO|MEDIUM"))
#: (pattern, minutes), the first that matches counts.
STAY = (("PROMO", 90), ("LARGE|ECONOMY", 60), ("MEDIUM", 45), ("SMALL", 20))


def tags(category: Column, rules=TAG_RULES) -> Column:
    """CAT-01: all tags in the order of the rules; `unusual` if none applies."""
    found = F.array_compact(F.array(*[F.when(F.rlike(category, F.lit(p)), t) for t, p in rules]))
    return F.when(F.size(found) == 0, F.array(F.lit("unusual"))).otherwise(F.array_distinct(found))


def genres(places: DataFrame, category: Column, rules=GENRES) -> DataFrame:
    """CAT-02: a row for each place and genre that it belongs to."""
    names = F.array_compact(F.array(*[F.when(F.rlike(category, F.lit(p)), g) for g, p in rules]))
    return places.withColumn("genre", F.explode(names))


def food_match(a: Column, b: Column, pattern: str) -> Column:
    """CAT-03: any entry of two arrays matches."""
    return F.exists(F.array_union(a, b), lambda x: F.rlike(x, F.lit(pattern)))


def stay_minutes(category: Column, rules=STAY, other: int = 30) -> Column:
    """CAT-04: minutes of the first rule that matches."""
    return F.coalesce(*[F.when(F.rlike(category, F.lit(p)), m) for p, m in rules], F.lit(other)).cast("int")


def keywords(c: Column, include: list[str], block: list[str]) -> Column:
    """CAT-05: some include word and no block word."""
    return F.rlike(c, F.lit("|".join(include))) & ~F.rlike(c, F.lit("|".join(block)))


def next_action(candidates: Column, checked: Column, accepted: Column, failed: Column) -> Column:
    """CAT-06: the first rule that applies."""
    return F.when(failed > 0, "retry_fetch").when(candidates == 0, "check_listing").when(accepted > 0, "none").when(checked < candidates, "inspect_candidates").otherwise("watch")


def merged_counts(rows: DataFrame, key: str, counts: str) -> DataFrame:
    """MAP-01: maps of counts summed key by key; keys that are null everywhere do not appear."""
    return rows.select(key, F.explode(counts).alias("reason", "n")).filter("n is not null").groupBy(key, "reason").agg(F.sum("n").alias("n"))


def safe_count(c: Column) -> Column:
    """MAP-02: a whole number of zero or more; anything else is 0."""
    return F.greatest(F.lit(0), F.coalesce(c.try_cast("int"), F.lit(0)))
