"""From patents, assignees and papers to seed flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citegrain.functions import values

YOUNG_SCORE, YOUNG_YEARS = 8.0, 3


def linkage(assignees: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every assignee of a patent with every paper of it: many to many."""
    keyed = pairs.withColumn("us_patent_id", F.regexp_replace("patent", "^US-", ""))
    return assignees.join(keyed, assignees["patent_id"] == keyed["us_patent_id"])


def first_match(left: DataFrame, right: DataFrame, key: str, order: list[str], flag: str) -> DataFrame:
    """left with the columns of the first row of right that has its key, and whether there is one."""
    others = [c for c in right.columns if c != key]
    first = right.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__first")).select(key, "__first.*")
    return left.join(first.withColumn(flag, F.lit(True)), key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def all_matches(left: DataFrame, right: DataFrame, key: str, columns: list[str], name: str, flag: str) -> DataFrame:
    """left with all rows of right that have its key as a sorted array; the flag is null where the key is."""
    many = right.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    return left.join(many, key, "left").withColumn(flag, F.when(F.col(key).isNotNull(), F.col(name).isNotNull()))


def university_flags(rows: DataFrame) -> DataFrame:
    """(assignee_id, university, conflict) of each assignee."""
    flag = values.is_one(F.col("university"))
    return rows.groupBy("assignee_id").agg(F.bool_or(flag).alias("university"), (F.min(flag) != F.max(flag)).alias("conflict"))


def seed_index(triplets: DataFrame, universities: DataFrame) -> DataFrame:
    """(paperid, corporate, university, candidates): corporate and university if any link is, and the
    distinct young-firm candidates (days, founding year) of the links."""
    known = university_flags(universities).select("assignee_id", F.col("university").alias("flagged"))
    score = F.col("founding_score").cast("double")
    rows = triplets.join(known, "assignee_id", "left")
    corporate = values.is_zero(F.col("univ_hospital_gov"))
    candidate = F.when(corporate & (score >= YOUNG_SCORE), F.struct(F.col("daysdiffcont").alias("days"), F.col("founding_year").alias("founded")))
    return rows.groupBy("paperid").agg(
        F.bool_or(corporate).alias("corporate"),
        F.bool_or(F.coalesce(F.col("flagged"), F.lit(False)) & values.is_one(F.col("univ_hospital_gov"))).alias("university"),
        F.array_sort(F.collect_set(candidate)).alias("candidates"),
    )


def young(candidates: Column, published: Column) -> Column:
    """Whether a candidate firm was founded up to three years before the application."""
    age = lambda c: F.year(F.date_add(published, c["days"])) - c["founded"]
    return F.coalesce(F.exists(candidates, lambda c: (age(c) >= 0) & (age(c) <= YOUNG_YEARS)), F.lit(False))


def seed_flags(index: DataFrame, papers: DataFrame) -> DataFrame:
    """(id, all_assignees, corporate, young_firm, young_firm_university) of each linked paper; one
    without a known date is in no young firm's set."""
    dated = index.join(papers.select(F.col("id").alias("paperid"), "publication_date"), "paperid", "left")
    is_young = young(F.col("candidates"), F.col("publication_date"))
    return dated.select(
        F.col("paperid").alias("id"), F.lit(True).alias("all_assignees"), "corporate", is_young.alias("young_firm"), (is_young | F.col("university")).alias("young_firm_university")
    )


def sparse(flag: Column) -> Column:
    """True or absent, never false."""
    return F.nullif(flag, F.lit(False))
