"""Roll-ups of paper scores to venues, years and fields. Rows: one per paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_article(kind: str = "type") -> Column:
    return F.lower(F.coalesce(F.col(kind), F.lit(""))) == "article"


def _depths(depths: list[int], digits: int) -> tuple[list[Column], list[Column]]:
    sums = [F.count_if(F.col("hop") <= d).alias(f"reachable_papers_d{d}") for d in depths]
    more = [c for d in depths for c in ((F.col("total_papers") - F.col(f"reachable_papers_d{d}")).alias(f"unreachable_papers_d{d}"), F.round(F.col(f"reachable_papers_d{d}") / F.col("total_papers"), digits).alias(f"reachability_rate_d{d}"))]
    return sums, more


def venue_reachability(papers: DataFrame, depths: list[int], min_papers: int = 1, article_only: bool = False) -> DataFrame:
    """Per source_id of papers (source_id, source_name, source_type, type, hop): how many are reached,
    at what distance, within which depths. The median interpolates."""
    depths = sorted({d for d in depths if d >= 0})
    rows = papers.where(F.col("source_id").isNotNull())
    rows = rows.where(is_article()) if article_only else rows
    sums, more = _depths(depths, 4)
    out = rows.groupBy("source_id").agg(
        F.max("source_name").alias("source_name"),
        F.max("source_type").alias("source_type"),
        F.count("*").alias("total_papers"),
        F.count_if(F.col("source_type") == "j").alias("journal_papers"),
        F.count_if(F.col("source_type") == "c").alias("conference_papers"),
        F.count("hop").alias("reachable_papers"),
        F.avg("hop").alias("avg_hops"),
        F.percentile("hop", 0.5).alias("median_hops"),
        *sums,
    )
    out = out.where(F.col("total_papers") >= min_papers)
    return out.select(
        "source_id", "source_name", "source_type", "total_papers", "journal_papers", "conference_papers", "reachable_papers",
        (F.col("total_papers") - F.col("reachable_papers")).alias("unreachable_papers"),
        F.round(F.col("reachable_papers") / F.col("total_papers"), 4).alias("reachability_rate"),
        F.round("avg_hops", 2).alias("avg_min_hops"),
        F.round("median_hops", 2).alias("median_min_hops"),
        *[f"reachable_papers_d{d}" for d in depths],
        *more,
    )


def venue_scores(papers: DataFrame, scores: list[str], scopes: tuple[str, ...] = ("all", "articles"), min_papers: int = 1) -> DataFrame:
    """Several scores in several scopes in one scan, long: (source_id, scope, score, total_papers,
    scored_papers, total_score, avg_score_all). An unscored paper counts as 0 in the average."""
    if not scores or not set(scopes) <= {"all", "articles"}:
        raise ValueError("scores and known scopes are needed")
    inside = {"all": F.lit(True), "articles": is_article()}
    aggs = [F.max("source_type").alias("source_type")]
    for scope in scopes:
        aggs.append(F.count_if(inside[scope]).alias(f"{scope}_papers"))
        for k in scores:
            aggs += [F.count_if(inside[scope] & F.col(k).isNotNull()).alias(f"{scope}_n_{k}"), F.sum(F.when(inside[scope], F.coalesce(F.col(k), F.lit(0.0))).otherwise(0.0)).alias(f"{scope}_sum_{k}")]
    rows = papers.where(F.col("source_id").isNotNull())
    rows = rows.where(is_article()) if scopes == ("articles",) else rows
    wide = rows.groupBy("source_id").agg(*aggs)
    parts = [F.struct(F.lit(scope).alias("scope"), F.lit(k).alias("score"), F.col(f"{scope}_papers").alias("total_papers"), F.col(f"{scope}_n_{k}").alias("scored_papers"), F.col(f"{scope}_sum_{k}").alias("sum")) for scope in scopes for k in scores]
    long = wide.select("source_id", "source_type", F.inline(F.array(*parts))).where(F.col("total_papers") >= min_papers)
    return long.select("source_id", "source_type", "scope", "score", "total_papers", "scored_papers", F.round("sum", 6).alias("total_score"), F.round(F.col("sum") / F.col("total_papers"), 6).alias("avg_score_all"))


def year_rollup(papers: DataFrame, depths: list[int], min_papers: int = 1, article_only: bool = False, target: str = "both") -> DataFrame:
    """Per publication_year: reachability and scores of papers (hop, score)."""
    depths = sorted({d for d in depths if d >= 0})
    rows = papers.where(F.col("publication_year").isNotNull())
    rows = rows.where(is_article()) if article_only else rows
    sums, more = _depths(depths, 6)
    filled = F.coalesce(F.col("score"), F.lit(0.0))
    out = rows.groupBy("publication_year").agg(
        F.count("*").alias("total_papers"), F.count("hop").alias("reachable_papers"), F.avg("hop").alias("a"), F.percentile("hop", 0.5).alias("m"),
        F.count("score").alias("scored_papers"), F.sum(filled).alias("t"), F.avg(filled).alias("all"), F.avg("score").alias("own"), *sums,
    ).where(F.col("total_papers") >= min_papers)
    base = ["publication_year", "total_papers"]
    reach = ["reachable_papers", (F.col("total_papers") - F.col("reachable_papers")).alias("unreachable_papers"), F.round(F.col("reachable_papers") / F.col("total_papers"), 6).alias("reachability_rate"), F.round("a", 6).alias("avg_min_hops"), F.round("m", 6).alias("median_min_hops"), *[f"reachable_papers_d{d}" for d in depths], *more]
    score = ["scored_papers", F.round("t", 6).alias("par_total_score"), F.round("all", 6).alias("par_avg_score_all"), F.round("own", 6).alias("par_avg_score_scored")]
    return out.select(*base, *(reach if target in ("both", "reachability") else []), *(score if target in ("both", "par") else []))


def h_index(papers: DataFrame, cites: str = "cited_by_count") -> DataFrame:
    """(source_id, h): the most papers with at least as many citations each; counts, not papers, are ranked."""
    counts = papers.where(F.col("source_id").isNotNull()).groupBy("source_id", F.col(cites).alias("c")).agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy("source_id").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("above", above).groupBy("source_id").agg(F.max(F.least("c", "above")).alias("h"))


def venue_years(papers: DataFrame) -> DataFrame:
    y = F.col("publication_year")
    return papers.where(F.col("source_id").isNotNull() & y.isNotNull()).groupBy("source_id").agg(
        F.count("*").alias("n_yr"), F.min(y).alias("first_year"), F.percentile(y, 0.05).alias("p05_year"), F.avg(y).alias("mean_year"), F.percentile(y, 0.5).alias("median_year"), F.max(y).alias("last_year")
    )


def field_counts(topics: DataFrame) -> DataFrame:
    """(source_id, field, n, place) from topics (source_id, field, n, place): counts summed by field,
    each field at the place of its first topic."""
    rows = topics.where(F.col("field").isNotNull())
    return rows.groupBy("source_id", "field").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.min("place").alias("place"))


def primary_field(counts: DataFrame) -> DataFrame:
    """The field with the highest count, the first one of equals."""
    order = F.struct(F.col("n"), -F.col("place"))
    return counts.groupBy("source_id").agg(F.max_by("field", order).alias("primary_field"), F.max("n").alias("n"), F.sum("n").alias("all"))


def field_shares(counts: DataFrame, fields: list[int]) -> DataFrame:
    """fs_<field> of each source, 0 where it has none."""
    wide = counts.groupBy("source_id").agg(F.sum("n").alias("__all"), *[F.sum(F.when(F.col("field") == f, F.col("n")).otherwise(0)).alias(f"__{f}") for f in fields])
    return wide.select("source_id", *[(F.col(f"__{f}") / F.col("__all")).alias(f"fs_{f}") for f in fields])


def field_venues(papers: DataFrame, score: str, top: int, min_papers: int) -> DataFrame:
    """Sums by field and source over the papers with the highest scores."""
    best = papers.where(F.col(score).isNotNull()).orderBy(F.desc(score), "wid").limit(top)
    return best.groupBy("field", "source_id").agg(F.count("*").alias("papers"), F.sum(score).alias("total")).where(F.col("papers") >= min_papers)


def field_venues_normalised(papers: DataFrame, score: str, min_papers: int) -> DataFrame:
    out = papers.groupBy("field", "source_id").agg(F.count("*").alias("papers"), F.sum(F.coalesce(F.col(score), F.lit(0.0))).alias("total"), F.max("type").alias("type"))
    return out.where(F.col("papers") >= min_papers).withColumn("score_norm", F.col("total") / F.col("papers"))


def histogram(papers: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """The sufficient statistic of papers by (field, year, cites); nulls are -1."""
    keys = [F.coalesce(F.col(c), F.lit(-1)).alias(n) for c, n in (("field", "field"), ("publication_year", "year"), ("cited_by_count", "cites"))]
    return papers.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def histogram_audit(papers: DataFrame, flags: dict[str, Column], kind: str = "type") -> DataFrame:
    """(tally, name, n) beside the histogram: papers that lack a key, papers by type, and each flag's total
    over all papers, which the histogram's sums must equal."""
    missing = {f"no_{n}": F.col(c).isNull() for c, n in (("field", "field"), ("publication_year", "year"), ("cited_by_count", "cites"))}
    counts = papers.agg(F.count("*").alias("papers"), *[F.count_if(c).alias(n) for n, c in (missing | flags).items()])
    parts = [F.struct(F.lit(t).alias("tally"), F.lit(n).alias("name"), F.col(n).alias("n")) for t, own in (("total", ["papers"]), ("missing", missing), ("flag", flags)) for n in own]
    types = papers.groupBy(F.coalesce(kind, F.lit("none")).alias("name")).agg(F.count("*").alias("n"))
    return counts.select(F.inline(F.array(*parts))).unionByName(types.select(F.lit("type").alias("tally"), "name", "n"))


def usable_papers(papers: DataFrame, score: str, title: str = "title") -> DataFrame:
    """Scored articles with a title that isn't a placeholder."""
    return papers.where(F.col(score).isNotNull() & is_article() & F.col(title).isNotNull() & (F.col(title) != "Deleted Work"))


def curated(papers: DataFrame, prefixes: list[str], ids: DataFrame, title: str = "title", key: str = "id") -> DataFrame:
    """Papers whose title starts with none of the prefixes, in any case, and whose id isn't listed."""
    t = F.lower(F.trim(F.coalesce(F.col(title), F.lit(""))))
    out = F.lit(False)
    for p in prefixes:
        out = out | t.startswith(p.lower())
    return papers.where(~out).join(ids.select(key).distinct(), key, "left_anti")


def cohort(cells: DataFrame, first: int, last: int, least: int) -> DataFrame:
    """Rows of a histogram (field, year, cites, n) of those years with a field and a count, in strata of
    (field, year) that hold enough papers."""
    rows = cells.where(F.col("year").between(first, last) & (F.col("field") > 0) & (F.col("cites") >= 0))
    return rows.withColumn("stratum", F.sum("n").over(Window.partitionBy("field", "year"))).where(F.col("stratum") >= least)


def hop_histogram(papers: DataFrame, tail: int = 15) -> DataFrame:
    """(hops, n, total, reachable); hops from tail on are one bin."""
    counts = papers.where(F.col("hop").isNotNull()).groupBy(F.least("hop", F.lit(tail)).alias("hops")).agg(F.count("*").alias("n"))
    totals = papers.agg(F.count("*").alias("total"), F.count("hop").alias("reachable"))
    return counts.join(F.broadcast(totals))


def composition(papers: DataFrame, key: list[str]) -> DataFrame:
    """Counts by key with share, cumulative share and rank."""
    counts = papers.groupBy(*key).agg(F.count("*").alias("n"))
    order = Window.orderBy(F.desc("n"), *key)
    share = F.col("n") / F.sum("n").over(Window.partitionBy())
    return counts.select(*key, "n", share.alias("share"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum"), F.row_number().over(order).alias("rank"), F.sum("n").over(Window.partitionBy()).alias("all")).withColumn("cum_share", F.col("cum") / F.col("all")).drop("cum", "all")
