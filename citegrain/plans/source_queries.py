"""Queries of readers, writers and exported columns: 2.S and F1 of the survey. What is written goes to
the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain import storage
from citegrain.operators import metrics, windows
from citegrain.plans import fixtures as fx
from citegrain.plans.registry import Registry
from citegrain.sources import html, records, works

registry = Registry()


def _path(spark: SparkSession, name: str) -> str:
    return storage.new_path(spark, name)


def raw_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as nested bibliographic records, with full ids and references."""
    refs = fx.edges(spark, sf_dir).groupBy(F.col("src").alias("o_orderkey")).agg(F.sort_array(F.collect_list("dst")).alias("dst"))
    full = lambda kind, c: F.concat(F.lit(f"https://openalex.org/{kind}"), c.cast("string"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.lit(None).cast("string")
    source = F.struct(full("S", c).alias("id"), F.when(c % 2 == 0, "journal").otherwise("Conference").alias("type"), F.concat(F.lit("Venue "), c.cast("string")).alias("display_name"))
    author = lambda i, p: F.struct(F.struct(full("A", c * 10 + i).alias("id"), none.alias("display_name")).alias("author"), F.lit(p).alias("author_position"), F.array(F.struct(full("I", c % 7).alias("id"), F.lit("education").alias("type"), none.alias("display_name"))).alias("institutions"))
    named = lambda kind, n: F.struct(F.concat(F.lit(f"https://openalex.org/{kind}/"), n.cast("string")).alias("id"), none.alias("display_name"))
    topic = F.struct(full("T", k % 100).alias("id"), none.alias("display_name"), named("subfields", k % 50).alias("subfield"), named("fields", k % 26 + 11).alias("field"), named("domains", k % 4).alias("domain"))
    return fx.table(spark, sf_dir, "orders").join(refs, "o_orderkey", "left").select(
        full("W", k).alias("id"),
        F.concat(F.lit("Title "), k.cast("string")).alias("title"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("publication_date"),
        F.when(k % 3 != 0, F.year("o_orderdate")).alias("publication_year"),
        F.lit("article").alias("type"),
        F.transform("dst", lambda d: full("W", d)).alias("referenced_works"),
        F.create_map(F.lit("to"), F.array(F.lit(1), F.lit(3)), F.lit("be"), F.array(F.lit(0), F.lit(4)), F.lit("or"), F.array(F.lit(2))).alias("abstract_inverted_index"),
        F.array(author(0, "first"), author(1, "middle"), author(2, "last")).alias("authorships"),
        F.struct(source.alias("source")).alias("primary_location"),
        F.array(F.struct(source.alias("source")), F.struct(F.lit(None).cast(source_type()).alias("source"))).alias("locations"),
        topic.alias("primary_topic"),
    )


def source_type() -> str:
    return "struct<id:string,type:string,display_name:string>"


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records written as JSON lines in one directory per entity, and read with the schema."""
    root = _path(spark, "snapshot")
    raw_works(spark, sf_dir).write.json(f"{root}/works/updated_date=2025-08-21")
    return records.read_entity(spark, root, "works", works.SCHEMA)


@registry("s1_scan_json", "edges papers", "SELECT count(*) AS works, count(*) FILTER (wid % 3 <> 0) AS with_year, (SELECT count(*) FROM edges) AS refs FROM papers")
def s1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingested(spark, sf_dir).agg(F.count("*").alias("works"), F.count("publication_year").alias("with_year"), F.sum(F.coalesce(F.size("referenced_works"), F.lit(0))).cast("bigint").alias("refs"))


@registry("f1_groups", "papers", "SELECT id, publication_year, 'be to or to be' AS abstract, concat('A', sid * 10, '|A', sid * 10 + 1, '|A', sid * 10 + 2) AS authors, 'f|m|l' AS positions, concat('A', sid * 10 + 2) AS last_author_id, CASE WHEN sid % 2 = 0 THEN 'j' ELSE 'c' END AS source_type, concat('S', sid) AS locations, concat('fields/', field) AS primary_field, field AS field_number FROM papers")
def f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of exported columns."""
    out = works.exported(ingested(spark, sf_dir), "core", "topics")
    return out.select("id", "publication_year", "abstract", F.array_join("author_ids", "|").alias("authors"), F.array_join("author_positions", "|").alias("positions"), "last_author_id", F.col("primary_source_type").alias("source_type"), F.array_join("location_source_ids", "|").alias("locations"), "primary_field", "field_number")


@registry("s2_csv", "", "SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def s2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV with declared types."""
    path = _path(spark, "csv")
    records.write_csv(fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    return records.read_csv(spark, path, ["s_suppkey"], schema="s_suppkey bigint, s_name string, s_acctbal double")


@registry("s3_csv_strings", "assignees", "SELECT patent_id, coalesce(univ_hospital_gov, '') AS univ_hospital_gov, CAST(founding_year AS VARCHAR) AS founding_year FROM assignees")
def s3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strings, required columns checked; nulls were written as blanks."""
    path = _path(spark, "csv")
    records.write_csv(fx.assignees(spark, sf_dir).select("patent_id", "univ_hospital_gov", "founding_year"), path)
    out = records.read_csv(spark, path, ["patent_id", "univ_hospital_gov", "founding_year"])
    return out.fillna("", ["univ_hospital_gov"])


@registry("s5_preamble_csv", "", "SELECT p_name AS title, p_retailprice AS jif, '2024 JIF' AS jif_column, p_size || '%' AS share FROM part")
def s5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV behind a preamble, with misplaced percent signs."""
    from citegrain.functions import values

    path = _path(spark, "preamble")
    body = F.concat_ws(",", F.concat(F.lit('"'), F.col("p_name"), F.lit('"')), F.lit("1234-5678"), F.concat(F.lit('"'), F.format_string("%.2f", "p_retailprice"), F.lit('"')), F.concat(F.lit('"'), F.col("p_size").cast("string"), F.lit('"%')))
    head = spark.range(3).select(F.element_at(F.array(F.lit("Selected journals"), F.lit(" "), F.lit("Journal name,ISSN,2024 JIF,% of OA")), (F.col("id") + 1).cast("int")).alias("value"))
    head.unionByName(fx.table(spark, sf_dir, "part").select(body.alias("value"))).write.text(path)
    out = records.read_preamble_csv(spark, path).where("ISSN IS NOT NULL")
    column = records.metric_columns(out.columns, "JIF")["JIF"]
    return out.select(F.col("Journal name").alias("title"), values.number(F.col(column)).alias("jif"), F.lit(column).alias("jif_column"), F.col("% of OA").alias("share"))


@registry("s6_decimal_comma_csv", "", "SELECT p_partkey AS id, p_retailprice AS sjr FROM part")
def s6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV parted by semicolons, with decimal commas."""
    from citegrain.functions import values

    path = _path(spark, "semicolons")
    rows = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("Title"), F.translate(F.format_string("%,.2f", "p_retailprice"), ",.", ".,").alias("SJR"))
    rows.write.option("header", "true").option("sep", ";").csv(path)
    out = records.read_csv(spark, path, ["Title", "SJR"], sep=";")
    return out.select(F.col("Title").cast("bigint").alias("id"), values.decimal_comma_number(F.col("SJR")).alias("sjr"))


@registry("s7_html_cells", "", "SELECT p_partkey AS page, p_name || ' & co' AS name, CAST(p_size AS VARCHAR) AS jif, p_brand || '; ' || p_type AS category FROM part")
def s7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of cells in pages: a title attribute before text, several cells of a column joined."""
    cell = lambda column, attr, body: F.concat(F.lit(f'<mat-cell class="x cdk-column-{column}"'), attr, F.lit("> <b>"), body, F.lit("</b>\n</mat-cell>"))
    none = F.lit("")
    page = F.concat(F.lit("<html><mat-row role='row'>"), cell("name", F.concat(F.lit(' title="'), F.col("p_name"), F.lit(' &amp; co"')), F.lit("short ...")), cell("jif", none, F.col("p_size").cast("string")), cell("category", none, F.col("p_brand")), cell("category", none, F.col("p_type")), cell("category", none, F.col("p_brand")), F.lit("</mat-row></html>"))
    pages = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page"), page.alias("html"))
    return html.wide(html.rows_of(pages, "html", "mat-row", "mat-cell", ["page"]), ["page"], ["name", "jif", "category"]).drop("row_no")


@registry("s7_page_headings", "", "SELECT count(*) AS pages, sum(len(regexp_extract_all(html, '<p[ >]'))) AS paragraphs FROM pages")
def s7_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "pages").agg(F.count("*").alias("pages"), F.sum(F.size(F.regexp_extract_all("html", F.lit("<p[ >]"), F.lit(0)))).alias("paragraphs"))


@registry("s8_record_array", "", "SELECT n_nationkey, n_name FROM nation")
def s8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A released xz array of records, written and read back."""
    from citegrain.operators import release

    path = _path(spark, "release") + ".json.xz"
    release.write_records(fx.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), path)
    return records.read_records(spark, path + ".absent", path, schema="n_nationkey:int,n_name:string")


@registry("s9_histogram", "works", "WITH h AS (SELECT field, publication_year AS year, cited_by_count AS cites, count(*) AS n, count(*) FILTER (priority = '1-URGENT') AS k FROM works GROUP BY ALL), s AS (SELECT field, year, sha256(string_agg(l, chr(10) ORDER BY l)) AS h FROM (SELECT *, concat_ws(',', field, year, cites, n, k) AS l FROM h) GROUP BY field, year) SELECT sha256(string_agg(h, chr(10) ORDER BY field, year)) AS sha256, (SELECT CAST(sum(n) AS BIGINT) FROM h) AS docs FROM s")
def s9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gzipped histogram CSV with its checksum."""
    path = _path(spark, "hist")
    rows = fx.works(spark, sf_dir).groupBy("field", F.col("publication_year").alias("year"), F.col("cited_by_count").alias("cites")).agg(F.count("*").alias("n"), F.count_if(F.col("priority") == "1-URGENT").alias("k"))
    rows.write.option("header", "true").option("compression", "gzip").csv(path)
    read, digest = records.read_histogram(spark, path, "k")
    return read.agg(F.lit(digest).alias("sha256"), F.sum("n").alias("docs"))


@registry("s10_id_list", "papers", "SELECT DISTINCT id, wid AS n FROM papers")
def s10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text list of bare and full ids, with blanks and repeats."""
    path = _path(spark, "ids")
    k = F.col("wid")
    line = F.when(k % 3 == 0, F.concat(F.lit("https://openalex.org/"), F.col("id"))).when(k % 3 == 1, F.concat(F.lit("  works/"), F.col("id"), F.lit(" "))).otherwise(F.col("id"))
    rows = fx.papers(spark, sf_dir).select(F.explode(F.array(line, F.lit(""), F.col("id"))).alias("value"))
    rows.write.text(path)
    return records.read_ids(spark.read.text(path))


@registry("s11_projection", "", "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def s11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that reads two columns and pushes its filter down."""
    return fx.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity").where("l_quantity > 25").groupBy("l_returnflag").agg(F.count("*").alias("n"))


@registry("s12_point_lookup", "papers sources", "SELECT p.wid, s.source_name FROM papers p JOIN sources s ON p.sid = s.sid WHERE s.sid % 100 = 7")
def s12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a list of ids; the list is sent to all executors while it is short."""
    asked = fx.sources(spark, sf_dir).where("sid % 100 = 7").select("sid", "source_name")
    asked = F.broadcast(asked) if asked.count() <= metrics.SMALL else asked
    return fx.papers(spark, sf_dir).select("wid", "sid").join(asked, "sid").select("wid", "source_name")


@registry("s14_json_sink", "sources", "SELECT source_id, source_name, jif FROM sources")
def s14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as JSON, nulls kept, and read back (S14, S15: any number of part files)."""
    path = _path(spark, "json")
    records.write_json(fx.sources(spark, sf_dir).select("source_id", "source_name", "jif"), path)
    return spark.read.schema("source_id string, source_name string, jif double").json(path)


@registry("s15_parts", "sources", "SELECT source_id, jif FROM sources")
def s15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of a divided run, read as one; a missing part would be an error."""
    path = _path(spark, "parts")
    rows = fx.sources(spark, sf_dir).select("source_id", "jif", "sid")
    for i in range(3):
        records.write_json(rows.where(F.col("sid") % 3 == i).drop("sid"), f"{path}/part{i}.json")
    return records.read_parts(spark, path, 3, "source_id string, jif double")


@registry("s2_inferred", "", "SELECT s_suppkey, s_name, s_acctbal, typeof(CAST(s_suppkey AS INTEGER)) = 'INTEGER' AS whole FROM supplier")
def s2_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV whose types are inferred."""
    path = _path(spark, "csv")
    records.write_csv(fx.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path)
    out = records.read_csv(spark, path, ["s_suppkey"], infer=True)
    return out.select(F.col("s_suppkey").cast("bigint").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.lit(dict(out.dtypes)["s_suppkey"] in ("int", "bigint")).alias("whole"))


@registry("s4_skipped_lines", "", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_name || ' & \"co\"' AS name FROM part")
def s4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with two lines before their header."""
    path = _path(spark, "skipped")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit(';"'), F.col("p_name"), F.lit(' & ""co"""'))
    body = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), line.alias("value"))
    head = spark.range(3).select((F.col("id") - 3).alias("k"), F.element_at(F.array(F.lit("a source"), F.lit("of 2024"), F.lit("id;name")), (F.col("id") + 1).cast("int")).alias("value"))
    # one file, as a preamble opens a file
    head.unionByName(body).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return records.read_csv(spark, path, ["id", "name"], sep=";", skip=2)


@registry("s16_dictionary", "", "SELECT * FROM (VALUES (1, 'source_id', 'string', 'venue'), (2, 'jif', 'double', 'impact factor')) AS v(place, \"column\", type, description)")
def s16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the columns of a released table hold."""
    return records.dictionary(fx.sources(spark, sf_dir).select("source_id", "jif"), {"source_id": "venue", "jif": "impact factor"})


@registry("s13_chunks", "papers", "SELECT CAST((row_number() OVER (ORDER BY wid) - 1) // 1000 AS BIGINT) AS chunk, wid FROM papers")
def s13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in chunks of a thousand by key, which is also what pages of a keyset are (T4)."""
    return windows.paged(fx.papers(spark, sf_dir).select("wid"), 1000, "wid").select(F.col("page").alias("chunk"), "wid")


@registry("t4_keyset", "papers", "SELECT wid FROM papers WHERE wid > 700 ORDER BY wid LIMIT 500")
def t4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after a key: Spark takes the least keys of each task and merges them."""
    return windows.page_after(fx.papers(spark, sf_dir).select("wid"), "wid", 700, 500)


@registry("s22_indexed", "papers", "SELECT id, source_id FROM papers WHERE source_id IN ('S7', 'S70') OR id = 'W77'")
def s22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups in a table that is sorted by source and has a Bloom filter on ids."""
    path = _path(spark, "indexed")
    records.write_indexed(fx.papers(spark, sf_dir).select("id", "source_id"), path, "source_id", "id")
    held = spark.read.parquet(path)
    by_source = held.where(F.col("source_id").isin("S7", "S70"))
    return by_source.unionByName(held.where("id = 'W77' AND source_id NOT IN ('S7', 'S70')"))


@registry("s24_cached", "papers", "SELECT type, count(*) AS n FROM papers GROUP BY type")
def s24(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result that is kept under what it depends on; the second call reads it."""
    make = lambda: fx.papers(spark, sf_dir).groupBy("type").agg(F.count("*").alias("n"))
    key = f"{spark.sparkContext.applicationId} {sf_dir}"
    storage.cached(spark, "types", key, make)
    return storage.cached(spark, "types", key, lambda: make().limit(0))


@registry("s17_csv_sink", "sources", "SELECT source_id, jif FROM sources")
def s17(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _path(spark, "csv")
    records.write_csv(fx.sources(spark, sf_dir).select("source_id", "jif"), path)
    return records.read_csv(spark, path, schema="source_id string, jif double")


@registry("s23_string_field", "", "SELECT event_id, CAST(user_id AS VARCHAR) AS user_id, nullif(event_type, 'error') AS event_type FROM events")
def s23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field coerced to string; nulls are absent."""
    return fx.table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user_id"), F.nullif("event_type", F.lit("error")).alias("event_type"))


@registry("s25_checkpointed", "papers", "SELECT field, count(*) AS n FROM papers GROUP BY field")
def s25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by field in a folder each; a run that was interrupted after some goes on with the others, and
    leaves those that are done (S25, C6)."""
    path = _path(spark, "by-field")
    rows = fx.papers(spark, sf_dir).groupBy("field").agg(F.count("*").alias("n"))
    records.write_by(rows.where("field % 3 = 0"), path, "field")
    records.write_by(rows, path, "field")
    return spark.read.parquet(path).select("field", "n")
