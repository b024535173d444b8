"""Queries of scalar functions: 2.N of the survey. Each runs on values that hit its edge cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegrain.functions import ids, text, values
from citegrain.plans import fixtures as fx
from citegrain.plans.registry import Registry

registry = Registry()

#: Forms of an id, by key modulo 8; the same in the oracle.
_FORMS = "CASE o_orderkey % 8 WHEN 0 THEN 'https://openalex.org/W' || o_orderkey WHEN 1 THEN 'works/W' || o_orderkey WHEN 2 THEN ' W' || o_orderkey || ' ' WHEN 3 THEN 'https://openalex.org/works/W' || o_orderkey WHEN 4 THEN 'A' || o_orderkey WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'W' || o_orderkey || 'x' END"
_NUMBERS = "CASE o_orderkey % 7 WHEN 0 THEN '1,234.5' WHEN 1 THEN '1.234,5' WHEN 2 THEN '' WHEN 3 THEN 'N/A' WHEN 4 THEN ' ' || (o_orderkey / 4) || ' ' WHEN 5 THEN NULL ELSE '0' END"


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_FORMS).alias("v"))


@registry("n_ids", "", f"""WITH f AS (SELECT o_orderkey, {_FORMS} AS v FROM orders), b AS (SELECT *, regexp_replace(regexp_replace(trim(v), '^https://openalex\\.org/', ''), '^works/', '') AS bare FROM f)
SELECT o_orderkey, nullif(regexp_extract(v, '/([^/]+)$', 1), '') AS last_segment, bare, CASE WHEN regexp_full_match(bare, 'W[0-9]+') THEN bare END AS work_id,
  CASE WHEN regexp_full_match(regexp_replace(v, '^https://openalex\\.org/', ''), 'W[0-9]+') THEN regexp_replace(v, '^https://openalex\\.org/', '') END AS strict_id,
  nullif(regexp_replace(nullif(trim(v), ''), '^https://openalex\\.org/', ''), '') AS source_id, CASE WHEN starts_with(v, 'https://openalex.org/') THEN v ELSE 'https://openalex.org/' || v END AS full_id FROM b""")
def n_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisers that differ in what they trim, strip and reject."""
    v = F.col("v")
    return forms(spark, sf_dir).select("o_orderkey", ids.last_segment(v).alias("last_segment"), ids.bare_id(v).alias("bare"), ids.work_id(v).alias("work_id"), ids.strict_work_id(v).alias("strict_id"), ids.source_id(v).alias("source_id"), ids.full_id(v).alias("full_id"))


@registry("n5_field_code", "", "WITH f AS (SELECT o_orderkey, o_orderkey % 26 + 11 AS n FROM orders), g AS (SELECT o_orderkey, n, CASE o_orderkey % 4 WHEN 0 THEN n::VARCHAR WHEN 1 THEN 'fields/' || n WHEN 2 THEN 'https://openalex.org/fields/' || n ELSE 'fields/x' END AS v FROM f) SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN 'x' ELSE n::VARCHAR END AS code, CAST(CASE WHEN o_orderkey % 4 = 3 THEN -1 ELSE n END AS INTEGER) AS number FROM g")
def n5(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") % 26 + 11).cast("string")
    k = F.col("o_orderkey") % 4
    v = F.when(k == 0, n).when(k == 1, F.concat(F.lit("fields/"), n)).when(k == 2, F.concat(F.lit("https://openalex.org/fields/"), n)).otherwise("fields/x")
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    return rows.select("o_orderkey", ids.field_code(F.col("v")).alias("code"), ids.field_number(F.col("v")).alias("number"))


@registry("n_issn", "", "WITH f AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '1234-567x' WHEN 1 THEN ' 1234 5678' WHEN 2 THEN '1234567' ELSE lpad(c_custkey::VARCHAR, 8, '0') END AS v FROM customer), g AS (SELECT c_custkey, upper(replace(replace(v, '-', ''), ' ', '')) AS b FROM f) SELECT c_custkey, CASE WHEN length(b) = 8 THEN b END AS issn FROM g")
def n_issn(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 4 == 0, "1234-567x").when(k % 4 == 1, " 1234 5678").when(k % 4 == 2, "1234567").otherwise(F.lpad(k.cast("string"), 8, "0"))
    return fx.table(spark, sf_dir, "customer").select("c_custkey", ids.issn(v).alias("issn"))


@registry("n7_numbers", "", f"WITH f AS (SELECT o_orderkey, {_NUMBERS.replace('(o_orderkey / 4)', '(o_orderkey / 4)::DOUBLE::VARCHAR')} AS v FROM orders) SELECT o_orderkey, TRY_CAST(nullif(trim(replace(v, ',', '')), '') AS DOUBLE) AS number, TRY_CAST(nullif(trim(replace(replace(v, '.', ''), ',', '.')), '') AS DOUBLE) AS comma_number, coalesce(TRY_CAST(trim(v) AS DOUBLE) = 0, false) AS is_zero FROM f")
def n7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank is neither a number nor zero."""
    rows = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_NUMBERS.replace("(o_orderkey / 4)", "CAST(CAST(o_orderkey AS DOUBLE) / 4 AS STRING)")).alias("v"))
    v = F.col("v")
    return rows.select("o_orderkey", values.number(v).alias("number"), values.decimal_comma_number(v).alias("comma_number"), values.is_zero(v).alias("is_zero"))


@registry("n8_n28_finite", "", "WITH f AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'NaN' WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN '3.75' ELSE '-2.5' END AS v FROM orders) SELECT o_orderkey, CASE v WHEN '3.75' THEN 3.75 WHEN '-2.5' THEN -2.5 END::DOUBLE AS finite, CASE v WHEN '3.75' THEN 3 WHEN '-2.5' THEN -2 END::BIGINT AS whole FROM f")
def n8(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.element_at(F.array(*map(F.lit, ("NaN", "NA", "", "3.75", "-2.5"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", values.finite(v).alias("finite"), values.whole(v).alias("whole"))


@registry("n_year", "papers", "SELECT wid, CASE wid % 3 WHEN 2 THEN NULL ELSE publication_date END AS date, CAST(CASE WHEN wid % 2 = 0 THEN publication_year WHEN wid % 3 = 2 THEN NULL ELSE year(publication_date) END AS INTEGER) AS year FROM papers")
def n_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in two forms and none; a year from itself or the date."""
    day = F.col("publication_date").cast("string")
    rows = fx.papers(spark, sf_dir).select("wid", F.when(F.col("wid") % 3 == 0, F.concat(F.lit(" "), day, F.lit("T10:00:00"))).when(F.col("wid") % 3 == 1, day).otherwise("soon").alias("d"), F.when(F.col("wid") % 2 == 0, F.col("publication_year").cast("string")).otherwise("n/a").alias("y"))
    return rows.select("wid", values.iso_date(F.col("d")).alias("date"), values.year_of(F.col("y"), F.trim("d")).alias("year"))


@registry("n_codes", "sources", "SELECT sid, CASE sid % 4 WHEN 0 THEN 'j' WHEN 1 THEN 'b' WHEN 2 THEN 'Blog' END AS source, CASE sid % 4 WHEN 0 THEN 'e' WHEN 1 THEN 'c' WHEN 2 THEN 'Guild' ELSE '' END AS institution, CASE sid % 4 WHEN 0 THEN 'f' WHEN 1 THEN 'l' WHEN 2 THEN 'other' ELSE '' END AS position FROM sources")
def n_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown names stay; a null is blank for institutions and positions, and null for sources."""
    at = lambda *names: F.element_at(F.array(*[F.lit(n).cast("string") for n in names]), (F.col("sid") % 4 + 1).cast("int"))
    return fx.sources(spark, sf_dir).select(
        "sid",
        values.code(at("Journal", "book series", "Blog", None), values.SOURCE_TYPES, None).alias("source"),
        values.code(at("EDUCATION", "company", "Guild", None), values.INSTITUTION_TYPES).alias("institution"),
        values.code(at("first", "Last", "other", None), values.AUTHOR_POSITIONS).alias("position"),
    )


@registry("n12_n16_arrays", "papers", "SELECT wid, CASE WHEN wid % 3 = 0 THEN '' ELSE 'private_x||public_' || (wid % 5) END AS filled, wid % 3 <> 0 AS private, wid % 3 <> 0 AS public, CASE WHEN wid % 3 <> 0 THEN '[\"Private_x\",null,\"public_' || (wid % 5) || '\"]' END AS json FROM papers")
def n12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls in arrays, arrays that are absent, JSON, and prefixes in any case."""
    items = F.when(F.col("wid") % 3 != 0, F.array(F.lit("Private_x"), F.lit(None).cast("string"), F.concat(F.lit("public_"), (F.col("wid") % 5).cast("string"))))
    rows = fx.papers(spark, sf_dir).select("wid", items.alias("v"))
    return rows.select("wid", F.lower(F.array_join(values.blanks_for_nulls(F.col("v")), "|")).alias("filled"), values.any_prefix(F.col("v"), "private_").alias("private"), values.any_prefix(F.col("v"), "public_").alias("public"), F.to_json("v", {"ignoreNullFields": "false"}).alias("json"))


@registry("n_abstract_decode", "", "SELECT doc_id, array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''), ' ') AS text FROM documents")
def n_abstract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents become maps of words to positions, which are decoded again."""
    docs = fx.table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w"))
    places = docs.select("doc_id", F.posexplode("w").alias("at", "word")).groupBy("doc_id", "word").agg(F.sort_array(F.collect_list("at")).alias("places"))
    inverted = places.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "places"))).alias("inverted"))
    return docs.select("doc_id").join(inverted, "doc_id", "left").select("doc_id", F.coalesce(text.abstract(F.col("inverted")), F.lit("")).alias("text"))


@registry("n20_bins", "", "WITH p AS (SELECT o_orderkey, (o_orderkey % 101) / 100.0::DOUBLE AS p FROM orders) SELECT o_orderkey, CAST(CASE WHEN p <= 0.5 THEN 0 WHEN p <= 0.75 THEN 1 WHEN p <= 0.9 THEN 2 WHEN p <= 0.95 THEN 3 WHEN p <= 0.99 THEN 4 ELSE 5 END AS INTEGER) AS bin FROM p")
def n20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", values.citation_bin((F.col("o_orderkey") % 101) / 100.0).alias("bin"))


@registry("n21_title_key", "", "SELECT doc_id, substr(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\p{M}]+', '', 'g'), 1, 80) AS key FROM documents")
def n21(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.table(spark, sf_dir, "documents").select("doc_id", text.title_key(F.col("text")).alias("key"))


@registry("n22_clean_title", "", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '\\emph{' || p_name || '} \\& co' WHEN 1 THEN upper(p_name[1]) || lower(p_name[2:]) || ' of the DNA in water' WHEN 2 THEN p_name || ' -- $\\beta$' ELSE '' END AS title FROM part")
def n22(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup, capitals and typography in titles."""
    k, name = F.col("p_partkey") % 4, F.col("p_name")
    title = F.when(k == 0, F.concat(F.lit("[12] <i>"), name, F.lit("</i> &amp; <b>co</b>"))).when(k == 1, F.upper(F.concat(name, F.lit(" of the dna in water")))).when(k == 2, F.concat(name, F.lit(" – β")))
    return fx.table(spark, sf_dir, "part").select("p_partkey", text.clean_title(title).alias("title"))


@registry("n26_transforms", "", "SELECT c_custkey, round(asinh(c_acctbal), 6) AS a, round(asinh(c_acctbal / 100000 * 10000), 6) AS b, round(ln(c_custkey + 1), 6) AS l FROM customer")
def n26(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("c_acctbal")
    return fx.table(spark, sf_dir, "customer").select("c_custkey", F.round(F.asinh(x), 6).alias("a"), F.round(F.asinh(x / 100000 * 10000), 6).alias("b"), F.round(F.log(F.col("c_custkey") + 1), 6).alias("l"))


@registry("n27_half_even", "", "WITH r AS (SELECT o_orderkey, (o_orderkey * 5) / 1000.0::DOUBLE AS x FROM orders), p AS (SELECT *, 134217729.0::DOUBLE * x AS c, x * 100.0::DOUBLE AS q FROM r), h AS (SELECT *, c - (c - x) AS hi FROM p), e AS (SELECT *, (q - floor(q) - 0.5::DOUBLE) + ((hi * 100.0::DOUBLE - q) + (x - hi) * 100.0::DOUBLE) AS over FROM h) SELECT o_orderkey, (floor(q) + CASE WHEN over > 0 THEN 1.0::DOUBLE WHEN over < 0 THEN 0.0::DOUBLE ELSE floor(q) % 2 END) / 100.0::DOUBLE AS rounded FROM e")
def n27(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rounding of the exact binary value to two places, half of them ties in decimals."""
    x = (F.col("o_orderkey") * 5) / F.lit(1000.0)
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", values.round_half_even(x, 2).alias("rounded"))


@registry("n23_labels", "", "SELECT c_custkey, CASE WHEN c_custkey = 1 THEN 'First \\& best' WHEN length(c_name) > 17 THEN rtrim(replace(substr(c_name, 1, 16), '#', '\\#')) || '…' ELSE replace(c_name, '#', '\\#') END AS label, replace(format('{:,}', CAST(round(c_acctbal * 100) AS BIGINT)), ',', '{,}') AS amount FROM customer")
def n23(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for a table: aliases, cut to a length, escaped; numbers with thousands."""
    rows = fx.table(spark, sf_dir, "customer")
    return rows.select("c_custkey", text.label(F.col("c_name"), {"Customer#000000001": "First & best"}, 17).alias("label"), text.thousands(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("amount"))


@registry("n25_names", "", "SELECT * FROM (VALUES ('all-assignees', 'all_assignees_par_0.85', 'all_assignees_min_hops'), ('corporate', 'corporate_par_lag5_0.85', 'corporate_min_hops'), ('legacy-startup', 'legacy_startup_par_0.85', 'legacy_startup_min_hops')) AS v(mode, score, hops)")
def n25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are derived from a seed definition, a lag and a damping."""
    from citegrain.operators import registry as seeds

    rows = []
    for mode, lag in (("all_assignees", None), ("Corporate", 5), ("legacy-startup", None)):
        found = seeds.find(mode)
        rows.append((found.mode, values.output_property(found.column("score") + "_lag3", 0.85, lag), found.column("hops")))
    return spark.createDataFrame(rows, "mode string, score string, hops string")
