import random
import pytest
from pyspark.sql import functions as F

from citegrain.functions import ids, text, values
from citegrain.operators import registry


def column(spark, fn, *items, kind="string"):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v"))).collect()]


def test_ids(spark):
    forms = ["https://openalex.org/W1", "works/W1", " W1 ", "S1", "fields/22", "", None, "W", "https://openalex.org/works/W1"]
    assert column(spark, ids.bare_id, *forms) == ["W1", "W1", "W1", "S1", "fields/22", "", None, "W", "W1"]
    assert column(spark, ids.work_id, *forms) == ["W1", "W1", "W1", None, None, None, None, None, "W1"]
    assert column(spark, ids.strict_work_id, *forms) == ["W1", None, None, None, None, None, None, None, None]
    assert column(spark, ids.last_segment, *forms) == ["W1", "W1", None, None, "22", None, None, None, "W1"]
    assert column(spark, ids.source_id, "  ", "https://openalex.org/S1", None) == [None, "S1", None]
    assert column(spark, ids.field_code, "22", "fields/22", "https://openalex.org/fields/22", None) == ["22", "22", "22", None]
    assert column(spark, ids.field_number, "22", "fields/22", "fields/x", None) == [22, 22, -1, -1]
    assert column(spark, ids.issn, "1234-567x", "12345678", "1234567", None) == ["1234567X", "12345678", None, None]
    assert column(spark, lambda v: ids.id_bucket(v, 7), "W15", "15", "WW1", "") == [1, 0, 0, 0]


def test_numbers(spark):
    assert column(spark, values.number, "1,234.5", "", "N/A", None) == [1234.5, None, None, None]
    assert column(spark, values.decimal_comma_number, "1.234,5", "0,5", " ") == [1234.5, 0.5, None]
    assert column(spark, values.is_zero, "0", "0.0", "", None, "1") == [True, True, False, False, False]
    assert column(spark, values.whole, "3.9", "-3.9", "nan", "x") == [3, -3, None, None]
    assert column(spark, values.finite, "1e3", "inf", "NaN", "NA") == [1000.0, None, None, None]


def test_citation_bins_are_right_closed(spark):
    edges = [0.0, 0.5, 0.500001, 0.75, 0.9, 0.95, 0.99, 0.991, 1.0, None]
    assert column(spark, values.citation_bin, *edges, kind="double") == [0, 0, 1, 1, 2, 3, 4, 5, 5, None]


def test_splitmix64(spark):
    mask = (1 << 64) - 1

    def mix(v):
        v = (v + 0x9E3779B97F4A7C15) & mask
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & mask
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & mask
        return v ^ (v >> 31)

    xs = [0, 1, 2**31, 2**63 - 1, -1, -(2**63), 123456789]
    assert [x & mask for x in column(spark, values.splitmix64, *xs, kind="bigint")] == [mix(x & mask) for x in xs]
    ordered = column(spark, lambda v: values.unsigned_order(v), -1, 0, 1, kind="bigint")
    assert ordered[1] < ordered[2] < ordered[0]


def test_abstracts(spark):
    rows = spark.sql("SELECT map('to', array(1, 3), 'be', array(0, 4), 'or', array(2)) AS m UNION ALL SELECT map() UNION ALL SELECT NULL")
    assert sorted([r[0] for r in rows.select(text.abstract(F.col("m"))).collect()], key=str) == ["", None, "be to or to be"]
    for bad in ("map('a', array(0, 0))", "map('a', array(1))", "map('a', array(-1, 0))"):
        with pytest.raises(Exception, match="abstract position"):
            spark.sql(f"SELECT {bad} AS m").select(text.abstract(F.col("m"))).collect()


def test_titles(spark):
    assert column(spark, text.title_key, "A, É: b_1!", None, "x" * 100) == ["aéb_1", "", "x" * 80]
    assert column(spark, text.clean_title, "[3] A <i>b</i> &amp; c_d", None) == [r"A \emph{b} \& c\_d", ""]
    assert column(spark, text.clean_title, "PROTEIN MEASUREMENT WITH THE FOLIN REAGENT") == ["Protein measurement with the Folin reagent"]


def test_seed_definitions():
    young = registry.find("YOUNG_FIRM")
    assert (young.mode, young.seed, young.column("hops"), young.column("hops", test=True), young.column("score", test=True)) == ("young-firm", "seed_young_firm", "young_firm_min_hops", "young_firm_min_hops_test", "young_firm_par")
    for bad in ("startup", "young", "nothing", ""):
        with pytest.raises(ValueError, match="no seed definition"):
            registry.find(bad)
    with pytest.raises(ValueError, match="legacy-startup"):
        registry.find("startup")
    assert [d.mode for d in registry.CANONICAL] == ["all-assignees", "corporate", "young-firm", "young-firm-university"]
    assert registry.columns(registry.find("patent"))["graph"] == "patent_reachability"
    with pytest.raises(ValueError):
        registry.identifier("a b")


def test_half_even_rounds_the_exact_value_like_python(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-1000, 1000) for _ in range(500)] + [k / 8 for k in range(-40, 40)] + [k / 1000 for k in range(0, 3000, 5)] + [2.675, 1e300, -1e17, 0.0, 5e-324, 1.005]
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    for digits in (0, 2, 4, 6):
        got = [r[0] for r in df.select(values.round_half_even(F.col("x"), digits)).collect()]
        assert got == [round(x, digits) for x in xs]
    assert df.select(values.round_half_even(F.lit(None).cast("double"), 2)).first()[0] is None


def test_labels(spark):
    rows = spark.createDataFrame([("Journal of A & B",), ("x" * 30,), (None,), ("known",)], "n string")
    got = [r[0] for r in rows.select(text.label(F.col("n"), {"known": "K_1"}, 20)).collect()]
    assert got == [r"Journal of A \& B", "x" * 19 + "…", "", r"K\_1"]
    assert rows.limit(1).select(text.thousands(F.lit(1234567))).first()[0] == "1{,}234{,}567"
