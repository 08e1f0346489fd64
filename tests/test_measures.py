import math

import pytest
from pyspark.sql import functions as F

from swardshift.functions import measures as m
from swardshift.functions import text as tx
from swardshift.functions.geometry import haversine_m, laea_xy, segment_distance
from swardshift.functions.strict import nan_to_null, strict_mean, strict_median, strict_min, strict_sum


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


def lit(v):
    return F.lit(v).cast("double")


@pytest.mark.parametrize(
    "base,a,b,want",
    [(1.0, 2.0, 3.0, 1.0), (None, 2.0, None, 2.0), (None, None, 3.0, 3.0), (None, 2.0, 3.0, None), (None, None, None, None)],
)
def test_two_fallbacks_fill_nothing(spark, base, a, b, want):
    assert one(spark, m.exclusive_fill(lit(base), lit(a), lit(b))) == want


def test_sentinels_and_censoring(spark):
    assert one(spark, m.sentinel_to_null(lit(-999.0), [-999])) is None
    assert one(spark, m.sentinel_to_null(lit(None), [-999])) is None
    assert one(spark, m.sentinel_to_null(lit(4.0), [-999])) == 4.0
    assert one(spark, m.censor_below(lit(1.9) / 10, 0.2)) is None
    assert one(spark, m.censor_below(lit(2.0) / 10, 0.2)) == 0.2


def test_recode_sends_null_to_default(spark):
    assert one(spark, m.recode(F.lit(None).cast("int"), m.WATER_MANAGEMENT, "not relevant")) == "not relevant"
    assert one(spark, m.recode(F.lit(3), m.WATER_MANAGEMENT, "not relevant")) == "Drainage"
    assert one(spark, m.recode(F.lit(6), m.WATER_MANAGEMENT, "not relevant")) == "not relevant"


def test_effects(spark):
    assert one(spark, m.effect_size(lit(4.0), lit(1.5), "Abs")) == 2.5
    assert one(spark, m.effect_size(lit(4.0), lit(2.0), "Rel")) == pytest.approx(math.log(2))
    assert one(spark, m.effect_size(lit(4.0), lit(0.0), "Rel")) is None
    with pytest.raises(ValueError):
        m.effect_size("a", "b", "other")


@pytest.mark.parametrize(
    "x,label", [(-5.0, "-5 to  5"), (-5.1, "Less than -5"), (5.0, "5 to 15"), (25.0, "More than 25"), (None, "More than 25")]
)
def test_effect_bins(spark, x, label):
    assert one(spark, m.bin_effect(lit(x))) == label


def test_effect_bins_can_keep_missing(spark):
    assert one(spark, m.bin_effect(lit(None), missing_as_last=False)) is None
    assert one(spark, m.ordinal(F.lit("5 to 15"), m.EFFECT_LABELS)) == 2
    assert one(spark, m.ordinal(F.lit("unlisted"), m.EFFECT_LABELS)) is None


def test_intervals_close_on_the_right_end_only_at_last(spark):
    got = [one(spark, m.interval_index(lit(x), [0, 1, 2])) for x in (-1, 0, 1, 2, 2.1, None)]
    assert got == [None, 0, 1, 1, None, None]


@pytest.mark.parametrize(
    "breaks,want",
    [([0.0001, 0.0005, 0.0009], [0.0001, 0.0005, 0.0009]), ([0.00123456, 0.0054321], [0.0012, 0.0054]),
     ([0.0123456, 0.0987654], [0.012, 0.099]), ([0.123, 0.456], [0.12, 0.46]), ([1.25, 3.14], [1.2, 3.1]),
     ([11.4, 99.6], [11.0, 100.0])],
)
def test_round_breaks(breaks, want):
    assert m.round_breaks(breaks) == want


def test_strict_aggregates(spark):
    df = spark.createDataFrame(
        [("a", 1.0), ("a", None), ("b", 1.0), ("b", 2.0), ("b", 4.0), ("c", float("nan"))], "g string, x double"
    )
    got = {
        r["g"]: tuple(r)[1:]
        for r in df.groupBy("g").agg(strict_sum("x"), strict_median("x"), strict_min("x"), strict_mean("x")).collect()
    }
    assert got == {"a": (None,) * 4, "b": (7.0, 2.0, 1.0, pytest.approx(7 / 3)), "c": (None,) * 4}
    assert one(spark, nan_to_null(F.lit(float("nan")))) is None


def test_text(spark):
    assert one(spark, tx.replace_first(F.lit("a;b;c"), ";", "/")) == "a/b;c"
    assert one(spark, tx.replace_first(F.lit("abc"), ";", "/")) == "abc"
    assert one(spark, tx.remove_first(F.lit("Alpine Bio-geographical Region"), " Bio-geographical Region")) == "Alpine"
    assert one(spark, tx.strip_last_suffix(F.lit("WM_not_visible"))) == "WM_not"
    assert one(spark, tx.strip_last_suffix(F.lit("plain"))) == "plain"
    assert len(one(spark, tx.truncate(F.lit("x" * 60)))) == 50
    assert one(spark, tx.to_number(F.lit("1.5"))) == 1.5
    assert one(spark, tx.to_number(F.lit("abc"))) is None
    assert one(spark, tx.layer_month(F.lit("ndvi_200003_v1"))) == 3
    assert one(spark, tx.layer_year(F.lit("ndvi_200003_v1"))) == 2000


def test_region_level(spark):
    got = [one(spark, m.region_level(F.lit(c))) for c in ("D", "DE", "DE1", "DE11", "DE111", "DE1111")]
    assert got == [None, 0, 1, 2, 3, None]


def test_distances(spark):
    assert one(spark, haversine_m(lit(0.0), lit(0.0), lit(0.0), lit(90.0))) == pytest.approx(6371010 * math.pi / 2)
    assert one(spark, segment_distance(lit(0.0), lit(1.0), lit(-1.0), lit(0.0), lit(1.0), lit(0.0))) == 1.0
    assert one(spark, segment_distance(lit(4.0), lit(4.0), lit(0.0), lit(0.0), lit(1.0), lit(0.0))) == 5.0
    # A segment of no length.
    assert one(spark, segment_distance(lit(3.0), lit(4.0), lit(0.0), lit(0.0), lit(0.0), lit(0.0))) == 5.0


def test_equal_area_projection_at_its_origin(spark):
    x, y = laea_xy(lit(10.0), lit(52.0))
    assert one(spark, x) == pytest.approx(4321000, abs=1e-6)
    assert one(spark, y) == pytest.approx(3210000, abs=1e-6)
    # Published check point of EPSG:3035: 5 E, 50 N -> 3962799.45, 2999718.85.
    x, y = laea_xy(lit(5.0), lit(50.0))
    assert one(spark, x) == pytest.approx(3962799.45, abs=0.01)
    assert one(spark, y) == pytest.approx(2999718.85, abs=0.01)
