"""Golden values of the business formulas."""
from decimal import Decimal

from pyspark.sql import functions as F

from ledgerline.functions import formulas as fx


def one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("v")).first()["v"]


def test_stage_conversion_rate(spark):
    assert one(spark, fx.stage_conversion_rate("w", "t"), "w long, t long", (25, 100)) == 25.0
    assert one(spark, fx.stage_conversion_rate("w", "t"), "w long, t long", (0, 50)) == 0.0
    assert one(spark, fx.stage_conversion_rate("w", "t"), "w long, t long", (3, 0)) == 0.0
    # HALF_UP: 1/8 = 12.5 % exactly; 1/3 = 33.33 %; 2/3 = 66.67 %
    assert one(spark, fx.stage_conversion_rate("w", "t"), "w long, t long", (1, 3)) == 33.33
    assert one(spark, fx.stage_conversion_rate("w", "t"), "w long, t long", (2, 3)) == 66.67


def test_mask_pii(spark):
    rows = [("Acme Energy Ltd",), ("AC",), ("",), (None,), ("abc",), ("Ñandú",)]
    out = [r["m"] for r in spark.createDataFrame(rows, "s string").select(fx.mask_pii("s").alias("m")).collect()]
    assert out == ["A*************d", "***", "***", "***", "a*c", "Ñ***ú"]


def test_power_and_temperature(spark):
    assert one(spark, fx.power_kw("v", "a"), "v double, a double", (230.0, 32.0)) == 7.36
    assert one(spark, fx.safe_temperature("t"), "t double", (45.5,)) is True
    assert one(spark, fx.safe_temperature("t"), "t double", (90.0,)) is False
    assert one(spark, fx.safe_temperature("t"), "t double", (85.0,)) is False


def test_cac(spark):
    assert one(spark, fx.cac("c", "n"), "c long, n long", (100000, 20)) == 50.0
    assert one(spark, fx.cac("c", "n"), "c long, n long", (0, 10)) == 0.0
    assert one(spark, fx.cac("c", "n"), "c long, n long", (500, 0)) == 0.0
    assert one(spark, fx.cac("c", "n"), "c long, n long", (100, 3)) == 0.33  # 1.00 / 3


def test_consent_filter(spark):
    df = spark.createDataFrame([(1, True), (2, False), (3, None)], "id int, c boolean")
    assert [r.id for r in df.filter(fx.consent_filter("c")).collect()] == [1]


def test_turnover_and_sla(spark):
    assert one(spark, fx.inventory_turnover("c", "i"), "c long, i long", (120000, 30000)) == 4.0
    assert one(spark, fx.inventory_turnover("c", "i"), "c long, i long", (0, 5000)) == 0.0
    assert one(spark, fx.inventory_turnover("c", "i"), "c long, i long", (5, 0)) == 0.0
    assert one(spark, fx.dispatch_sla_met("a", "t"), "a double, t double", (2.5, 4.0)) is True
    assert one(spark, fx.dispatch_sla_met("a", "t"), "a double, t double", (5.0, 4.0)) is False
    assert one(spark, fx.dispatch_sla_met("a", "t"), "a double, t double", (4.0, 4.0)) is True


def test_convert_currency_and_variance(spark):
    schema = "a decimal(18,2), r double"
    assert one(spark, fx.convert_currency("a", "r"), schema, (Decimal("100"), 1.0850)) == 108.5
    assert one(spark, fx.convert_currency("a", "r"), schema, (Decimal("1234.56"), 0.85)) == 1049.38
    assert one(spark, fx.convert_currency("a", "r"), schema, (Decimal("0"), 1.5)) == 0.0
    assert one(spark, fx.pct_variance("o", "n"), "o double, n double", (100.0, 100.0)) == 0.0
    assert one(spark, fx.pct_variance("o", "n"), "o double, n double", (100.0, 105.0)) == 0.05
    assert one(spark, fx.pct_variance("o", "n"), "o double, n double", (0.0, 5.0)) == 0.0


def test_half_up_ratio_exact_on_large_values(spark):
    # 10**17 + 5 over 10 -> 10**16 + 0.5 -> rounds up at scale 0
    v = one(spark, fx.half_up_ratio("n", "d", 0), "n long, d long", (10**17 + 5, 10))
    assert v == float(10**16 + 1)
    assert one(spark, fx.idiv(F.lit(10**18 - 1), F.lit(7)), "x int", (1,)) == (10**18 - 1) // 7
