"""Rules on hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import matching as M
from tallywright.functions import units as U


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


@pytest.mark.parametrize(
    "text, want",
    [
        ("BOX/100 gloves", (100.0, "BOX", "HIGH", "SLASH_COUNT")), ("50/cs", (50.0, "CASE", "HIGH", "COUNT_SLASH")), ("14 PC SET", (14.0, "SET", "HIGH", "PC_SET")), ("900 piece kit", None), ("Case of 24", (24.0, "CASE", "HIGH", "BOX_OF")),
        ("pair of 2", (2.0, "SET", "HIGH", "SET_OF")), ("12 per box", (12.0, "BOX", "HIGH", "NUM_PACK")), ("30 ct", (30.0, "PACK", "MEDIUM", "NUM_COUNT")), ("Case 580 loader", None), ("", None), (None, None), ("0 pcs", None),
    ],
)
def test_pack_patterns(spark, text, want):
    got = one(spark, U.pack_of(F.lit(text).cast("string")))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(
    "code, text, want",
    [
        ("ea", None, ("EA", "EACH", 1.0, "EACH", 0, 0, 1, "HIGH")), (" bx ", "case", ("BX", "BOX", 1.0, "EACH", 1, 0, 0, "HIGH")), ("??", "Dozen", ("DOZEN", "DOZEN", 12.0, "EACH", 1, 0, 0, "HIGH")), (None, "per gallon drum", ("GAL", "GALLON", 1.0, "GALLON", 0, 1, 0, "MEDIUM")),
        ("ZZ", "odd", ("ZZ", "OTHER", 1.0, "OTHER", 0, 0, 0, "LOW")), (None, None, ("UNKNOWN", "OTHER", 1.0, "OTHER", 0, 0, 1, "NONE")),
    ],
)
def test_canonical_units(spark, code, text, want):
    assert tuple(one(spark, U.canonical_unit(F.lit(code).cast("string"), F.lit(text).cast("string")))) == want


def test_text_pack_overrides_the_unit(spark):
    line = U.commercial_record(F.lit("EA"), F.lit(None).cast("string"), F.lit("gloves BOX/100"))
    got = one(spark, F.struct(line["pack"].alias("pack"), line["packaged"].alias("packaged"), U.price_basis(line)[0].alias("basis"), U.price_basis(line)[1].alias("trust"), U.base_price(F.lit(50.0), line)[0].alias("base"), U.base_price(F.lit(None).cast("double"), line)[0].alias("none")))
    assert tuple(got) == (100.0, 1, "COMMERCIAL_UNIT", "MEDIUM", 0.5, 1.0)


@pytest.mark.parametrize(
    "text, unit, scope, level",
    [
        ("Furnish and install pump", "EA", "INSTALLATION_BUNDLE", 4), ("annual support for software", "EA", "MAINTENANCE_BUNDLE", 4), ("labor at hourly rate", "HR", "SERVICE", 4), ("plain thing", "TON", "BULK_COMMODITY", 1), ("spare filter", "EA", "ACCESSORY_OR_PART", 0),
        ("24 ports rack mounted", "EA", "CONFIGURED_PRODUCT", 3), ("thing with lid, base, handle", "EA", "CONFIGURED_PRODUCT", 3), ("plain thing", "EA", "BARE_PRODUCT", 2), (None, None, "BARE_PRODUCT", 2),
    ],
)
def test_scopes(spark, text, unit, scope, level):
    got = one(spark, U.scope_of(F.lit(text).cast("string"), F.lit(unit).cast("string")))
    assert (got.scope, got.level) == (scope, level)


def test_specifications(spark):
    none = F.lit(None).cast("double")

    def spec(text):
        found = U.specifications(F.lit(text), none, none, none, none)
        return {k: v for k, v in spark.range(1).select(*[c.alias(n) for n, c in found.items()]).first().asDict().items() if v is not None}

    assert spec("2TB SSD") == {"storage_gb": 2048.0, "is_ssd": 1.0}
    assert spec("24 port PoE switch") == {"ports": 24.0, "is_poe": 1.0} and spec("7 port hub") == {}
    assert spec("1.5 kW motor") == {"power_w": 1500.0} and spec("2 hp three phase")["phase"] == 3.0
    assert spec("1-1/2 inch brass") == {"pipe_diameter_in": 1.5, "material": "BRASS"} and spec("class 300") == {"pressure_psi": 300.0}


def test_skill_rules(spark):
    def match(required, skills):
        hits, ratio = M.skill_match(F.array(*map(F.lit, required)).cast("array<string>"), F.array(*map(F.lit, skills)).cast("array<string>"))
        row = spark.range(1).select(hits.alias("h"), ratio.alias("r")).first()
        return list(row.h), row.r

    assert match(["first aid", "cooking"], ["First Aid", "Driving"]) == (["First Aid"], 0.5)
    assert match(["aid", "first"], ["First Aid"]) == (["First Aid"], 0.5)  # one skill counts once
    assert match([], ["a", "b", "c", "d"]) == (["a", "b", "c"], 1.0)
    assert match(["x"], []) == ([], 0.0)


def test_availability_and_fallback_rules(spark):
    free = [one(spark, M.is_available(F.lit(a).cast("string"), F.lit(w))) for a, w in ((None, True), ("", False), ("Weekends", True), ("Weekends", False), ("weekday mornings", False), ("flexible", True), ("mornings", True))]
    assert free == [True, True, True, False, True, True, False]
    assert [one(spark, M.is_weekend(F.lit(d).cast("string"))) for d in ("2024-06-15", "2024-06-17T10:00", "some day", None)] == [True, False, False, False]
    rows = spark.createDataFrame([("a", 1, True), ("a", 2, False), ("b", 3, False), ("b", 4, False)], "k string, v int, ok boolean")
    assert sorted(r.v for r in M.keep_or_all(rows, "k", F.col("ok")).collect()) == [1, 3, 4]
    assert sorted(r.v for r in M.keep_or_all(rows, "k", F.col("ok"), small=2).collect()) == [1, 2, 3, 4]
