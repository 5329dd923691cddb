"""Product identity on stated cases."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import identity as I

# text, known brand, model, part number -> brand, model, family, part number, type, variant, key, confidence
CASES = [
    ("Dell Latitude 5420 laptop", None, None, None, "DELL", "LATITUDE-5420", "LATITUDE-5000", None, "LAPTOP", None, "C|DELL|LATITUDE-5420|EA", "HIGH"),
    ("dell latitude 5520 notebook", None, None, None, "DELL", "LATITUDE-5520", "LATITUDE-5000", None, "LAPTOP", None, "C|DELL|LATITUDE-5520|EA", "HIGH"),
    ("Cisco Meraki MS250-48FP", None, None, None, "CISCO", "MERAKI-MS250-48FP", "MERAKI-250", None, "NETWORK_SWITCH", None, "C|CISCO|MERAKI-MS250-48FP|EA", "HIGH"),
    ("lamp, Part No. 12/AB-3", None, None, None, None, None, None, "12-AB-3", "LIGHTING", None, "C|MPN:12-AB-3|EA", "HIGH"),
    ("Hewlett  Packard toner", None, None, None, "HP", None, None, None, "OTHER", None, "F|HP|OTHER|EA", "MEDIUM"),
    ("plain bracket", None, None, None, None, None, None, None, "OTHER", None, "C|OTHER|EA", "LOW"),
    ("valve for a dell server", "Acme  Tools", "", " ", "ACME-TOOLS", None, None, None, "SERVER", None, "F|ACME-TOOLS|SERVER|EA", "MEDIUM"),
    ("GE lighting model: K_9 small form factor", None, " x-1 ", None, "GE", "X-1", None, None, "OTHER", "SFF", "C|GE|X-1|EA", "HIGH"),
    ("honda pump motor MT", None, None, "?", "HONDA", None, None, None, "PUMP_MOTOR", "TOWER", "F|HONDA|PUMP_MOTOR|EA", "MEDIUM"),
    ("applehp deller", None, None, None, None, None, None, None, "OTHER", None, "C|OTHER|EA", "LOW"),
    ("Catalyst switch panel", None, None, None, None, "CATALYST-SWITCH", "CATALYST", None, "NETWORK_SWITCH", None, "C|NETWORK_SWITCH|EA", "LOW"),
    (None, None, None, None, None, None, None, None, "OTHER", None, "C|OTHER|EA", "LOW"),
]


def test_cases(spark):
    frame = spark.createDataFrame([(i, *c[:4], " C", "F ", "EA") for i, c in enumerate(CASES)], "i int, text string, brand string, model string, part_number string, code string, family string, unit string")
    found = I.product_identity(*[F.col(c) for c in ("text", "brand", "model", "part_number", "code", "family", "unit")])
    for row in frame.select("i", *[c.alias(n) for n, c in found.items()]).collect():
        assert tuple(row)[1:] == CASES[row.i][4:], CASES[row.i][0]


@pytest.mark.parametrize("known, text, want", [("X|MPN:1", "a b", "X|MPN:1"), ("X|GENERIC|y", "red bolt-5 mm, steel", "C|GENERIC|RED_BOLT_5_MM|EA"), (None, None, "C|GENERIC|GENERIC|EA"), (" ", "--", "C|GENERIC|GENERIC|EA")])
def test_stratified_key(spark, known, text, want):
    frame = spark.createDataFrame([(known, text, "C", None)], "known string, text string, code string, unit string")
    assert frame.select(I.stratified_key(*[F.col(c) for c in ("known", "text", "code", "unit")])).first()[0] == want
