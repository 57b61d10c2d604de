import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from tests.helpers import haversine
from wayfleet.functions import clock, geo, text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def ts(t):
    return F.lit(t).cast("timestamp")


def test_haversine_matches_the_formula_and_keeps_null(spark):
    row = one(spark, km=geo.haversine_km("42.73D", "-73.68D", "42.74D", "-73.67D"), m=geo.haversine_m("0D", "0D", "0D", "1D"),
              none=geo.haversine_km("42.73D", "-73.68D", "CAST(NULL AS DOUBLE)", "0D"), opposite=geo.haversine_km("0D", "0D", "0D", "180D"))
    assert row.km == pytest.approx(haversine(42.73, -73.68, 42.74, -73.67), abs=1e-9)
    assert row.m == pytest.approx(111194.9266, abs=1e-3)
    assert row.none is None
    assert row.opposite == pytest.approx(6371.0 * 3.141592653589793)


def test_projection_is_clamped_and_a_point_segment_gives_its_start(spark):
    pos = lambda lat, lon, *seg: geo.segment_position(f"{lat}D", f"{lon}D", *[f"{v}D" for v in seg])
    row = one(spark, before=pos(-1, 0, 0, 0, 1, 0), half=pos(0.5, 3, 0, 0, 1, 0), after=pos(2, 0, 0, 0, 1, 0), point=pos(5, 5, 1, 1, 1, 1))
    assert (row.before, row.half, row.after, row.point) == (0.0, 0.5, 1.0, 0.0)


def test_epoch_starts_in_2025(spark):
    row = one(spark, a=clock.epoch_seconds(ts("2025-01-01 00:00:00")), b=clock.epoch_seconds(ts("2025-01-01 00:01:00.5")))
    assert (row.a, row.b) == (0.0, 60.5)


def test_service_day_on_clock_changes(spark):
    start = lambda t, s=0: F.date_format(clock.service_day_start(ts(t), start_seconds=s), "yyyy-MM-dd HH:mm")
    row = one(spark, spring=start("2025-03-09 20:00:00"), autumn=start("2025-11-02 20:00:00"), next_day=start("2025-11-03 05:00:00"),
              four=start("2025-06-01 07:59:59", 4 * 3600), at_four=start("2025-06-01 08:00:00", 4 * 3600))
    assert row.spring == "2025-03-09 05:00" and row.autumn == "2025-11-02 04:00" and row.next_day == "2025-11-03 05:00"
    assert row.four == "2025-05-31 08:00" and row.at_four == "2025-06-01 08:00"


def test_clock_strings(spark):
    m = lambda t: clock.minute_of_day(F.lit(t))
    row = one(spark, a=m("12:00 AM"), b=m("12:05 PM"), c=m(" 7:45 pm "), d=m("soon"))
    assert (row.a, row.b, row.c, row.d) == (0, 725, 1185, None)
    assert one(spark, t=clock.clock_text(F.lit(0))).t == "12:00 AM"


def test_hmac_equals_the_standard_library(spark):
    for key in (b"k", b"x" * 100):
        want = hmac.new(key, b"v1:17:{}", hashlib.sha256).hexdigest()
        row = one(spark, h=text.hmac_sha256(key, F.lit("v1:17:{}")), ok=text.signature_ok(key, F.lit("17"), F.lit("{}"), F.lit("v1=" + want)),
                  bad=text.signature_ok(key, F.lit("18"), F.lit("{}"), F.lit("v1=" + want)), none=text.signature_ok(key, F.lit("17"), F.lit("{}"), F.lit(None)))
        assert row.h == want and row.ok and not row.bad and not row.none


def test_links_must_be_https(spark):
    row = one(spark, l=text.links(F.lit("a [b](https://c) d [e](javascript:f)")), p=text.plain_message(F.lit("a [b](https://c) d [e](javascript:f)")))
    assert [(x.text, x.url, x.is_link) for x in row.l] == [("b", "https://c", True), ("e", "javascript:f", False)]
    assert row.p == "a b d e (javascript:f)"
