import os.path
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.functions.durations import parse_datetime, parse_duration, walltime
from fleetlens.functions.geodesic import distance, ellipsoidal_distance
from fleetlens.functions.literals import literal_text, object_literals, quote
from fleetlens.functions.logs import file_role, round_percent, run_number
from fleetlens.functions.names import constituent_group, normalize_constituents, parse_enum, storm_code
from fleetlens.functions.paths import move_path, normalize_path, relative_path, resolve_path


def values(spark, items, build, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, {schema}")
    return [r.out for r in rows.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


def test_durations(spark):
    given = ["150", "10:00:00:00", "06:00:00", "1:30", "2.5", " 7 ", "x", "1:2:3:4:5", "", None, "1.08E6", "-30"]
    wanted = [150.0, 864000.0, 21600.0, 90.0, 2.5, 7.0, None, None, None, None, 1080000.0, -30.0]
    assert values(spark, given, parse_duration) == wanted


def test_walltime(spark):
    given = [21600.0, 3.0, 90061.0, 59.4, 360000.0, None]
    assert values(spark, given, walltime, "v double") == ["06:00:00", "00:00:03", "25:01:01", "00:00:59", "100:00:00", None]


def test_dates(spark):
    given = ["20180908", "2008090106", "2008-08-23 00:00:00", "2008-03-09T02:30:00", "soon", None]
    shown = [None if v is None else v.isoformat(" ") for v in values(spark, given, parse_datetime)]
    assert shown == ["2018-09-08 00:00:00", "2008-09-01 06:00:00", "2008-08-23 00:00:00", "2008-03-09 02:30:00", None, None]


def test_round_percent_is_binary_half_even(spark):
    random.seed(3)
    given = [100 * a / b for a, b in ((random.randint(0, 900), random.randint(1, 900)) for _ in range(3000))]
    given += [i / 1000 for i in range(0, 3000)] + [i / 8 for i in range(900)] + [2.675, 1.005, 0.0, 1e-300]
    assert values(spark, given, round_percent, "v double") == [round(v, 2) for v in given]


PATHS = ["/a/b/c", "/a/b", "/", "/a/../b/./c", "/x//y/", "/a/b/c/../../../../z"]


def test_paths_agree_with_posix(spark):
    for base in ["/a/b", "/", "/q/r/s"]:
        assert values(spark, PATHS, lambda c: relative_path(c, F.lit(base))) == [os.path.relpath(p, base) for p in PATHS]
    mixed = PATHS + ["a/../../b", ".", "..", "a/b/..", ""]
    assert values(spark, mixed, normalize_path) == [os.path.normpath(p) for p in mixed]


def test_move_and_resolve(spark):
    assert values(spark, ["a/b/c", "/a/b", "c"], lambda c: move_path(c, 1)) == ["b/c", "/a/b", "."]
    assert values(spark, ["a/b", "/a/b"], lambda c: move_path(c, 0)) == ["a/b", "/a/b"]
    assert values(spark, ["a/b"], lambda c: move_path(c, -2)) == ["../../a/b"]
    assert values(spark, ["a/b", "/a"], lambda c: move_path(c, "p/q")) == ["p/q/a/b", "/a"]
    given = ["../x", "/y/z", None]
    assert values(spark, given, lambda c: resolve_path(c, F.lit("/a/b"))) == ["/a/x", "/y/z", None]
    assert values(spark, given, lambda c: resolve_path(c, F.lit("/a/b"), relative=True)) == ["../x", "../../y/z", None]


def test_names(spark):
    assert values(spark, ["run_12", "run_1_007", "run", "_5", "a_b"], run_number) == [12.0, 7.0, -1.0, 5.0, -1.0]
    assert values(spark, ["hera", "HERA ", "x"], lambda c: parse_enum(c, ["HERA"])) == ["HERA", "HERA", None]
    assert values(spark, ["9"], lambda c: storm_code(F.lit("AL"), c, F.lit(2008))) == ["AL092008"]


def test_file_roles(spark):
    given = ["ADCIRC_SETUP_run.out.log", "x/ADCIRC_a_b.out.log", "SCHISM_a_b.err.log", "PET00.ESMF_LogFile", "fort.63.nc",
             "fort.16", "outputs/mirror.out", "mirror.out", "outputs/out2d_1.nc", "outputs/out2d_2.nc", "outputs/schout_3.nc"]
    wanted = ["adcirc_out", None, "schism_err", "esmf", "adcirc_nc", "adcirc_output", "schism_output", None,
              "schism_nc", None, "schism_nc"]
    assert values(spark, given, lambda _: file_role("v")) == wanted


def test_constituents(spark):
    groups = {"All": ["Q1", "O1", "M2"], "Major": ["Q1", "O1"]}
    given = [["all"], ["o1", "q1"], ["major", "m2"], ["m2"]]
    assert values(spark, given, lambda c: constituent_group(c, groups), "v array<string>") == [None, "Major", None, None]
    assert values(spark, given, lambda c: normalize_constituents(c, groups), "v array<string>") == [
        ["Q1", "O1", "M2"], ["Q1", "O1"], ["Q1", "O1", "M2"], ["M2"],
    ]


def test_literals(spark):
    raw = '{"a": "x\\"y", "b": null, "c": [1, "z"], "d": 600, "e": true, "f": ""}'
    got = values(spark, [raw, "{bad", None], object_literals)
    assert got[0] == {"a": '"x\\"y"', "b": "null", "c": '[1,"z"]', "d": "600", "e": "true", "f": '""'}
    assert got[1] is None and got[2] is None
    assert values(spark, ['"x\\"y"', "null", "600", '""', '"a"'], literal_text) == ['x"y', None, "600", "", "a"]
    assert values(spark, ['x"y', None, ""], quote) == ['"x\\"y"', "null", '""']


@pytest.mark.parametrize(
    "points, metres",
    [
        ((0, 0, 0, 90), 10001965.729313),
        ((0, 0, 180, 0), 20003931.458625),
        ((0, -30, 179.8, 29.9), 19989832.827610),
        ((0, 0, 1, 0), 111319.490793),
        ((10, 50, 10, 50), 0.0),
        ((179.5, 0, -179.5, 0), 111319.490793),
    ],
)
def test_known_geodesics(points, metres):
    lon1, lat1, lon2, lat2 = ([v] for v in points)
    assert distance(lon1, lat1, lon2, lat2)[0] == pytest.approx(metres, abs=1e-4)


def test_geodesic_column_keeps_nulls(spark):
    rows = spark.createDataFrame([(0.0, 0.0, 0.0, 90.0), (None, 0.0, 1.0, 1.0)], "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(ellipsoidal_distance(*[F.col(c) for c in "abcd"])).collect()]
    assert got[0] == pytest.approx(10001965.729313, abs=1e-4) and got[1] is None


def test_both_ways_to_the_distance_agree():
    from fleetlens.functions import geodesic

    rng = np.random.default_rng(2)
    target, beta1 = rng.uniform(0, 2.9, 400), -rng.uniform(0.1, 1.5, 400)
    beta2 = rng.uniform(-1, 1, 400) * np.abs(beta1)
    pair = [np.sin(beta1), np.cos(beta1), np.sin(beta2), np.cos(beta2)]
    quick, settled = geodesic._settle(target, *pair, 1 / 298.257223563)
    slow = geodesic._bisect(target, *pair, 1 / 298.257223563)
    assert settled.mean() > 0.95 and np.allclose(quick[settled], slow[settled], rtol=0, atol=1e-11)


def test_geodesic_is_symmetric_and_periodic():
    rng = np.random.default_rng(1)
    lon1, lon2 = rng.uniform(-180, 180, 500), rng.uniform(-180, 180, 500)
    lat1, lat2 = rng.uniform(-90, 90, 500), rng.uniform(-90, 90, 500)
    there = distance(lon1, lat1, lon2, lat2)
    assert np.allclose(there, distance(lon2, lat2, lon1, lat1), atol=1e-5)
    assert np.allclose(there, distance(lon1 + 360, -lat1, lon2 - 360, -lat2), atol=1e-4)
