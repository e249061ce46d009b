"""Scalar rules, one row per branch."""

import colorsys
import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from codestrata.functions import colors, dates, numbers as N, paths, rules
from codestrata.operators.quality import lexical_complexity
from tests.conftest import rows


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).collect()[0]["x"]


@pytest.mark.parametrize("ins,dele,new,gone,expected", [
    (5, 0, True, False, "addition"), (0, 5, False, True, "deletion"), (7, 10, False, False, "refactor"),
    (13, 10, False, False, "refactor"), (14, 10, False, False, "modification"), (6, 10, False, False, "modification"),
    (0, 0, False, False, "modification"), (5, 0, False, False, "modification"), (0, 3, False, False, "modification")])
def test_change_type(spark, ins, dele, new, gone, expected):
    c = rules.change_type(F.col("i"), F.col("d"), F.col("n"), F.col("g"))
    assert one(spark, c, i=ins, d=dele, n=new, g=gone) == expected


@pytest.mark.parametrize("message,expected", [
    ("Add thing", "feature"), ("new address book", "feature"), ("Fix it", "bugfix"), ("issue 4", "bugfix"),
    ("Clean up", "refactor"), ("restructure", "refactor"), ("speed", "performance"), ("SECURE", "security"), ("x", "other")])
def test_commit_type(spark, message, expected):
    assert one(spark, rules.commit_type(F.col("m")), m=message) == expected


@pytest.mark.parametrize("message,expected", [
    ("refactor: split file", "extract_method"), ("Refactor extract", "extract_method"), ("refactor rename", "rename"),
    ("refactor, move", "move"), ("refactor inline", "inline"), ("refactor", None), ("Extract the rename", "extract_method")])
def test_refactoring_kind(spark, message, expected):
    assert one(spark, rules.refactoring_kind(F.col("m")), m=message) == expected


@pytest.mark.parametrize("score,freq,fixes,n,expected", [
    (0.71, 9.0, 0, 100, "critical"), (0.7, 9.0, 0, 100, "warning"), (0.5, 5.1, 9, 100, "healthy"),
    (0.5, 5.1, 10, 100, "stable"), (0.5, 5.0, 0, 100, "stable")])
def test_subsystem_status(spark, score, freq, fixes, n, expected):
    c = rules.subsystem_status(F.col("s"), F.col("f"), F.col("b"), F.col("n"))
    assert one(spark, c, s=score, f=freq, b=fixes, n=n) == expected


def test_purpose_texts(spark):
    c = rules.purpose(F.col("k"), F.col("s"), F.array(F.lit("api"), F.lit("svc")))
    assert one(spark, c, k="bugfix", s="a leak") == "This fixes a leak in api, svc by implementing necessary corrections."
    assert one(spark, c, k="other", s="a leak") == "a leak"


def test_lead_summary(spark):
    assert one(spark, rules.lead_summary(F.col("m")), m="x" * 150 + "\n\nrest") == "x" * 150
    assert one(spark, rules.lead_summary(F.col("m")), m="first\nsecond\n \nbody\n\nmore") == "first second"
    assert one(spark, rules.lead_summary(F.col("m")), m="") == ""


def test_lines_follow_python(spark):
    texts = ["", "a", "a\n", "\n", "\n\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i", "a\r\n", " \n x "]
    df = spark.createDataFrame([(t,) for t in texts], ["t"])
    got = {r["t"]: (r["l"], r["n"]) for r in df.select(
        "t", paths.split_lines(F.col("t")).alias("l"), paths.line_count(F.col("t")).alias("n")).collect()}
    for t in texts:
        assert got[t] == (t.splitlines(), len(t.splitlines()))


def test_paths(spark):
    df = spark.createDataFrame([("a/b/c.py",), ("x.go",), ("a/__init__.py",), ("Makefile",), ("a/py",)], ["p"])
    got = {r[0]: tuple(r[1:]) for r in df.select(
        "p", paths.is_source(F.col("p")), paths.subsystem(F.col("p")), paths.component(F.col("p")),
        paths.basename(F.col("p")), paths.parent_folder(F.col("p")), paths.directory(F.col("p")),
        paths.dotted_name(F.col("p"))).collect()}
    assert got["a/b/c.py"] == (True, "a", "b", "c.py", "b", "a/b", "a.b.c")
    assert got["x.go"] == (True, "root", None, "x.go", None, "", "x.go")
    assert got["a/__init__.py"][-1] == "a" and got["a/__init__.py"][2] == "__init__.py"
    assert got["Makefile"][0] is False and got["a/py"][0] is False


def test_under_path(spark):
    df = spark.createDataFrame([("core",), ("core/a",), ("corex/a",), ("a/core",)], ["p"])
    assert rows(df.filter(paths.under_path(F.col("p"), "core/"))) == [("core",), ("core/a",)]


@pytest.mark.parametrize("url,expected", [
    ("https://github.com/o/r", ("o", "r")), ("https://github.com/o/r.git", ("o", "r")), ("HTTPS://GITHUB.com/o/r/", ("o", "r")),
    ("https://github.com/o/r/x", None), ("http://github.com/o/r", None), ("https://github.com/o", None)])
def test_repo_url(spark, url, expected):
    found = one(spark, paths.parse_repo_url(F.col("u")), u=url)
    assert (tuple(found) if found else None) == expected


def test_colors_follow_hsv(spark):
    healths = [i / 200 for i in range(-60, 201)]
    df = spark.createDataFrame([(h,) for h in healths], ["h"])
    for r in df.select("h", colors.hsv_hex(F.col("h")).alias("c")).collect():
        channels = colorsys.hsv_to_rgb(r["h"] * 0.3, 0.8, 0.9)
        if r["h"] >= 0:
            assert r["c"] == "#{:02x}{:02x}{:02x}".format(*[int(x * 255) for x in channels])


def test_position(spark):
    import zlib
    p = one(spark, colors.path_position(F.col("p")), p="a/b/c.py")
    angle = zlib.crc32(b"b") % 360
    import math
    assert p["y"] == 30 and math.isclose(p["x"], 60 * math.cos(math.radians(angle)))
    flat = one(spark, colors.path_position(F.col("p")), p="c.py")
    assert (flat["x"], flat["y"], flat["z"]) == (20.0, 10.0, 0.0)


def test_sunday_week_every_day(spark):
    first = datetime.date(2019, 1, 1)
    days = [(first + datetime.timedelta(i),) for i in range(2922)]
    df = spark.createDataFrame(days, ["d"]).select("d", dates.sunday_week(F.col("d")).alias("w"))
    assert all(r["w"] == r["d"].strftime("%Y-W%U") for r in df.collect())


def test_numbers(spark):
    assert one(spark, N.py_round(F.col("x"), 2), x=0.125) == 0.12
    assert one(spark, N.whole_at_least_one(F.col("x")), x=3.9) == 3
    assert one(spark, N.whole_at_least_one(F.col("x")), x=-3.9) == 1
    assert one(spark, N.guarded_ratio(F.col("a"), F.col("b")), a=5, b=0) == 5.0
    assert one(spark, N.score_band(F.col("x")), x=60)["band"] == "warning"
    assert one(spark, N.subsystem_hotspot_score(F.col("a"), F.col("b"), F.col("c")), a=0, b=0, c=0.0) == 0.0


def test_reason_texts(spark):
    c = rules.refactor_reason(F.col("s"), F.col("c"), F.col("f"))
    assert one(spark, c, s=0.1, c=1.0, f=1) == "Code quality improvement opportunity"
    assert one(spark, c, s=0.71, c=21.0, f=11).count("; ") == 2


def test_lexical_complexity(spark):
    assert one(spark, lexical_complexity(F.col("t")), t="if x and y: for éif, iffy _or or") == 1 + 4 + 1


def test_whole_text_hash_is_stable(spark):
    assert one(spark, F.sha2("t", 256), t="abc") == hashlib.sha256(b"abc").hexdigest()
