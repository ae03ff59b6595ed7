"""Templates compiled to columns, against Python's own formatting."""

import pytest
from pyspark.sql import functions as F

from reelspark.operators import render

TEXTS = ["", "Dark", "Тьма", "a'b", 'q"q', "both ' and \"", "back\\slash", "tab\there\nnew", "naïve 𝒳 ☃"]
TEXT_SPECS = ["", "s", "10", "<10", ">10", "^10", "^9s", "*^11", "-<8.3", ".2", "0", "010", "_>6.1s", "é^12", "{<7"[1:]]
NUMBER_SPECS = [
    "", "d", "02d", "2d", "<6d", ">6", "^7d", "=+7d", "*=8", "x^9d", "+d", " d", "-d", "05", "+05d", ",", "_d", "12,d", "b", "#b", "#010x", "X", "o", "#o", "_b", "_x", "n", "f", ".0f", ".2f", "8.1f", ",.2f", "e", ".1E", "%", ".1%", "F",
]
NUMBERS = [0, 1, 7, 42, 1999, 1234567, -3, -12345]


def test_texts(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    specs = [s for s in TEXT_SPECS if s != "<7"]
    rows = df.select("t", *[render.compiled(F.col("t"), s, False).alias(f"c{i}") for i, s in enumerate(specs)], render.quoted(F.col("t")).alias("r"), render.quoted(F.col("t"), True).alias("a")).collect()
    for row in rows:
        assert [row[f"c{i}"] for i in range(len(specs))] == [format(row.t, s) for s in specs], row.t
        assert (row.r, row.a) == (repr(row.t), ascii(row.t))


def test_numbers(spark):
    df = spark.createDataFrame([(n,) for n in NUMBERS], "n int")
    rows = df.select("n", *[render.compiled(F.col("n"), s, True).alias(f"c{i}") for i, s in enumerate(NUMBER_SPECS)]).collect()
    for row in rows:
        assert [row[f"c{i}"] for i in range(len(NUMBER_SPECS))] == [format(row.n, s) for s in NUMBER_SPECS], row.n
    assert spark.range(1).select(render.compiled(F.lit(65), "c", True), render.compiled(F.lit(None).cast("int"), "03d", True)).first()[:] == ("A", "000")


def test_templates(spark):
    cols = {"title": F.lit("Dark"), "season": F.lit(1), "episode": F.lit(None).cast("int"), "year": F.lit(2017), "ext": F.lit("mkv")}
    one = lambda t: spark.range(1).select(render.render(t, cols)).first()[0]
    assert one("{title:_>8}-{season:>3}x{episode:03d}{{}}.{ext}") == "____Dark- 1x000.mkv"
    assert one("{title!r}.{season!s:0>3}.{year!r:.2}.{ext!a}") == "'Dark'.001.20.'mkv'"
    assert one("{title} {unknown}") == "" and one("{year:,d} {title:.2}") == "2,017 Da"


@pytest.mark.parametrize("template", ["{title", "title}", "{}", "{0}", "{title.upper}", "{title[0]}", "{title!x}", "{title:d}", "{title:+}", "{title:=5}", "{season:s}", "{season:.2d}", "{season:q}", "{season:08,}", "{season:g}", "{title:{width}}", "{season!r:d}", "{title:<<<}"])
def test_what_has_no_meaning(template):
    with pytest.raises(ValueError):
        render.fields_of(template)


def test_reasons(spark):
    """What keeps a file from a new name, the first that applies; names in reasons are quoted."""
    from reelspark.functions import paths
    from reelspark.plans.pipeline import Options, plan

    rows = ["/tv/It's \"X\"/Deleted Scenes/a.mkv", "/tv/it's.trailer/Behind the scenes of it's.mkv", "/tv/Show.S02.mkv"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(rows)], "file_id long, path string")
    assert [r[0] for r in df.select(paths.supplementary_reason(F.col("path"))).collect()][:2] == ["supplementary directory: 'Deleted Scenes'", 'supplementary filename: "Behind the scenes of it\'s"']
    p = plan(df.filter("file_id = 2"), Options(template="{title}.{episode}.{ext}")).first()
    assert p.status in ("skipped", "renamed") and (p.status != "skipped" or p.reason == "no episode")
    s = lambda **k: spark.range(1).select(render.rename_status(F.lit("n"), F.lit("o"), F.lit(""), F.array().cast("array<string>"), F.lit(k.get("title", "T t")), F.lit("e"), F.array(F.lit("season"), F.lit("episode")), F.lit(k.get("season", 1)).cast("int"), F.lit(k.get("episode", 1)).cast("int")).alias("s")).first().s[:]
    assert (s(), s(title="T"), s(season=None), s(episode=None)) == (("renamed", ""), ("skipped", "no title"), ("skipped", "no season"), ("skipped", "no episode"))
