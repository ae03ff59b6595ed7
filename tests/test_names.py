import pytest
from pyspark.sql import functions as F

from reelspark.functions import names, paths, quality


def values(spark, items, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], "i int, x string")
    return [r.v for r in df.select("i", expr(F.col("x")).alias("v")).orderBy("i").collect()]


SEASONS = {
    "Show.S01E01.mkv": (1, 1, False), "Show.S01.mkv": (1, None, False), "The.Movie.1999.mkv": (None, None, False),
    "[Group] Show - 01 [1080p].mkv": (1, 1, True), "[Group] Show - 720 [1080p].mkv": (None, None, False), "2.6.mkv": (2, 6, False),
    "Movie.2020.1080p.DTS.5.1.mkv": (None, None, False), "01. Секреты.mkv": (1, 1, True), "10 Cloverfield Lane.mkv": (None, None, False),
    "Monster_[01_of_74]_[ru_jp]_[animereactor.ru].avi": (1, 1, True), "Yuru.Camp.S01.2018.AniDub.BDRip.Deadmauvlad.Ep.01.avi": (1, 1, False),
    "Show.S02.1080p.BluRay.05.mkv": (2, 5, False), "Show 1x02.mkv": (1, 2, False), "1.01. Departure.mkv": (1, 1, True),
}


def test_season_episode(spark):
    got = values(spark, SEASONS, names.season_episode)
    assert {n: (g.season, g.episode, g.assumed) for n, g in zip(SEASONS, got)} == SEASONS


TITLES = {
    "1917.2019.mkv": "1917", "2001.A.Space.Odyssey.1968.mkv": "2001 A Space Odyssey", "Uncut.Gems.2019.mkv": "Uncut Gems",
    "Midsommar (2019) DiRECTORS CUT.mkv": "Midsommar", "Gone Girl (2014).uncut_black.mkv": "Gone Girl", "MALICE (1993).avi": "Malice",
    "Spider-Man.2002.1080p.BluRay.x264-GROUP.mkv": "Spider Man", "The.Matrix.1999.mkv": "The Matrix", "10 Cloverfield Lane.mkv": "10 Cloverfield Lane",
}


def test_clean_title(spark):
    assert dict(zip(TITLES, values(spark, TITLES, names.clean_title))) == TITLES


def test_title_before_marker(spark):
    cases = {"Show Name S01E02 Pilot.mkv": "Show Name", "1.01. Departure.mkv": "", "Monster_[01_of_74]_[ru_jp]_[animereactor.ru].avi": "Monster"}
    assert dict(zip(cases, values(spark, cases, names.title_before_marker))) == cases


def test_year(spark):
    cases = {"1917.2019.mkv": 2019, "a 201920 b": 2019, "Show.1080p.mkv": None, "x1999": None, "Film (1968) 2160p": 1968}
    assert dict(zip(cases, values(spark, cases, names.year))) == cases


def test_episode_title(spark):
    cases = {"1.01. Departure.mkv": "Departure", "Show S01E17...In Translation.mkv": "...In Translation", "Show.S01E01.1080p.WEB-DL.AAC.mkv": "...", "Show.S01E02.The.Pilot.1080p.mkv": "The Pilot"}
    assert dict(zip(cases, values(spark, cases, names.episode_title))) == cases


MULTI = ["Show.S01E01E02.mkv", "Show.S01E01-E02.mkv", "Show S01E01 E02.mkv", "Show.S01E01-02.mkv", "Show 1x01 and 1x02.mkv", "Show.S03E07-08.mkv", "Show.S01E01_02.mkv", "Show.S01E01+E02.mkv"]
SINGLE = ["Show.S01E01.mkv", "Show.S01E01.10bit.mkv", "Show.S01E01-10-bit.mkv", "Show.S01E01.60 fps.mkv", "Show.S01E01-33.mkv", "Show.S01E01.12.Monkeys.mkv", "Show.S01E01.5.1.mkv", "Show.S01E01-1080p.mkv", "Show.S01E01.2020.mkv", "Movie.2020.mkv"]


def test_multi_episode(spark):
    got = values(spark, MULTI + SINGLE, names.is_multi_episode)
    assert got == [True] * len(MULTI) + [False] * len(SINGLE)
    assert values(spark, ["Show.S01E01-02.mkv", "Show.S01E05.mkv", "Film.mkv"], names.episode_numbers) == [[1, 2], [5], []]


def test_quality(spark):
    q = values(spark, ["Show.S01E01.1080p.WEB-DL.AAC.mkv", "F.2160p.BluRay.Remux.HDR10.HEVC.TrueHD.Extended.Cut.mkv", "plain.mkv", "Gone Girl (2014).uncut_black.mkv"], quality.quality)
    assert [x.label for x in q] == ["WEB-DL 1080p AAC", "BluRay Remux 2160p HDR10+ HEVC TrueHD Extended Cut/Extended", "Unknown", "Unknown"]
    assert q[0].resolution == 1080 and q[3].modifiers == []


PATHS = {
    "/media/video/anime/Angel Beats!/1/file.mkv": ("Angel Beats!", 1), "/lib/Some Show/Season 2/Some Show - 03.mkv": ("Lib Some Show", 2),
    "/media/anime/Attack on Titan/Attack on Titan S4/Attack on Titan Final Season 01.mkv": ("Attack on Titan", 4),
    "/media/tv/Natsume Yuujinchou/Natsume Yuujinchou Shi [HWP]/Show 01.mkv": (None, 4), "/media/Show/Show IV/Show 01.mkv": (None, 4),
    "/media/video/The Summer/Hikaru/Died/Season 1/episode.mkv": ("The Summer Hikaru Died", 1),
}


def test_paths(spark):
    t, s = values(spark, PATHS, paths.title_from_path), values(spark, PATHS, paths.season_from_path)
    for (p, (title, season)), a, b in zip(PATHS.items(), t, s):
        assert b == season, p
        assert title is None or a == title, p


def test_supplementary(spark):
    cases = {"Show/Specials/Show OVA 01.mkv": "supplementary directory: 'Specials'", "a/trailer.mkv": "supplementary filename: 'trailer'", "a/b/Film.mkv": "", "Extras/x/Making of.mkv": "supplementary directory: 'Extras'"}
    assert dict(zip(cases, values(spark, cases, paths.supplementary_reason))) == cases


@pytest.mark.parametrize("title,lang", [("Тьма", "ru"), ("進撃", "ja"), ("Ωμέγα", "el"), ("Dark", None), (None, None)])
def test_language(spark, title, lang):
    assert values(spark, [title], paths.detect_language) == [lang]


def test_parsing_is_dealt_to_all_cores(spark):
    """A small file of names is one task's to read, but not to parse."""
    from reelspark.operators import evidence

    files = spark.range(40).coalesce(1).selectExpr("id as file_id", "concat('/a/x.S01E0', id % 10, '.mkv') as path")
    p = evidence.parsed(files)
    assert p.rdd.getNumPartitions() > 1 and p.count() == 40


def test_second_episodes_are_told_at_a_glance(spark):
    """Names with a second episode all pass the look that spares others the search; null stays null."""
    from pyspark.sql import functions as F

    from reelspark.functions import fixed, names
    from reelspark.functions.base import hit

    yes = ["a.S01E01E02", "a.S01E01-02", "a.s01e01 and S01E02", "a.1x01-1x02", "a 1x09+10", "a.S01E01.and.E02.", "a.S01E07 & 08", "a_S01E01_-_02", "S01E01E02.mkv"]
    no = ["a.S01E01.1080p", "a.S01E01", "a.S01E01.720p.mkv", "a.S01E01.x264", "and", "", "a.S01E01-99", "a.S01E001-002.1080p"]
    d = spark.createDataFrame([(n,) for n in [*yes, *no, None]], "n string").select("n", names.is_multi_episode(F.col("n")).alias("m"), hit(F.lower("n"), fixed.SECOND_EPISODE).alias("look"))
    got = {r.n: (r.m, r.look) for r in d.collect()}
    assert all(got[n] == (True, True) for n in yes) and not any(got[n][0] for n in no) and got[None][0] is None
    assert not got["a.S01E01.1080p"][1] and not got["a.S01E01.720p.mkv"][1]


def test_rare_rules_are_tried_where_they_can_match(spark):
    """What the one look for rare rules lets through is all that these rules match, in any case and script."""
    from pyspark.sql import functions as F

    from reelspark.functions import fixed, quality

    tokens = ["TrueHD", "dts-hd", "DTS", "flac", "AAC5.1", "AC3", "DDP5.1", "mp3", "PCM", "Opus", "Dolby.Vision", "DOVI", "DV", "hdr10+", "HLG", "HDR", "Uhd.Remux", "BDRemux", "3D", *(m.replace("'", "") for m, _ in fixed.MODIFIERS), "Repack", "ﬁn", "Тьма.dv", "none"]
    n = F.col("n")
    d = spark.createDataFrame([(f"a.{t}.1080p.mkv",) for t in tokens], "n string").select("n", quality.quality(n).alias("q"), quality.audio(n).alias("audio"), quality.hdr(n).alias("hdr"), quality.modifiers(n).alias("mods"))
    rows = d.collect()
    assert all((r.q.audio, r.q.hdr, r.q.modifiers) == (r.audio, r.hdr, r.mods) for r in rows)
    assert sum(bool(r.audio or r.hdr or r.mods or r.q.is_remux or r.q.is_3d) for r in rows) == len(tokens) - 2


def test_shared_names_and_directories_are_parsed_once_with_the_same_fields(spark):
    from reelspark.operators import evidence
    from reelspark.plans.pipeline import skipped

    given = ["/tv/Show/Season 2/Show.S02E03.A.Title.1080p.mkv", "/tv/Other Show/Show.S02E03.A.Title.1080p.mkv", "/tv/Show/Extras/a.mkv", "/x/a.mkv", "a.mkv", "/a.mkv", "", None, None, "/tv/Show Ni/7x08.mkv/", "C:\\tv\\Show\\b.S01E01.mkv", "/m/Дом/Дом.2001.mkv", "/m/ü'/trailer.mkv"]
    files = spark.createDataFrame(list(enumerate(given)), "file_id long, path string")
    p = F.col("path")
    want = skipped(evidence.parsed(files)).withColumns({"dir_title": paths.title_from_path(p), "dir_season": paths.season_from_path(p)})
    once = evidence.parsed_once(files)
    got = skipped(once).select(want.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert [r[0] for r in got.orderBy("file_id").select("dir_season").head(2)] == [2, None]


def test_matches_are_split_as_by_split(spark):
    from reelspark.functions import fixed as X
    from reelspark.functions.base import after_match, before_match

    given = ["A.S01E02.b\nc", "S01E02", "x - 3x04 y", "01.02.t", "2.3", "b 12.mkv", "[12]a", "none", "", "Show.s1e2.S03E04.z", "😀.S01E02.ü"]
    df = spark.createDataFrame([(g,) for g in given], "n string")
    n = F.col("n")
    for p in (X.SERIES, X.SERIES_X, X.SEASON_DOT_EPISODE, X.SEASON_DOT_DIGIT, X.EPISODE_ALONE):
        both = F.split(n, p, 2)
        for r in df.filter(n.rlike(p)).select(both.alias("w"), before_match(n, p).alias("b"), after_match(n, p).alias("a")).collect():
            assert list(r.w) == [r.b, r.a]


def test_titles_are_cleaned_from_what_stands_before_a_marker(spark):
    given = ["A.Show.S01E02.mkv", "S01E02.x.mkv", "the show 3x04.S05E06.mkv", "[G] Show - 01 [1080p].mkv", "01.02.t.mkv", "2.6.mkv", " .S01E01", "none", "", None]
    both = values(spark, given, lambda n: F.struct(names.title_before_marker(n).alias("a"), names.title_of(names.before_marker(n)).alias("b")))
    assert [r.a for r in both] == [r.b for r in both]
    assert (both[0].a, both[1].a, both[6].a, both[-1].a) == ("A Show", "", "", None)
