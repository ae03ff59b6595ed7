from reelspark.operators.voting import fuse, update_scores, usable_values, vote

SCHEMA = "file_id int, provider string, feed_ord int, field string, value string, confidence double, weak boolean"
ORDER = {p: i for i, p in enumerate(("filename", "dirname", "file", "wikipedia", "tvmaze", "tmdb"))}


def opinions(spark, *cases):
    rows = [(i, p, ORDER[p], f, v, c, w) for i, case in enumerate(cases) for p, f, v, c, w in case]
    return spark.createDataFrame(rows, SCHEMA)


def op(p, f, v, c=None, w=False):
    return (p, f, v, c, w)


def by_case(df):
    return {(r.file_id, r.field): r for r in df.collect()}


def test_decisions(spark):
    got = by_case(fuse(opinions(
        spark,
        [op("filename", "season", "1"), op("dirname", "season", "1"), op("filename", "episode", "5"), op("dirname", "episode", "5")],
        [op("filename", "season", "1"), op("dirname", "season", "2"), op("filename", "episode", "5")],
        [op("filename", "season", "1", None, True), op("dirname", "season", "7")],
        [op("wikipedia", "ep_title", "Mount Fuji and Curry Noodles"), op("tvmaze", "ep_title", "Episode 1")],
        [op("filename", "title", "Attack on Titan Final Season"), op("dirname", "title", "Attack on Titan")],
        [op("tvmaze", "ep_title", "Episode 1"), op("wikipedia", "ep_title", "Episode 10")],
        [op("file", "season", "7", 1.0)],
        [op("filename", "season", "3", 0.6, True)],
        [op("filename", "season", "3", 0.6), op("dirname", "season", "3", 0.6), op("file", "season", "4", 1.0)],
        [op("filename", "season", "3", 0.95), op("dirname", "season", "3", 0.95), op("file", "season", "4", 1.0)],
        [op("wikipedia", "ep_title", "One thing"), op("tvmaze", "ep_title", "Some other"), op("tmdb", "ep_title", "Third quite different")],
        [op("filename", "title", "Monogatari Sries"), op("dirname", "title", "Monogatari Series")],
        [op("filename", "season", ""), op("dirname", "season", None)],
        [op("filename", "season", "0", 0.9)],
    )))
    assert got[0, "season"].decision == "accept" and got[0, "episode"].value == "5"
    assert got[1, "season"].decision == "skip" and got[1, "episode"].decision == "accept"
    assert (got[2, "season"].value, got[2, "season"].decision) == ("7", "accept")
    assert got[3, "ep_title"].value == "Mount Fuji and Curry Noodles" and got[3, "ep_title"].decision == "accept"
    assert got[4, "title"].value == "Attack on Titan" and got[4, "title"].providers == ["filename", "dirname"]
    assert len(got[5, "ep_title"].providers) == 1
    assert got[6, "season"].decision == "skip"
    assert got[7, "season"].usable
    assert got[8, "season"].decision == "skip" and got[8, "season"].confidence < 0.6
    assert got[9, "season"].decision == "accept" and got[9, "season"].confidence >= 0.6
    assert got[10, "ep_title"].decision == "guess" and got[10, "ep_title"].usable
    assert got[11, "title"].providers == ["filename", "dirname"]
    assert not any(k[0] == 12 for k in got)
    assert got[13, "season"].value == "0"
    assert all(r.confidence >= 0.6 for (_, f), r in got.items() if f in ("season", "episode") and r.usable)


def test_fuse_and_vote_agree_and_scores(spark):
    o = opinions(spark, [op("filename", "year", "1999", 0.8), op("tmdb", "year", "2000", 0.9), op("dirname", "codec", "x", 0.5)], [op("filename", "title", "A show", 0.9), op("tmdb", "title", "A show", 0.9)])
    a, b = by_case(vote(o)), by_case(fuse(o))
    assert {k: (r.value, r.decision) for k, r in a.items()} == {k: (r.value, r.decision) for k, r in b.items()}
    s = {(r.provider, r.field): r.score for r in update_scores(o, vote(o)).collect()}
    assert s == {("filename", "year"): 0.0, ("tmdb", "year"): 1.0, ("filename", "title"): 1.0, ("tmdb", "title"): 1.0}
    assert {r.file_id: (r.title, r.year) for r in usable_values(vote(o), ("title", "year")).collect()} == {0: (None, "2000"), 1: ("A show", None)}


def test_scores_break_ties_and_entities_join(spark):
    o = opinions(spark, [op("wikipedia", "year", "1999"), op("tvmaze", "year", "2001")])
    scores = spark.createDataFrame([("tvmaze", "year", 3.0)], "provider string, field string, score double")
    assert by_case(vote(o))[0, "year"].value == "1999" and by_case(vote(o, scores))[0, "year"].value == "2001"
    from pyspark.sql import functions as F

    t = opinions(spark, [op("filename", "title", "Yuru Camp"), op("tvmaze", "title", "Laid-Back Camp")])
    assert len(by_case(vote(t))[0, "title"].providers) == 1
    assert len(by_case(vote(t.withColumn("qid", F.lit("Q1"))))[0, "title"].providers) == 2


def test_filters_of_verdicts_do_not_repeat_the_vote(spark):
    """A filter of usable verdicts looks at what the vote has settled; it doesn't hold the vote itself."""
    o = opinions(spark, [op("filename", "season", "1", 0.9)])
    plan = usable_values(vote(o), ("season",))._jdf.queryExecution().optimizedPlan().toString()
    assert not any("aggregate(" in line for line in plan.splitlines() if "Filter " in line)
    assert [tuple(r) for r in usable_values(vote(o), ("season",)).collect()] == [(0, "1")]


def test_both_readings_come_from_one_vote(spark):
    from reelspark.operators.voting import readings

    o = opinions(
        spark,
        [op("filename", "season", "1", 0.9), op("dirname", "season", "2", 0.8), op("tmdb", "year", "1999", 0.7)],
        [op("filename", "season", "1", 0.6, True), op("file", "codec", "x264", 0.95), op("filename", "codec", "HEVC", 0.5)],
        [op("filename", "title", "A Show", 0.9), op("tvmaze", "title", "A Show!", 0.9), op("dirname", "title", "Other", 0.2), op("file", "season", "", 0.2)],
    )
    a, b, r = by_case(vote(o)), by_case(fuse(o)), by_case(readings(o))
    assert a.keys() == b.keys() == r.keys() and len(r) == 5
    for k, x in r.items():
        assert (x.value, x.decision, x.usable, x.share) == (a[k].value, a[k].decision, a[k].usable, a[k].confidence)
        assert (x.value, x.decision, x.usable, x.posterior) == (b[k].value, b[k].decision, b[k].usable, b[k].confidence)


def test_equal_ballots_are_judged_once(spark, monkeypatch):
    """``fuse_same`` says what ``fuse`` says, of as many ballots as differ; nulls in a ballot are equal to each other."""
    from pyspark.sql import functions as F

    from reelspark.operators import voting as V
    from reelspark.plans.cut import cut

    same = [op("filename", "title", "A Show", 0.9), op("tvmaze", "title", "The Shaw"), op("dirname", "title", "Lib", 0.7), op("file", "codec", "x264")]
    o = opinions(spark, *[same] * 40, [op("filename", "title", "A Show", 0.8), op("tvmaze", "title", "The Shaw")], [op("filename", "season", "1", 0.6, True), op("dirname", "season", "2")], [op("filename", "year", "")])
    judged, counts = V.judged, []

    def counted(g, scores=None):
        g = cut(g)
        counts.append(g.count())
        return judged(g, scores)

    want = sorted(map(str, V.fuse(o).collect()))
    monkeypatch.setattr(V, "judged", counted)
    assert sorted(map(str, V.fuse_same(o).select(V.fuse(o).columns).collect())) == want and len(want) == 82 and 4 in counts
    assert V.fuse_same(o.filter(F.lit(False))).count() == 0
