import json
import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from reelspark.functions import media
from reelspark.operators import allocate, catalogs, evidence, render, wikitext
from reelspark.plans.directory import main, process_directory
from reelspark.plans.pipeline import Options, counters, identify, plan
from reelspark.sources import probe, scan, sink


def files(spark, *paths):
    return spark.createDataFrame(list(enumerate(paths)), "file_id long, path string")


def test_plan(spark):
    f = files(
        spark, "/m/The.Matrix.1999.mkv", "/m/Gone Girl (2014).uncut_black.mkv", "/tv/Show/Show.S01E02.The.Pilot.1080p.mkv", "/tv/Show/Extras/Show.S01E03.mkv",
        "/tv/Show/Show.S01E01E02.mkv", "/x/The.Matrix.1999.mkv", "/tv/Dark Show/Season 2/Dark Show S01E04 Name.mkv",
    )
    planned = plan(f)
    p = {r.file_id: r for r in planned.collect()}
    assert (p[0].new_name, p[0].status) == ("The Matrix (1999).mkv", "renamed")
    assert p[1].new_name == "Gone Girl (2014).mkv"
    assert p[2].new_name == "01.02. The Pilot.mkv"
    assert p[3].status == "skipped" and "Extras" in p[3].reason and p[4].status == "skipped"
    assert p[5].dest_name == "The Matrix (1999)_1.mkv" and p[0].dest_name == "The Matrix (1999).mkv"
    assert p[6].status == "unchanged" and p[6].reason == "disputed: season"
    assert counters(planned).collect()[0].asDict() == {"renamed": 4, "total": 7, "errors": 0}
    assert plan(f, Options(template="{title}.{season:02d}x{episode:02d}.{ext}", season=3)).filter("file_id = 6").first().new_name == "Dark Show.03x04.mkv"


def test_catalog_evidence(spark):
    f = files(spark, "/tv/Show/Show.S01E02.mkv")
    found = spark.createDataFrame([(0, "Show", 2010, "A Tale")], "file_id long, title string, year int, ep_title string")
    r = identify(f, Options(catalogs={"tvmaze": found})).first()
    assert (r.ep_title, r.year, r.season, r.episode) == ("A Tale", 2010, 1, 2)
    assert plan(f).first().reason == "no episode title"


def test_render(spark):
    one = spark.range(1)
    names = ['a "b" c "d', "x?y*z:/|", "end. ."]
    got = [one.select(render.sanitize(F.lit(n))).first()[0] for n in names]
    assert got == ["a “b” c “d", "x？y×z∶∕_", "end"]
    assert [one.select(render.sanitize(F.lit(n))).first()[0] for n in got] == got
    assert one.select(render.render("{title} ({year}) {mod}.{ext}", {"title": F.lit("A"), "year": F.lit(0), "mod": F.lit(""), "ext": F.lit("mkv")})).first()[0] == "A.mkv"
    assert one.select(render.render("{nope}", {})).first()[0] == ""
    with pytest.raises(ValueError):
        render.fields_of("{title")


def test_allocate(spark):
    rows = [("/a/1", "N.mkv"), ("/a/2", "N.mkv"), ("/b/3", "N_1.mkv"), ("/b/4", "M.mkv"), ("/b/M.mkv", "M.mkv"), ("/c/5", "E.mkv"), ("/d/6", "Q.mkv"), ("/d/7", "Q.mkv"), ("/d/7", "Q.mkv"), ("/e/P.mkv", "R.mkv"), ("/e/x", "P.mkv")]
    w = spark.createDataFrame([(i, p, p.rpartition("/")[0], n) for i, (p, n) in enumerate(rows)], "file_id long, path string, dir string, new_name string")
    e = spark.createDataFrame([("/c", "E.mkv"), ("/c", "E_1.mkv"), *((p.rpartition("/")[0], p.rpartition("/")[2]) for p, _ in rows)], "dir string, name string")
    got = {r.file_id: r.dest_name for r in allocate.allocate(w, e).collect()}
    # a name that lies beside a file is taken, even if its holder is renamed itself
    assert [got[i] for i in range(len(rows))] == ["N.mkv", "N_1.mkv", "N_1_1.mkv", "M_1.mkv", "M.mkv", "E_2.mkv", "Q.mkv", "Q_1.mkv", "Q_2.mkv", "R.mkv", "P_1.mkv"]


def one_by_one(files, there, moves):
    """Renames one after another: files (id, path, name wanted), there: (directory, name) of all that lies there."""
    there, reserved, out = set(there), set(), {}
    for i, path, name in sorted(files, key=lambda f: (f[1], f[0])):
        folder, old = path.rpartition("/")[::2]
        base, ext = os.path.splitext(name)
        new, n = name, 0
        if old != name:
            while (folder, new) in there or new in reserved:
                n += 1
                new = f"{base}_{n}{ext}"
            reserved.add(new)
            if moves:
                there.discard((folder, old))
                there.add((folder, new))
        out[i] = new
    return out


def allocated(spark, files, there, moves):
    w = spark.createDataFrame([(i, p, p.rpartition("/")[0], n) for i, p, n in files], "file_id long, path string, dir string, new_name string").repartition(3)
    rows = allocate.allocate(w, spark.createDataFrame(sorted(there), "dir string, name string"), sequential=moves).collect()
    assert len(rows) == len(files)
    return {r.file_id: r.dest_name for r in rows}


@pytest.mark.parametrize("moves", [False, True])
@pytest.mark.parametrize("seed", [1, 3, 5])
def test_allocation_as_one_by_one(spark, seed, moves):
    """Corpora full of names that look like suffixed ones, wanted by files that hold them, above each other or beside."""
    r = random.Random(seed)
    stems = ["A", "A_1", "A_2", "A_1_1", "A_01", "B", "B_3", ".hidden", "A_99999999999999999999"][: 3 + seed * 2]
    name = lambda: r.choice(stems) + r.choice(["", "", "_1", "_2", "_3", "_4", "_10"]) + r.choice([".mkv", ".mkv", ""])
    paths = sorted({f"{r.choice(['', '/a', '/b', '/a/b', '/c'])}/{name()}" for _ in range(120)} | {f"/d/x{i}" for i in range(40)} | {f"/a/zz{i}.mkv" for i in range(20)})
    few = [name() for _ in range(1 + seed)]
    files = [(i, p, r.choice(few) if r.random() < 0.8 else name()) for i, p in enumerate(paths)]
    kept = {tuple(p.rpartition("/")[::2]) for p in paths} | {(r.choice(["/a", "/c", "/e"]), name()) for _ in range(10)}
    files = [f for f in files if r.random() < 0.8]
    assert allocated(spark, files, kept, moves) == one_by_one(files, kept, moves)


def test_names_that_are_freed(spark):
    """Each file takes the name of the one before it, two change places, and a whole directory is named again."""
    shift = [(i, f"/s/{i:03}.mkv", f"{i - 1:03}.mkv") for i in range(1, 50)]
    swap = [(100, "/t/a", "b"), (101, "/t/b", "a")]
    again = [(200 + i, f"/u/N_{i}.mkv" if i else "/u/N.mkv", "N.mkv") for i in range(60)]
    files = [*shift, *swap, *again]
    there = {tuple(p.rpartition("/")[::2]) for _, p, _ in files}
    real, dry = allocated(spark, files, there, True), allocated(spark, files, there, False)
    assert real == one_by_one(files, there, True) and dry == one_by_one(files, there, False)
    assert all(real[i] == n for i, _, n in shift) and (real[100], real[101]) == ("b_1", "a") and dry[2] == "001_1.mkv"


def test_what_settles_a_family(spark, monkeypatch):
    """A family of many files is settled by a few rows, and all of them are right."""
    files = [(i, f"/m/{i:05}.mkv", "N.mkv") for i in range(3000)] + [(5000 + i, f"/n/{i:05}.mkv", "N.mkv") for i in range(2000)] + [(9000, "/o/x.mkv", "N_7.mkv")]
    there = {("/n", "N.mkv"), *(("/n", f"N_{k}.mkv") for k in range(3500, 3600)), ("/n", "N_5.mkv")}
    assert allocated(spark, files, there, True) == one_by_one(files, there, True)
    spans = allocate.Spans()
    for a, b in ((5, 6), (1, 1), (9, 9), (2, 2), (7, 8)):
        spans.add(a, b)
    assert (spans.starts, spans.ends) == ([1, 5], [2, 9]) and spans.end(8) == 9 and spans.end(3) is None and spans.next(2) == 5
    spans.remove(7)
    assert (spans.starts, spans.ends) == ([1, 5, 8], [2, 6, 9])


def test_plan_keeps_what_lies_beside(spark):
    f = files(spark, "/m/The.Matrix.1999.mkv", "/m/The Matrix (1999).mkv", "/m/The.Matrix.1999.mkv")
    p = {r.file_id: r for r in plan(f).collect()}
    assert [p[i].dest_name for i in range(3)] == ["The Matrix (1999)_1.mkv", "The Matrix (1999).mkv", "The Matrix (1999)_2.mkv"] and p[1].status == "unchanged"


def test_media(spark):
    js = '{"streams":[{"codec_type":"video","codec_name":"hevc","height":1072,"color_transfer":"smpte2084","bit_rate":"4500999"},{"codec_type":"audio","codec_name":"aac","channels":2,"tags":{"language":"jpn"}},{"codec_type":"audio","codec_name":"dts","channels":6}],"format":{"tags":{"show_name":" A show ","season":"x","season_number":"3","episode":"12"}}}'
    df = spark.createDataFrame([(js,), ("nope",)], "j string").select(media.probe(F.col("j")).alias("p"))
    r = df.select(media.file_info(F.col("p")).alias("i"), media.tag_values(F.col("p.format.tags")).alias("t")).first()
    assert (r.i.video.codec, r.i.video.resolution, r.i.video.hdr, r.i.video.bitrate, r.i.audio, r.i.channels, r.i.audio_lang) == ("HEVC", 1080, "HDR10", 4500, "AAC", 6, "jpn")
    assert (r.t.show_name, r.t.season, r.t.episode, r.t.ep_title) == ("A show", 3, 12, None)


def test_catalogs(spark):
    hits = spark.createDataFrame([("Dark", 1, 7, "Darkness", 0.9), ("Dark", 2, 8, "dark", 0.4), ("Office", 1, 9, "Office", 0.1), ("Low", 1, 3, "Other", 0.2)], "query string, rank int, show_id int, name string, score double")
    t = spark.createDataFrame([("Dark",), ("The Office",), ("Low",)], "title string")
    assert {r.title: r.show_id for r in catalogs.search_shows(t, hits).collect()} == {"Dark": 8, "The Office": 9}
    eps = spark.createDataFrame([(8, 1, 1, "One", "regular", 1), (8, 1, 1, "Uno", "regular", 2), (8, 1, None, "Sp", "special", 3)], "show_id int, season int, number int, name string, type string, ord int")
    f = spark.createDataFrame([(0, 8, 1, 1), (1, 8, 1, 9)], "file_id int, show_id int, season int, episode int")
    assert {r.file_id: r.ep_title for r in catalogs.episode_titles(f, eps).collect()} == {0: "One", 1: None}
    assert catalogs.special_titles(f, eps).filter("episode = 1").first().ep_title == "Sp"
    files_ = spark.createDataFrame([(0, "Тьма", True, None, "ru", "en"), (1, "Она", False, 2006, "ru", "en"), (2, "X", None, None, "en", "en")], "file_id int, title string, is_series boolean, year int, source_lang string, target_lang string")
    pages = spark.createDataFrame([("Тьма", 1, "p1"), ("Тьма", 2, "p2"), ("Она", 1, "p3"), ("Она", 2, "p4")], "query string, rank int, page string")
    ids = spark.createDataFrame([("p1", "q1"), ("p2", "q2"), ("p3", "q3"), ("p4", "q4")], "page string, qid string")
    ents = spark.createDataFrame([("q1", ["Q1"], None, {}), ("q2", ["Q5398426"], 2017, {"en": "Dark"}), ("q3", ["Q11424"], 2013, {}), ("q4", ["Q11424"], 2006, {})], "qid string, types array<string>, year int, labels map<string,string>")
    links = spark.createDataFrame([("p2", "en", "Dark (TV series)"), ("p4", "en", "She's the Man"), ("p3", "en", "Her (film)")], "page string, to_lang string, name string")
    assert {r.file_id: r.translated for r in catalogs.translations(files_, pages, ids, ents, links).collect()} == {0: "Dark", 1: "She's the Man", 2: "X"}


def test_wikitext(spark):
    text = "==Season 2==\n{{Episode list\n|EpisodeNumber=13\n|EpisodeNumber2=1\n|Title=[[A|The ''First'']]&amp; more<ref>x</ref>\n}}\n{{Episode list\n|EpisodeNumber=14\n|EpisodeNumber2=2\n|Title=\"Second\"\n}}\n==OVA==\n{{Episode list/sublist\n|EpisodeNumber=1\n|Title=Extra\n}}"
    pages = spark.createDataFrame([("Show", text)], "page string, text string")
    assert [(r.season, r.number, r.title) for r in wikitext.episodes(pages).orderBy("ord").collect()] == [(2, 1, "The First& more"), (2, 2, "Second"), (0, 1, "Extra")]
    y = spark.createDataFrame([("S", "a", "|first_aired = {{Start date|2020|1}}"), ("S", "b", "|released=2018")], "title string, page string, text string")
    assert wikitext.first_year(y).first().year == 2018


def test_scan_and_sink(spark, tmp_path):
    for p in ("movie.mkv", "show.mp4", "clip.AVI", "readme.txt", "sub/movie.mkv", "sub/deep/series.mp4", ".hidden/movie.mkv", "_u/.h.mkv"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"")
    found = [os.path.relpath(r.path, tmp_path) for r in scan.find_video_files(spark, str(tmp_path)).collect()]
    assert found == ["_u/.h.mkv", "clip.AVI", "movie.mkv", "show.mp4", "sub/deep/series.mp4", "sub/movie.mkv"]
    assert scan.find_video_files(spark, str(tmp_path), recursive=False).count() == 3 and scan.find_video_files(spark, "/nowhere").count() == 0
    os.symlink("/nowhere", tmp_path / "New.mkv")
    planned = spark.createDataFrame([(0, str(tmp_path / "movie.mkv"), "movie.mkv", "New.mkv", "New.mkv", "renamed", ""), (1, str(tmp_path / "gone.mkv"), "gone.mkv", "x.mkv", "x.mkv", "renamed", "")], "file_id long, path string, old_name string, new_name string, dest_name string, status string, reason string")
    done = {r.file_id: r for r in spark.createDataFrame(sink.apply(planned).collect()).collect()}
    assert done[0].dest_name == "New_1.mkv" and (tmp_path / "New_1.mkv").exists() and not (tmp_path / "movie.mkv").exists() and done[1].status == "error"


PLAN = "file_id long, path string, old_name string, new_name string, dest_name string, status string, reason string"


def planned(spark, folder, moves):
    """A plan of moves (old name, wanted, given) in one folder."""
    return spark.createDataFrame([(i, f"{folder}/{a}", a, w, b, "renamed", "") for i, (a, w, b) in enumerate(moves)], PLAN)


def make(folder, *names):
    folder.mkdir(parents=True, exist_ok=True)
    for n in names:
        (folder / n).write_bytes(n.encode())


def test_renames_in_order(spark, tmp_path):
    """Long chains, in which each file waits for the one before it, circles, and files that wait for nothing."""
    chain = [(f"{i:03}.mkv", f"{i - 1:03}.mkv", f"{i - 1:03}.mkv") for i in range(1, 120)]
    free = [(f"f{i}", f"g{i}", f"g{i}") for i in range(30)]
    circle = [("x", "y", "y"), ("y", "z", "z"), ("z", "x", "x")]
    make(tmp_path, *(a for a, _, _ in [*chain, *free, *circle]))
    p = planned(spark, tmp_path, [*chain, *free, *circle]).repartition(7)
    c = {r.path.rpartition("/")[2]: r.chain.rpartition("/")[2] for r in sink.chains(p.select("path", F.concat(F.lit(f"{tmp_path}/"), "dest_name").alias("dest"))).collect()}
    assert {c[a] for a, _, _ in chain} == {"001.mkv"} and all(c[a] == a for a, _, _ in free) and {c[a] for a in "xyz"} == {"x"}
    done = {r.old_name: r.dest_name for r in sink.apply(p).collect()}
    assert all(done[a] == b and (tmp_path / b).read_bytes() == a.encode() for a, _, b in [*chain, *free])
    # the first of a circle can't wait for itself; the others find the names that were freed
    assert (done["x"], done["y"], done["z"]) == ("y_1", "z_1", "x") and sorted(os.listdir(tmp_path))[-3:] == ["x", "y_1", "z_1"]


def test_repeated_attempts(tmp_path):
    """A second attempt of a task reports what the first one did, whatever it was lost in."""
    make(tmp_path / "m", "a", "b", "c", "d", "e", "T_a", "U")
    writer = sink.RenameWriter(str(tmp_path / "j"))
    rows = [Row(file_id=str(i), path=str(tmp_path / "m" / n), new_name=f"T_{n}", dest_name=f"T_{n}", known=None) for i, n in enumerate("abcd")]
    outcome = lambda m: {r["file_id"]: r["done_name"] or "!" for r in map(json.loads, open(m.path))}
    first = outcome(writer.write(iter(rows[:2])))  # another program had made T_a
    assert first == {"0": "T_a_1", "1": "T_b"}
    (tmp_path / "m" / "T_a").unlink()
    make(tmp_path / "m", "T_a")
    os.link(tmp_path / "m" / "c", tmp_path / "m" / "T_c")  # the first attempt was lost between link and unlink
    j = sink.Journal(str(tmp_path / "j" / "journal" / "000000"))
    j.intend(sink.identity(str(tmp_path / "m" / "c")), str(tmp_path / "m" / "c"), str(tmp_path / "m" / "T_c"))
    j.out.write('{"identity": "cut sho')
    j.close()
    os.unlink(tmp_path / "m" / "d")  # by another program, to which the journal knows nothing
    message = writer.write(iter(rows))
    assert outcome(message) == {"0": "T_a_1", "1": "T_b", "2": "T_c", "3": "!"}
    assert sorted(os.listdir(tmp_path / "m")) == ["T_a", "T_a_1", "T_b", "T_c", "U", "e"] and (tmp_path / "m" / "T_c").read_bytes() == b"c"
    os.link(tmp_path / "m" / "e", tmp_path / "m" / "T_e")  # a second name that no attempt has made is another file's
    e = Row(file_id="e", path=str(tmp_path / "m" / "e"), new_name="T_e", dest_name="T_e", known=None)
    assert outcome(writer.write(iter([e]))) == {"e": "T_e_1"}
    writer.commit([message, None])
    assert json.load(open(tmp_path / "j" / "manifest.json")) == [message.path]


def test_two_attempts_at_a_time(tmp_path):
    """Speculative attempts of one task, side by side: no file is lost, and both report the name that it has."""
    from concurrent.futures import ThreadPoolExecutor

    names = [f"n{i}" for i in range(200)]
    make(tmp_path / "m", *names, *(f"T{i}" for i in range(0, 200, 3)))
    rows = [Row(file_id=n, path=str(tmp_path / "m" / n), new_name=f"T{n[1:]}", dest_name=f"T{n[1:]}", known=None) for n in names]
    writer = sink.RenameWriter(str(tmp_path / "j"))
    with ThreadPoolExecutor(3) as pool:
        messages = list(pool.map(lambda _: writer.write(iter(rows)), range(3)))
    for m in messages:
        for r in map(json.loads, open(m.path)):
            assert r["failure"] is None and (tmp_path / "m" / r["done_name"]).read_bytes() == r["file_id"].encode()
    assert len(os.listdir(tmp_path / "m")) == 200 + 67


def test_a_plan_is_applied_again(spark, tmp_path):
    make(tmp_path / "m", "a", "b")
    p = planned(spark, tmp_path / "m", [("a", "A", "A"), ("b", "B", "B"), ("gone", "C", "C")])
    journal = str(tmp_path / "j")
    key = lambda d: [(r.dest_name, r.status) for r in d.orderBy("file_id").collect()]
    assert key(sink.apply(p.limit(1), journal=journal)) == [("A", "renamed")]
    assert key(sink.apply(p, journal=journal)) == [("A", "renamed"), ("B", "renamed"), ("C", "error")]
    assert sorted(os.listdir(tmp_path / "m")) == ["A", "B"] and key(sink.apply(p.limit(0))) == []


def test_renames_without_links(tmp_path, monkeypatch):
    def no_link(*a, **k):
        raise OSError(1, "not permitted")

    (tmp_path / "a.mkv").write_bytes(b"A")
    (tmp_path / "b.mkv").write_bytes(b"B")
    monkeypatch.setattr(sink.os, "link", no_link)
    sink.rename_no_clobber(str(tmp_path / "a.mkv"), str(tmp_path / "c.mkv"))
    assert (tmp_path / "c.mkv").read_bytes() == b"A" and not (tmp_path / "a.mkv").exists()
    with pytest.raises(FileExistsError):
        sink.rename_no_clobber(str(tmp_path / "b.mkv"), str(tmp_path / "c.mkv"))
    monkeypatch.setattr(sink.ctypes, "CDLL", lambda *a, **k: object())
    with pytest.raises(OSError):
        sink.rename_no_clobber(str(tmp_path / "b.mkv"), str(tmp_path / "d.mkv"))
    assert (tmp_path / "b.mkv").read_bytes() == b"B" and (tmp_path / "c.mkv").read_bytes() == b"A" and not (tmp_path / "d.mkv").exists()


def test_directory(spark, tmp_path, capsys):
    for n in ("Show.S01E02.The.Pilot.1080p.mkv", "The.Matrix.1999.mkv", "sub/The.Matrix.1999.mp4", "note.txt"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(n.encode())
    done, counts = process_directory(spark, str(tmp_path), dry_run=True)
    assert counts == (3, 3, 0) and (tmp_path / "The.Matrix.1999.mkv").exists()
    assert main(["-d", str(tmp_path)], spark) == 0 and "3 of 3 files renamed" in capsys.readouterr().out
    assert sorted(os.path.relpath(p, tmp_path) for p in tmp_path.rglob("*.m*")) == ["01.02. The Pilot.mkv", "The Matrix (1999).mkv", "sub/The Matrix (1999).mp4"]
    assert (tmp_path / "The Matrix (1999).mkv").read_bytes() == b"The.Matrix.1999.mkv"
    assert main(["-d", str(tmp_path / "nowhere")], spark) == 1 and main(["-d", str(tmp_path), "-n"], spark) == 0


def test_probe(spark, tmp_path):
    (tmp_path / "ok").write_text('{"streams":[]}')
    (tmp_path / "bad").write_text("{")
    f = files(spark, *(str(tmp_path / n) for n in ("ok", "bad", "gone")))
    assert [r.json for r in probe.probe_files(f, ("cat",)).orderBy("file_id").collect()] == ['{"streams":[]}', None, None]


def test_identity(spark):
    f = files(spark, "/a/Dark - S01E01-33.mkv", "/a/Show.S01E01.5.1.mkv", "/a/Some Film.mkv", "/a/x [OVA].mkv", "/a/Show.S01E01-02.mkv", "", "/a/Show - 05.mkv")
    i = [r.identity for r in evidence.identity(evidence.parsed(f)).orderBy("file_id").collect()]
    assert [x.media_type for x in i] == ["series_episode", "series_episode", "movie", "series_episode", "series_episode", "unknown", "series_episode"]
    assert [x.status for x in i] == ["ambiguous", "identified", "identified", "identified", "identified", "unresolved", "identified"]
    assert i[4].episodes == [1, 2] and i[4].is_multi_episode.value and i[2].is_multi_episode is None and i[6].season.confidence == 0.7


def test_wanted_names_are_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def note(s):
        seen.add(1)
        return s

    w = spark.createDataFrame([(i, f"/d/{i}", "/d", "a.mkv" if i else "0") for i in range(6)], "file_id long, path string, dir string, new_name string")
    w = w.withColumn("new_name", F.udf(note, "string").asNondeterministic()("new_name"))
    assert sorted(r.dest_name for r in allocate.allocate(w, w.select("dir", F.lit("b").alias("name"))).collect()) == ["0", "a.mkv", "a_1.mkv", "a_2.mkv", "a_3.mkv", "a_4.mkv"]
    assert seen.value == 6
