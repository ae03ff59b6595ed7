"""Catalogs in the plan and the command; entities, exports and redirects."""

import json
import os
import random
from dataclasses import replace

from pyspark.sql import functions as F

from reelspark.operators import entities, evidence, search, wikitext
from reelspark.plans import lookups
from reelspark.plans.directory import main, process_directory
from reelspark.plans.pipeline import Options, identify, plan
from reelspark.sources import dump, scan


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def library(spark, language="en"):
    """Pages, shows and films as a user might have cached them."""
    text = "== Season 1 ==\n{{Episode list\n| EpisodeNumber = 1\n| Title = Secrets\n}}\n{{Episode list\n| EpisodeNumber = 2\n| Title = Lies\n}}\n"
    names = table(spark, "id long, name string", (1, "Тьма"), (2, "List of Dark episodes"), (3, "Dark"))
    wiki = lookups.Wiki(
        search.build_index(names), table(spark, "page string, qid string", ("Тьма", "q1")), table(spark, "qid string, types array<string>, year int, labels map<string,string>", ("q1", ["Q5398426"], 2017, {"en": "Dark", "de": "Dunkel"})),
        table(spark, "page string, to_lang string, name string", ("Тьма", "en", "Dark (TV series)")), table(spark, "page string, text string", ("List of Dark episodes", text), ("Dark", "| first_aired = {{Start date|2017|12|1}}")),
    )
    shows = lookups.Shows(
        table(spark, "query string, rank int, show_id int, name string, score double", ("Show", 1, 7, "show", 0.3)), table(spark, "show_id int, name string, premiered string", (7, "Show", "2001-02-03")),
        table(spark, "show_id int, season int, number int, name string, type string, ord int", (7, 2, 3, "The Third", "regular", 1)),
    )
    films = lookups.Films(
        table(spark, "query string, rank int, show_id int, first_air_date string"), table(spark, "show_id int, season int, number int, name string, ord int"),
        table(spark, "query string, rank int, title string, original_title string, release_date string", ("Some Film", 1, "Some Film", "", "1984-05-06")),
    )
    return lookups.Library(language, wiki, shows, films)


def test_a_plan_with_catalogs(spark):
    paths = ["/a/Тьма.S01E02.mkv", "/a/Show.S02E03.mkv", "/a/Some.Film.mkv", "/a/Show.S02E09.mkv", "/a/Extras/Show.S02E03.mkv"]
    f = spark.createDataFrame(list(enumerate(paths)), "file_id long, path string")
    o = Options(library=library(spark))
    p = {r.file_id: r for r in identify(f, o).collect()}
    assert [(p[i].title, p[i].year) for i in range(4)] == [("Dark", 2017), ("Show", 2001), ("Some Film", 1984), ("Show", 2001)]
    new = {r.file_id: (r.new_name, r.status) for r in plan(f, o).collect()}
    assert new[0] == ("01.02. Lies.mkv", "renamed") and new[1] == ("02.03. The Third.mkv", "renamed") and new[2] == ("Some Film (1984).mkv", "renamed")
    assert new[3][1] == new[4][1] == "skipped"
    known = {r.file_id: (r.title, r.ep_title) for r in lookups.identified(evidence.parsed(f), library(spark)).collect()}
    assert known[0][0] == "Dark" and known[1] == ("Show", "The Third") and known[2][0] == "Some Film"
    french = Options(library=replace(library(spark, "fr"), explicit=True))
    assert [(r.status, r.reason) for r in plan(f.filter("file_id < 2"), french).orderBy("file_id").collect()] == [("skipped", "no translation from ru"), ("renamed", "")]
    german = lookups.translated(evidence.parsed(f), library(spark, "de")).filter("file_id = 0").first()
    assert german.title == "Dunkel"


def test_the_command_with_catalogs(spark, tmp_path, capsys):
    lib = library(spark)
    for part in ("shows", "films"):
        for name in lookups.TABLES[part]:
            getattr(getattr(lib, part), name).write.parquet(f"{tmp_path}/lib/{part}/{name}.parquet")
    (tmp_path / "m").mkdir()
    for n in ("Show.S02E03.mkv", "Some.Film.mkv"):
        (tmp_path / "m" / n).write_text(n)
    found = lookups.library_at(spark, f"{tmp_path}/lib")
    assert found.wiki is None and found.shows is not None
    assert main(["-d", str(tmp_path / "m"), "--library", str(tmp_path / "lib"), "-l", "en"], spark) == 0
    assert sorted(os.listdir(tmp_path / "m")) == ["02.03. The Third.mkv", "Some Film (1984).mkv"]
    for bad in (["-l", "english"], ["--library", "/nowhere"], ["-p", "{title:d}"]):
        assert main(["-d", str(tmp_path / "m"), *bad], spark) == 1 and "error" in capsys.readouterr().err


def test_an_interrupt(spark, tmp_path, monkeypatch):
    from reelspark.plans import directory

    def stop(*a, **k):
        raise KeyboardInterrupt

    monkeypatch.setattr(directory, "process_directory", stop)
    assert main(["-d", str(tmp_path)], spark) == 130


def test_probes_in_a_directory(spark, tmp_path):
    """What a container says outweighs the name; files that can't be probed, and those that are skipped, go by the name."""
    facts = '{"streams":[{"codec_type":"video","codec_name":"hevc","height":2160}],"format":{"tags":{}}}'
    for n, text in (("A.Film.1999.1080p.mkv", facts), ("B.Film.1999.1080p.mkv", "{")):
        (tmp_path / n).write_text(text)
    done, _ = process_directory(spark, str(tmp_path), Options(template="{title} {resolution}.{ext}"), dry_run=True, prober=("cat",))
    assert sorted(r.dest_name for r in done.collect()) == ["A Film 2160p.mkv", "B Film 1080p.mkv"]


def test_entities(spark):
    value = lambda v: {"mainsnak": {"datavalue": {"value": v}}}
    claims = {"P31": [value({"id": "Q2"}), value("text"), {}, value({"id": "Q10"}), value({"id": 5})], "P577": [value("x"), value({"time": "2001"}), value({"time": "+1999-01-01"})], "P580": [value({"time": "+1950"})]}
    ok = lambda qid, **e: json.dumps({"entities": {qid: e}})
    raw = [
        ("a", ok("a", claims=claims, labels={"en": {"value": "A"}, "de": {}})), ("b", ok("b", claims={"P580": [value({"time": "-0044-03-15"})]})), ("c", ok("c", claims={})), ("d", ok("x", claims=claims)),
        ("e", "{"), ("f", None), ("g", ok("g")), ("h", ok("h", claims={"P31": [value({"id": "Q1"})]})), ("i", ok("i", claims={"P577": [value({"time": "+0000"})], "P31": []})),
    ]
    got = {r.qid: (r.types, r.year, r.labels) for r in entities.entities(table(spark, "qid string, json string", *raw)).collect()}
    assert got == {"a": (["5", "Q10", "Q2"], 1999, {"en": "A"}), "b": ([], 44, {}), "h": (["Q1"], None, {}), "i": ([], 0, {})}


def test_redirects(spark):
    """Random pointers, chains of many steps, circles and pages that don't exist, against a walk."""
    r = random.Random(3)
    to = {f"p{i}": f"p{r.randrange(80)}" for i in range(60)} | {f"c{i}": f"c{i + 1}" for i in range(100)} | {"x": "y", "y": "x", "z": "x", "self": "self"}

    def walk(p):
        for _ in range(len(to) + 1):
            if p not in to:
                return p
            p = to[p]

    want = {p: end for p in to if (end := walk(p)) is not None}
    got = {x.page: x.target for x in wikitext.redirected(table(spark, "page string, target string", *to.items())).collect()}
    assert got == want and got["c0"] == "c100" and "x" not in got
    assert wikitext.redirected(table(spark, "page string, target string")).count() == 0


def test_an_export(spark, tmp_path):
    page = lambda title, body, ns=0: f"<page><title>{title}</title><ns>{ns}</ns>{body}</page>"
    rev = lambda t: f'<revision><id>1</id><text xml:space="preserve">{t}</text></revision>'
    xml = "<mediawiki>" + page("Dark", rev("old") + rev("{{x}} &amp; new\nline")) + page("Darkness", '<redirect title="Dark" />' + rev("#REDIRECT [[Dark]]")) + page("Talk:Dark", rev("talk"), 1) + page("Empty", "") + "</mediawiki>"
    (tmp_path / "d.xml").write_text(xml)
    pages = dump.read_pages(spark, str(tmp_path / "d.xml"))
    assert sorted(map(tuple, pages.collect()), key=repr) == [("Dark", "{{x}} & new\nline", None), ("Darkness", "#REDIRECT [[Dark]]", "Dark"), ("Empty", "", None)]
    assert {r.page: r.text for r in wikitext.followed(pages).collect()} == {"Dark": "{{x}} & new\nline", "Darkness": "{{x}} & new\nline", "Empty": ""}


def test_scan_by_levels(spark, tmp_path):
    want = []
    for i in range(40):
        d = tmp_path / f"d{i % 4}" / f"e{i % 8}" / ("." if i % 5 else ".h")
        d.mkdir(parents=True, exist_ok=True)
        (d / f"f{i}.mkv").write_bytes(b"x" * i)
        if i % 5:
            want.append((str(d / f"f{i}.mkv"), i))
    os.symlink(tmp_path / "d0", tmp_path / "link")
    os.symlink("/nowhere", tmp_path / "gone.mkv")
    got = scan.find_video_files(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == sorted(want)
    spark.dataSource.register(scan.VideoFiles)
    assert sorted(map(tuple, spark.read.format("videofiles").load(str(tmp_path)).collect())) == sorted(want)
    assert got.agg(F.sum("size")).first()[0] == sum(n for _, n in want)
