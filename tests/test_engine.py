"""Scanning, extraction, storage, watching, snippets, diagnosis, command line and HTTP."""

import json
import os
import threading
import time
import urllib.request
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from textmill import cli, server
from textmill.engine import Engine
from textmill.operators.search import Searcher
from textmill.operators.snippet import Matcher, build
from textmill.plans.syntax import parse
from textmill.sources.extract import docx_text, extract, html_text, sniff
from textmill.sources.ignore import Levels, parse_rules
from textmill.sources.scan import ScanError, Walk, files_under, listing, scan
from textmill.sources.store import Conflict, Locked, Manifest, Store, WriterLock

SCHEMA = "path string, title string, body string, ext string, size bigint, mtime bigint"


def rows(*texts):
    return [(p, p, b, "md", len(b), 1700000000) for p, b in texts]


@pytest.mark.parametrize(("rules", "path", "ignored"), [
    ("*.log", "a/b.log", True), ("*.log\n!keep.log", "keep.log", False), ("/top", "top/x", True), ("/top", "a/top", False), ("build/", "a/build/x", True),
    ("a/*.txt", "a/x.txt", True), ("a/*.txt", "b/a/x.txt", False), ("**/gen", "x/y/gen", True), ("a/**/z", "a/b/c/z", True), ("a/**/z", "a/z", True), ("?.md", "x.md", True),
    ("?.md", "xx.md", False), ("# note\n\nfoo", "foo", True), ("", ".git/config", True), ("", "a/node_modules/x", True), ("", "plain", False), ("./b/c", "b/c", True),
])
def test_ignore_rules(rules, path, ignored):
    assert Levels().below(parse_rules(".gitignore", rules)).ignored(path) is ignored


def test_deeper_rules_win():
    levels = Levels().below(parse_rules(".gitignore", "*.txt")).below(parse_rules("a/.gitignore", "!x.txt"))
    assert not levels.ignored("a/x.txt") and levels.ignored("a/y.txt") and levels.deciding("a/y.txt").describe() == "*.txt (.gitignore:1)"


def test_sniff():
    assert sniff(b"plain") == ("utf8", "plain") and sniff(b"a\0b") == ("binary", None) and sniff(b"\xc4\xe3\xba\xc3") == ("nonutf8", None)
    assert sniff(b"\xff\x01") == ("binary", None) and sniff("﻿hi\0".encode("utf-16-le"))[0] == "utf16le" and sniff(b"\xfe\xff\0h\0i") == ("utf16be", "hi")


def test_html():
    assert html_text("<title> A &amp; B</title><p>x<b>y</b><br>z<script>1<2</script>&lt;<h2>q") == ("A & B", "\nxy\nz<\nq")
    assert html_text("a<b unfinished") == (None, "a") and html_text("<style>x") == (None, "")


def test_docx(tmp_path):
    file = tmp_path / "x.docx"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>one</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    assert docx_text(file.read_bytes()) == "one\ntwo\n"


def test_extract(spark):
    files = [("d/a.md", "md", "---\nx: 1\n---\n\n# Head \nbody"), ("b.md", "md", "text\n# no"), ("c.d.txt", "txt", "plain"), ("e.html", "html", "<p>hi"), (".env", "", "x")]
    got = {r.path: (r.title, r.body) for r in extract(spark.createDataFrame(files, "path string, ext string, text string")).collect()}
    assert got == {"d/a.md": ("Head", "\n# Head \nbody"), "b.md": ("b", "text\n# no"), "c.d.txt": ("c.d", "plain"), "e.html": ("e", "\nhi"), ".env": (".env", "x")}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "a.md").write_text("# Title\nhello world")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "x.log").write_text("hello")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "p.html").write_text("<title>T</title><p>hello html")
    (tmp_path / "bin.dat").write_bytes(b"\0")
    (tmp_path / "gbk.txt").write_bytes(b"\xc4\xe3\xba\xc3")
    (tmp_path / "big.md").write_text("x" * 300)
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    return tmp_path


def test_scan_diff_and_commit(spark, folder):
    found = scan(spark, [folder], folder, max_size=200)
    assert sorted(r.path for r in found.docs.collect()) == [".gitignore", "a.md", "sub/p.html"]
    assert {r.path: r.skip for r in found.skipped.collect()} == {"x.log": "ignored", "bin.dat": "binary", "gbk.txt": "non_utf8", "big.md": "too_large", "link.md": "symlink"}
    store = Store(spark, folder / ".searchindex")
    store.commit(found.docs)
    assert not store.check()
    (folder / "a.md").write_text("goodbye")
    os.utime(folder / ".gitignore", (1, 1))
    (folder / "sub" / "p.html").unlink()
    again = scan(spark, [folder], folder, max_size=200)
    assert {r.path: r.change for r in again.diff(store.state()).collect()} == {"a.md": "update", ".gitignore": "mtime", "sub/p.html": "delete"}
    only = scan(spark, [folder / "a.md"], folder)
    assert {r.path: r.change for r in only.diff(store.state()).collect()} == {"a.md": "update"}
    with pytest.raises(ScanError):
        scan(spark, [folder / "gone"], folder)
    assert listing([Path("/usr")], folder)[0][0][4] == "outside_root"


def test_tasks_walk_as_the_driver_does(spark, tmp_path, monkeypatch):
    from textmill.sources import scan as module

    for k in range(40):
        file = tmp_path / f"a{k % 3}" / f"b{k % 5}" / f"c{k}" / f"f{k}.{'log' if k % 4 == 0 else 'md'}"
        file.parent.mkdir(parents=True)
        file.write_text(f"text {k}")
    (tmp_path / ".gitignore").write_text("*.log\n/a2/b1\n")
    (tmp_path / "a1" / "b0").mkdir(exist_ok=True)
    (tmp_path / "a1" / ".searchignore").write_text("!*.log\nc7/\n")
    (tmp_path / "a0" / "link").symlink_to(tmp_path / "a1")
    want, read = listing([tmp_path], tmp_path)
    for folders, rows in ((256, 10_000), (1, 10_000), (4, 10_000), (256, 3)):
        monkeypatch.setattr(module, "FOLDERS", folders)
        monkeypatch.setattr(module, "DRIVER_ROWS", rows)
        files, roots = module.files_under(spark, [tmp_path], tmp_path)
        assert sorted(tuple(r) for r in files.collect()) == want and roots == read
    twice, _ = module.files_under(spark, [tmp_path, tmp_path / "a1"], tmp_path)
    assert sorted(tuple(r)[0] for r in twice.collect()) == [r[0] for r in want]


def test_scan_that_trusts_times(spark, folder):
    store = Store(spark, folder / ".searchindex")
    store.commit(scan(spark, [folder], folder, max_size=200).docs)
    (folder / "new.md").write_text("new")
    info = (folder / "a.md").stat()
    (folder / "a.md").write_text("x" * info.st_size)
    os.utime(folder / "a.md", (info.st_atime, info.st_mtime))  # a change that keeps size and time goes unseen
    (folder / "sub" / "p.html").unlink()
    found = scan(spark, [folder], folder, max_size=200, known=store.state())
    assert [r.path for r in found.docs.collect()] == ["new.md"]
    assert {r.path: r.change for r in found.diff(store.state()).collect()} == {"a.md": "unchanged", ".gitignore": "unchanged", "new.md": "add", "sub/p.html": "delete"}
    found.release()


def test_store_lifecycle(spark, tmp_path):
    store = Store(spark, tmp_path / "i")
    df = lambda *t: spark.createDataFrame(rows(*t), SCHEMA)
    store.commit(df(("a", "alpha beta"), ("b", "beta gamma"), ("", "no path")))
    old = Searcher(store.index())
    store.commit(df(("a", "delta")), df(("b", "")))
    new = Searcher(store.index())
    paths = lambda s, q: [r.path for r in s.search(q).collect()]
    assert paths(old, "beta") == ["a", "b"] and paths(new, "beta") == [] and paths(new, "delta") == ["a"] and paths(new, "-zzz") == ["a"]
    stats = store.stats()
    assert (stats["docs"], stats["deleted"], stats["segments"], stats["generation"]) == (1, 2, 2, 2) and new.index.stats.n == 3
    store.commit(df(("c", "beta")))
    store.compact()
    assert Searcher(store.index()).index.stats.n == 2 and not [w for w in store.check() if "left over" not in w]
    assert store.vacuum() and not store.check() and paths(Searcher(store.index()), "beta") == ["c"]
    seq = spark.createDataFrame([(*r, k) for k, r in enumerate(rows(("z", "first"), ("z", "second")))], SCHEMA + ", seq int")
    store.commit(seq)
    assert paths(Searcher(store.index()), "second") == ["z"] and paths(Searcher(store.index()), "first") == []
    (store.folder / "seg-99999999-dead").mkdir()
    (store.folder / "manifest.9.tmp").write_text("{")
    assert len(Store(spark, store.folder).check()) == 2 and paths(Searcher(Store(spark, store.folder).index()), "second") == ["z"]


def test_merge_keeps_what_was_not_stored(spark, tmp_path, monkeypatch):
    from textmill.sources import store as module

    monkeypatch.setattr(module, "STORED_BODY", 3)
    monkeypatch.setattr(module, "FAN_IN", 2)
    store = Store(spark, tmp_path / "i")
    store.commit(spark.createDataFrame(rows(("a", "longer than three")), SCHEMA))
    assert not store.maybe_merge()
    store.commit(spark.createDataFrame(rows(("b", "x")), SCHEMA))
    assert store.maybe_merge() and len(store.manifest.segments) == 1
    assert [r.path for r in Searcher(store.index()).search("longer").collect()] == ["a"]


def test_a_failed_commit_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, tmp_path / "i")
    store.commit(spark.createDataFrame(rows(("a", "alpha")), SCHEMA))

    def fail(*_):
        raise OSError("no")

    with monkeypatch.context() as m:
        m.setattr(os, "replace", fail)
        with pytest.raises(OSError):
            store.commit(spark.createDataFrame(rows(("a", "beta")), SCHEMA))
    fresh = Store(spark, tmp_path / "i")
    assert fresh.manifest.generation == 1 and [r.path for r in Searcher(fresh.index()).search("alpha").collect()] == ["a"]


def test_lock(tmp_path):
    file = tmp_path / "lock"
    with WriterLock(file):
        with pytest.raises(Locked), WriterLock(file):
            pass
        os.utime(file, (1, 1))
        with WriterLock(file):
            pass
    assert not file.exists()


def test_a_held_lock_does_not_go_stale(tmp_path, monkeypatch):
    from textmill.sources import store as module

    monkeypatch.setattr(module, "STALE_S", 0.6)
    monkeypatch.setattr(module, "HEARTBEAT_S", 0.1)
    file = tmp_path / "lock"
    with WriterLock(file) as mine:
        time.sleep(1.5)  # a commit that takes longer than a lock stays fresh by itself
        with pytest.raises(Locked), WriterLock(file):
            pass
        assert mine.held()
    assert not file.exists()


def test_a_writer_that_lost_its_lock_commits_nothing(spark, tmp_path):
    one, two = Store(spark, tmp_path / "i"), Store(spark, tmp_path / "i")
    one.commit(spark.createDataFrame(rows(("a", "alpha")), SCHEMA))
    with one.lock() as lock:
        one._write_segment(spark.createDataFrame(rows(("b", "beta")), SCHEMA).withColumn("sha256", F.lit("")))
        lock.file.write_text("of another")
        with pytest.raises(Conflict):
            one._commit(Manifest())
    lock.file.unlink()
    one.refresh(), two.refresh()
    two.commit(spark.createDataFrame(rows(("c", "gamma")), SCHEMA))
    with pytest.raises(Conflict):  # without a lock: the generation has moved on
        one._commit(Manifest())
    assert Store(spark, tmp_path / "i").manifest.generation == 2


def test_the_next_writer_removes_what_a_failed_commit_left(spark, tmp_path):
    store = Store(spark, tmp_path / "i")
    store.commit(spark.createDataFrame(rows(("a", "alpha")), SCHEMA))
    (store.folder / "seg-00000002-dead").mkdir()
    (store.folder / "manifest.2.tmp").write_text("{")
    store.commit(spark.createDataFrame(rows(("b", "beta")), SCHEMA))
    assert not store.orphans() and store.stats()["docs"] == 2


def test_repeated_paths_need_an_order(spark, tmp_path):
    with pytest.raises(ValueError, match="seq"):
        Store(spark, tmp_path / "i").commit(spark.createDataFrame(rows(("a", "x"), ("a", "y")), SCHEMA))


def test_snippets():
    text = "x " * 200 + "needle and hay " + "y " * 200 + "needle"
    s = build(text, Matcher.of(parse("needle")), 60)
    assert "needle and hay" in s.text and s.text.encode()[slice(*s.highlights[0])] == b"needle"
    assert build("no hits here", Matcher.of(parse("-hits zzz")), 5).text == "no hi"
    m = Matcher.of(parse('pre* "two words" NOT gone fuzz~'))
    assert (m.words, m.prefixes) == ({"two", "words"}, ("pre",))
    wide = build("😀 引擎 x", Matcher.of(parse("引擎")))
    assert wide.highlights == [(5, 11)] and wide.utf16() == [(3, 5)]


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("harbour")
    (base / "ferry.md").write_text("harbour timetable north south east west up down left quay")
    (base / ".gitignore").write_text("*.tmp\n")
    (base / "draft.tmp").write_text("x")
    (base / "photo.raw").write_bytes(b"P\0")
    (base / "latin.txt").write_bytes(b"Gr\xfc\xdfe")
    (base / "novel.md").write_text("page " * 200)
    (base / "tide.md").write_text("ebb")
    for p in base.iterdir():
        os.utime(p, (1710000000, 1710000000))
    e = Engine(spark, base / ".searchindex", max_size=500)
    counts = e.index([base])
    assert counts["add"] == 3 and counts["skipped_ignored"] == 2  # the index folder too
    (base / "tide.md").write_text("flood and ebb")
    (base / "crane.md").write_text("crane")
    return e


@pytest.mark.parametrize(("query", "path", "what"), [
    ("q", "../elsewhere", "outside"), ("q", "sunk.md", "missing_on_disk"), ("q", "draft.tmp", "ignored"), ("q", "novel.md", "too_large"), ("q", "photo.raw", "binary"), ("q", "latin.txt", "non_utf8"),
    ("q", "crane.md", "not_scanned"), ("flood", "tide.md", "stale"), ("title:harbour", "ferry.md", "field_mismatch"), ("harbour ext:py", "ferry.md", "filter_fail"), ("-harbour quay", "ferry.md", "not_triggered"),
    ('"harbour quay"', "ferry.md", "too far apart"), ('"timetable harbour"', "ferry.md", "another order"), ("harbout", "ferry.md", "harbour (distance 1, body@0)"),
    ("harbour submarine", "ferry.md", "rank 1 of 1"), ("harbour", "ferry.md", "matches the query"),
])
def test_why_not(engine, query, path, what):
    report = engine.why_not(query, path)
    assert what in report.render() and json.loads(report.to_json())["path"] == path


def test_results_and_http(engine):
    found = engine.results("harbour OR ebb", explain=True)
    assert found["total"] == 2 and found["hits"][0]["explain"]["terms"] and not found["truncated"]
    assert server.answer(engine, "/api/search?q=harbour&n=5")[1]["hits"][0]["path"] == "ferry.md"
    assert [server.answer(engine, t)[0] for t in ("/healthz", "/api/search", "/api/search?q=a&n=0", "/api/search?q=(", "/api/doc?path=ferry.md", "/api/doc?path=no", "/api/why-not?q=a&path=b", "/x", "/api/stats")] == [200, 400, 400, 400, 200, 404, 200, 404, 200]
    from http.server import ThreadingHTTPServer

    with ThreadingHTTPServer(("127.0.0.1", 0), server.handler(engine)) as s:
        threading.Thread(target=s.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{s.server_address[1]}"
        with urllib.request.urlopen(url + "/healthz") as r:
            assert json.load(r) == {"status": "ok"} and r.headers["X-Content-Type-Options"] == "nosniff"
        with pytest.raises(urllib.error.HTTPError) as e:
            urllib.request.urlopen(urllib.request.Request(url + "/healthz", method="POST"))
        assert e.value.code == 405 and e.value.headers["Allow"] == "GET, HEAD"
        s.shutdown()


def test_flags():
    known = {"n": True, "json": False}
    assert cli.parse_flags(["q", "-n", "5", "--json", "r"], known) == ({"n": "5", "json": "true"}, ["q", "r"]) and cli.parse_flags(["--n=7"], known)[0] == {"n": "7"}
    for bad in (["-x"], ["-n"], ["-n", "--json"]):
        with pytest.raises(cli.UsageError):
            cli.parse_flags(bad, known)
    assert [cli.parse_days(x) for x in ("30d", "12h", "2w", "365", "", "x")] == [30, 0.5, 14, 365, 30, 30]


def test_command_line(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello there")
    out = []
    call = lambda *a: cli.main([*a, "--index", str(tmp_path / ".searchindex")], spark, out.append)
    assert [call("index", str(tmp_path)), call("search", "hello", "--json"), call("check"), call("stats"), call("compact"), call("search", '"x'), call("search", "-n", "0", "x"), call("nonsense"), call("why-not", "hello", "a.md")] == [0, 0, 0, 0, 0, 2, 2, 2, 0]
    assert json.loads(next(x for x in out if x.startswith("{")))["hits"][0]["path"] == "a.md" and cli.main(["help"], spark, out.append) == 0


def wait_for(what, seconds=60):
    until = time.time() + seconds
    while not what() and time.time() < until:
        time.sleep(0.1)
    return what()


def test_watch(spark, tmp_path):
    (tmp_path / "a.md").write_text("hello")
    engine, seen = Engine(spark, tmp_path / ".searchindex"), []
    running = engine.watch([tmp_path], 0.2, on_commit=seen.append)
    assert wait_for(lambda: seen)
    running.stop()
    assert seen[0] == {"add": 1} and [r.path for r in engine.search("hello").collect()] == ["a.md"]
    assert not running.query.isActive and not list(engine.store.folder.glob("watch-*"))


def test_a_batch_that_begins_while_watch_stops(spark, tmp_path):
    engine = Engine(spark, tmp_path / ".searchindex")
    running = engine.watch([tmp_path], 0.05)
    running.busy.acquire()  # the next batch waits here, as it would in a long one
    threading.Timer(1.0, running.busy.release).start()
    began = time.time()
    running.stop()
    assert time.time() - began < 50 and not running.query.isActive


def test_watch_goes_on_after_a_failed_scan(spark, tmp_path):
    folder, seen = tmp_path / "files", []
    engine = Engine(spark, tmp_path / ".searchindex")
    running = engine.watch([folder], 0.2, on_commit=seen.append)
    assert wait_for(lambda: running.failures)
    folder.mkdir()
    (folder / "a.md").write_text("late")
    assert wait_for(lambda: seen)
    running.stop()
    assert seen[0] == {"add": 1}


def test_a_commit_reads_texts_twice_and_a_merge_moves_no_posting(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def counted(body):
        read.add(1)
        return body

    docs = spark.createDataFrame(rows(*[(f"d{k:02d}.md", f"word{k} common " * (k + 1)) for k in range(40)]), SCHEMA).repartition(4, "path")
    store = Store(spark, tmp_path / "s")
    store.commit(docs.withColumn("body", F.udf(counted, "string")("body")))
    assert read.value == 2 * 40  # for lengths and for postings; not for ranges of terms
    store.commit(docs.where("path < 'd10.md'").withColumn("body", F.lit("common new")), docs.where("path > 'd35.md'"))
    for names in ([store.manifest.segments[0]], store.manifest.segments):
        plan = store._postings(names)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    want = sorted(map(tuple, store.index().postings.select("field", "term", "path", "tf", "len").collect()))
    assert store.check() == [] and len({r[2] for r in want}) == 36
    store.compact()
    assert sorted(map(tuple, store.index().postings.select("field", "term", "path", "tf", "len").collect())) == want
    assert [w for w in store.check() if not w.startswith("left over")] == [] and len(store.manifest.segments) == 1
    for file in (store.folder / store.manifest.segments[0] / "postings").glob("part-*.parquet"):
        keys = [(r.field, r.term.encode()) for r in spark.read.parquet(f"file://{file}").select("field", "term").collect()]
        assert keys == sorted(keys)


def test_a_large_folder_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("textmill.sources.scan.PART_NAMES", 50)
    (tmp_path / "a" / "sub").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("n7*.txt\n")
    for k in range(180):
        (tmp_path / "a" / f"n{k}.txt").write_text(f"text {k}")
    (tmp_path / "a" / "sub" / "deep.md").write_text("# deep")
    (tmp_path / "b.txt").write_text("b")
    walk = Walk(tmp_path, parts=[])
    assert not walk.on(walk.begin([tmp_path])[0]) and len(walk.rows) < 10 and len(walk.parts) == 4  # the driver has looked at no file of the large folder
    files, read = files_under(spark, [tmp_path], tmp_path)
    want, _ = listing([tmp_path], tmp_path)
    assert sorted(tuple(r) for r in files.collect()) == want and len(want) == 183 and read == [""]
    assert sum(r[4] == "ignored" for r in want) == 11
