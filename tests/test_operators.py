"""Behaviour that the driver's tables do not exercise."""

import hashlib
import json
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.functions import text as X
from strandline.functions import trees, urls
from strandline.operators import graph, merge, publication, queue, repair, site_import
from strandline.operators.versions import VersionedSite, VersionedTable
from strandline.sources import captured, files, legacy
from strandline.streaming import discovery


def one(spark, column, **values):
    schema = ", ".join(f"{k} {t}" for k, (t, _) in values.items())
    return spark.createDataFrame([tuple(v for _, v in values.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "seconds"), [
    ("2023-11-14T22:13:20Z", 1_700_000_000), ("2023-11-14 22:13:20", 1_700_000_000), ("2023-11-14T22:13:20.999Z", 1_700_000_000), ("2023-11-15T01:13:20+03:00", 1_700_000_000),
    ("2023-11-15T01:13:20+0300", 1_700_000_000), ("2023-11-14T21:13:20-01:00", 1_700_000_000), ("2023-11-14", None), ("", None), ("2023-13-01T00:00:00Z", None), ("2023-11-14T25:00:00Z", None), ("junk", None), ("2023-02-31T00:00:00Z", 1_677_801_600),
])
def test_iso8601(spark, text, seconds):
    assert one(spark, X.iso8601(F.col("t")), t=("string", text)) == seconds


@pytest.mark.parametrize(("name", "key"), [
    ("https://own.wdfiles.com/local--files/p/a.jpg", "http://own.wikidot.com/local--files/p/a.jpg"), ("http://www.own.wikidot.com/a.jpg#x", "http://own.wikidot.com/a.jpg"),
    ("http://SANDBOX.wdfiles.com/c%3Ax/x.css?v=4", "http://sandbox.wikidot.com/c:x/x.css?v=4"), ("https://cdn.example.net/x.css", "https://cdn.example.net/x.css"), ("http://x.test/a.css#frag", "http://x.test/a.css"), ("not a url", "not a url"),
])
def test_fleet_keys(name, key):
    assert urls.fleet_key("own", name) == key
    assert urls.fleet_key("own", key) == key


def test_own_key_encodes_paths():
    assert urls.own_key("host.org", "http://www.host.org/é/a%3Ab") == "https://host.org/%C3%A9/a:b"


@given(st.text(max_size=20).filter(lambda s: "\x00" not in s))
@settings(max_examples=25, deadline=None)
def test_normalize_is_idempotent(path):
    first = urls.normalize("http://h.org/" + path)
    assert first is None or urls.normalize(first) == first


def test_yaml_round_trip_with_backslashes(spark):
    for text in ("plain", 'a"b\\c', "multi\nline\ttab", "", "\\n", "\\\\n"):
        assert one(spark, X.yaml_unquote(X.yaml_quote(F.col("t"))), t=("string", text)) == text


def test_broken_frontmatter_is_null(spark):
    assert one(spark, X.frontmatter(F.col("t")), t=("string", "---\ntitle: \"x\"\n---\nbody\n")) is None
    assert one(spark, X.frontmatter(F.col("t")), t=("string", None)) is None


def test_mined_references_need_a_whole_scheme(spark):
    text = "[[=imagehttp://h.org/local--files/a/b.png]] and http://h.org/zap local--files/c/d.png"
    assert one(spark, X.mined_references(F.col("t"), F.lit("http://m")), t=("string", text)) == ["http://m/local--files/a/b.png", "http://m/local--files/c/d.png"]


def test_upsert_on_empty_state(spark):
    state = spark.createDataFrame([], "k long, v string")
    delta = spark.createDataFrame([(1, "a")], "k long, v string")
    assert [tuple(r) for r in merge.upsert(state, delta, ["k"], {"v": merge.keep_new}).collect()] == [(1, "a")]


def test_update_of_a_missing_row_fails(spark):
    state = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(PySparkException, match="met no row"):
        merge.update_existing(state, spark.createDataFrame([(2, "b")], "k long, v string"), ["k"], ["v"]).collect()


def test_backoff(spark):
    got = spark.range(0, 14).select(queue.backoff_seconds(F.col("id")).alias("b")).collect()
    assert [r["b"] for r in got] == [10, 10, 20, 40, 80, 160, 320, 640, 1280, 2560, 3600, 3600, 3600, 3600]


def test_priorities_keep_their_order():
    order = ["shell.sync", "discover", "revision.head", "out.update", "page.sync", "file.fetch", "revision.old", "backfill"]
    assert sorted(queue.PRIORITIES, key=queue.PRIORITIES.get, reverse=True) == order


def test_crawl_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b", "import"), ("b", "a", "import"), ("b", "x.png", "asset"), ("b", "c", "import"), ("c", "d", "import"), ("a", "e", "import")], "src string, dst string, kind string")
    edges = edges.select(F.concat(F.lit("http://h/"), "src").alias("src"), F.when(F.col("kind") == "asset", F.col("dst")).otherwise(F.concat(F.lit("http://h/"), "dst")).alias("dst"), "kind")
    documents = spark.createDataFrame([("http://h/a", False), ("http://h/b", False), ("http://h/c", True)], "url string, binary boolean")
    visited, assets = graph.crawl(spark.createDataFrame([("http://h/a",)], "url string"), edges, documents)
    assert {(r["url"][-1], r["depth"], r["kind"]) for r in visited.collect()} == {("a", 0, "css"), ("b", 1, "css"), ("c", 2, "binary"), ("e", 1, "failed")}
    assert [r["url"] for r in assets.collect()] == ["x.png"]


def test_recrawl(spark):
    roots = spark.createDataFrame([("s", ["b", "a"]), ("t", ["a"]), ("u", ["a"]), ("v", ["a"])], "site string, roots array<string>")
    marker = spark.createDataFrame([("s", ["a", "b"], []), ("t", ["c"], []), ("u", ["a"], ["x"])], "site string, roots array<string>, failed array<string>")
    assert {r["site"]: r["needed"] for r in graph.recrawl_needed(roots, marker).collect()} == {"s": False, "t": True, "u": True, "v": True}


def test_archives_are_deterministic(spark):
    rows = [(1, n, f"text {n}") for n in range(1, 30)] + [(2, 1, "x")]
    df = spark.createDataFrame(rows, "page_id long, rev_no long, raw string")
    first, second = (publication.pack_pages(df.repartition(n), 3).select("page_id", "n", "sha256") for n in (1, 7))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect()))


def _publication(spark, tmp_path, title="T"):
    pages = spark.createDataFrame([(1, "s", title, ["t"], 2, 3, 3, "7", 10, "7", 20, "ab" * 32), (2, "e", "E", [], 0, 1, 1, None, None, None, None, None)],
                                  "page_id long, slug string, title string, tags array<string>, revisions_stored long, revisions_known long, max_rev long, created_by string, created_at long, updated_by string, updated_at long, archive_sha256 string")
    files = spark.createDataFrame([("http://h/a", "cd" * 32, 5, "image/png", "saved"), ("http://h/b", None, None, None, "pending")], "path string, sha256 string, size long, content_type string, status string")
    store = publication.Store(spark, f"file://{tmp_path}/out")
    return store, publication.publish(store, "site", pages, files, json.dumps({"title": 'A "b"', "subtitle": "", "theme_roots": ["r"]}))


def test_publishing_twice_changes_nothing(spark, tmp_path):
    store, (first, moved) = _publication(spark, tmp_path)
    _, (second, again) = _publication(spark, tmp_path)
    assert (moved, again) == (True, False) and first == second
    root, pages, files = publication.read_publication(store)
    assert root["v"] == 3 and pages.count() == 2 and files.count() == 2
    _, (third, moved) = _publication(spark, tmp_path, title="other")
    assert moved and third != first
    assert publication.read_publication(store)[0]["files"] == root["files"]
    publication.verify_publication(store)


def test_sections_are_named_by_their_exact_bytes(spark, tmp_path):
    store, (sha, _) = _publication(spark, tmp_path)
    root = json.loads((tmp_path / "out" / publication.root_name(sha)).read_bytes())
    raw = (tmp_path / "out" / publication.object_name("pages", root["pages"])).read_bytes()
    assert hashlib.sha256(raw).hexdigest() == root["pages"]
    parsed = json.loads(raw)
    assert raw.endswith(b"]}\n") and raw == (json.dumps(parsed, separators=(",", ":")) + "\n").encode()
    assert [p["id"] for p in parsed["pages"]] == ["1", "2"] and parsed["pages"][0]["archive"] == f"objects/archives/ab/ab/{'ab' * 32}.zst"
    assert parsed["pages"][1]["archive"] is None and list(parsed) == ["v", "site", "pages"]
    assert (tmp_path / "out" / publication.object_name("shell", root["shell"])).read_text().startswith('title: "A \\"b\\""')
    none = spark.createDataFrame([], "path string, entry string")
    empty = publication.put_section(store, "files", "s", none, "path")
    assert store.get(publication.object_name("files", empty)) == b'{"v":3,"site":"s","files":[]}\n'


def test_many_rows_make_one_sorted_section(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/out")
    rows = spark.range(5_000).repartition(7).select(F.col("id").alias("page_id"), F.format_string('{"id":%d}', "id").alias("entry"))
    sha = publication.put_section(store, "pages", "s", rows, "page_id")
    assert [p["id"] for p in json.loads(store.get(publication.object_name("pages", sha)))["pages"]] == list(range(5_000))


def test_broken_shell_fails_before_anything_moves(spark, tmp_path):
    store, (first, _) = _publication(spark, tmp_path)
    empty = spark.createDataFrame([], "page_id long")
    for bad in ("{", "[]", '{"title": "t"}'):
        with pytest.raises(ValueError):
            publication.publish(store, "site", empty, empty, bad)
    assert store.head() == first and not store.exists(".publish.lock")


def test_one_publication_at_a_time(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/out")
    with store.locked():
        with pytest.raises(RuntimeError, match="another"), store.locked():
            pass
        with store.locked(lease_s=-1):  # a lock left by a lost writer
            pass
    with store.locked():
        pass


def test_cache_changes_only_where_rows_change(spark, tmp_path):
    cache = VersionedTable(spark, f"file://{tmp_path}/cache")
    rows = spark.createDataFrame([(1, 2, "a"), (2, 3, None)], "page_id long, packed_revs long, archive_sha256 string")
    assert [publication.update_cache(cache, rows), publication.update_cache(cache, rows)] == [True, False]
    assert publication.update_cache(cache, rows.withColumn("packed_revs", F.col("packed_revs") + (F.col("page_id") == 2).cast("int")))
    assert sorted(map(tuple, cache.read().collect())) == [(1, 2, "a"), (2, 4, None)]


def test_head_is_replaced_in_one_step(spark, tmp_path, monkeypatch):
    store, (first, _) = _publication(spark, tmp_path)
    monkeypatch.setattr(files, "move", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        store.move_head("f" * 64)
    assert store.head() == first


def test_a_writer_lost_before_its_marker_blocks_nobody(spark, tmp_path, monkeypatch):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    table.commit(spark.range(1))
    kept = files.move
    monkeypatch.setattr(files, "move", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.commit(spark.range(2))
    monkeypatch.setattr(files, "move", kept)
    assert table.read().count() == 1 and table.commit(spark.range(3)) == 2 and table.read().count() == 3


def test_two_writers_cannot_take_one_number(spark, tmp_path, monkeypatch):
    one, two = (VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    monkeypatch.setattr(two, "_before", lambda expected: 0)
    one.commit(spark.range(1))
    with pytest.raises(RuntimeError, match="another writer"):
        two.commit(spark.range(2))
    assert one.read().count() == 1


def test_a_site_commits_several_tables_at_once(spark, tmp_path):
    site = VersionedSite(spark, f"file://{tmp_path}/s")
    assert not site.has("jobs")
    site.commit({"jobs": spark.range(1), "files": spark.range(2)})
    pinned = site.tables()
    site.commit({"jobs": spark.range(5)}, expected=1, note="effects")
    now = site.tables()
    assert (pinned["jobs"].count(), now["jobs"].count(), now["files"].count(), site.note()) == (1, 5, 2, "effects")
    assert site.has("files", ("id",)) and not site.has("files", ("other",)) and not site.has("pages")


def test_blobs_are_written_once(spark, tmp_path):
    rows = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),), (bytearray(b""),), (None,)], "content binary").coalesce(1)
    first = files.write_blobs(rows, f"file://{tmp_path}/b").collect()
    sha = hashlib.sha256(b"x").hexdigest()
    assert [r["written"] for r in first] == [True, False, True, False] and (tmp_path / "b" / files.blob_name(sha)).read_bytes() == b"x"
    assert not any(r["written"] for r in files.write_blobs(rows, f"file://{tmp_path}/b").collect())
    links = spark.createDataFrame([("p", "ab" * 32, str(tmp_path / "b" / files.blob_name(sha)))], "path string, sha256 string, target string")
    assert [tuple(r) for r in files.adopt_blobs(links, f"file://{tmp_path}/out").collect()] == [("p", "ab" * 32, 1, True)]
    assert (tmp_path / "out" / files.blob_name("ab" * 32)).read_bytes() == b"x"


def test_vanished_jobs_are_an_error(spark):
    jobs = spark.createDataFrame([(1, "discover", "{}", 1, "running", 0, 1, 0, "old")], "id long, kind string, payload string, priority long, status string, run_at long, attempts long, max_attempts long, last_error string")
    done = queue.complete(jobs, spark.createDataFrame([(1, 60)], "id long, resched long")).first()
    assert (done["status"], done["run_at"], done["attempts"], done["last_error"]) == ("pending", 60, 1, None)
    with pytest.raises(PySparkException, match="vanished"):
        queue.complete(jobs, spark.createDataFrame([(2, None)], "id long, resched long")).collect()
    with pytest.raises(PySparkException, match="vanished"):
        queue.fail(jobs, spark.createDataFrame([(2, "x", False)], "id long, error string, permanent boolean"), 0).collect()


def test_titles_lose_all_white_space(spark):
    for text, kind in (("<title>\n Not authorized\t</title>", "auth"), ("<title>\u00a0The site does not exist\u2003\n</title>", "site"), ("<title>x</title>", None)):
        assert one(spark, X.error_page_kind(F.col("t")), t=("string", text)) == kind
    assert one(spark, X.html_title(F.col("t")), t=("string", "<title>\n\u00a0a b\r\n</title>")) == "a b"


def test_deep_trees():
    deep = "<div>" * 5_000 + '<a href="/local--files/p/x.png">t</a>' + "</div>" * 5_000
    root = trees.tree(deep)
    assert root.text() == "t" and sum(1 for _ in root.walk()) == 5_001
    hostile = "<tr><td>" * 20_000 + "</p>" * 20_000
    begin = time.time()
    assert trees.tree(hostile).text() == "" and time.time() - begin < 20


def test_count_guard_fails(spark):
    packed = spark.createDataFrame([(1, 2)], "page_id long, n long")
    catalog = spark.createDataFrame([(1, 3)], "page_id long, revisions_stored long")
    with pytest.raises(PySparkException, match="disagree"):
        publication.checked_counts(packed, catalog).collect()


def test_crawl_is_as_deep_as_it_is(spark):
    edges = spark.createDataFrame([(f"http://h/{k}.css", f"http://H:80/{k + 1}.css#f", "import") for k in range(12)], "src string, dst string, kind string")
    documents = spark.createDataFrame([(f"http://h/{k}.css", False) for k in range(13)], "url string, binary boolean")
    visited, _ = graph.crawl(spark.createDataFrame([("http://h/0.css",)], "url string"), edges, documents)
    assert sorted(r["depth"] for r in visited.collect()) == list(range(13))


def test_repair_twice_changes_nothing(spark):
    files_table = spark.createDataFrame([("local--files/p/a.png", None, None, "pending", 1, None), ("local--files/s/c.png", "ab" * 32, 4, "saved", 1, "text/html"), ("http://sandbox.wikidot.com/local--files/m/x.png", "cd" * 32, 9, "saved", 1, "image/png"), ("http://sandbox.wdfiles.com/local--files/m/x.png", "ef" * 32, 9, "saved", 1, "image/png"), ("local--files/q/d.jpg|width=5", None, None, "pending", 1, None)],
                                        "path string, sha256 string, size long, status string, first_seen long, content_type string")
    jobs = spark.createDataFrame([], "id long, kind string, payload string, priority long, status string, run_at long, attempts long, max_attempts long, last_error string")
    text = spark.createDataFrame([("rel local--files/p/a.png pipe local--files/q/d.jpg|width=5 ",), (None,)], "content string")
    first = repair.repair_references(files_table, jobs, text, "demo", 5, 100)
    again = repair.repair_references(first.files, first.jobs, text, "demo", 6, 200)
    rows = {r["path"]: r["status"] for r in first.files.collect()}
    assert rows == {"http://demo.wikidot.com/local--files/p/a.png": "pending", "http://demo.wikidot.com/local--files/s/c.png": "pending", "http://sandbox.wikidot.com/local--files/m/x.png": "saved", "http://demo.wikidot.com/local--files/q/d.jpg": "pending"}
    assert sorted(map(tuple, again.files.collect())) == sorted(map(tuple, first.files.collect())) and again.jobs.count() == first.jobs.count() == 3
    assert len(first.orphans.collect()) == 2 and again.orphans.count() == 0


def test_import_is_one_commit_and_repeatable(spark, tmp_path):
    site = VersionedSite(spark, f"file://{tmp_path}/s")
    journals = spark.createDataFrame([("12", "slug: a\ntitle: \"T\"\ntags: [\"x\"]\n2\tr2\t20\t7\n1\tr1\t10\t7\n")], "key string, raw string").select("key", X.journal(F.col("raw")).alias("journal"))
    text = X.revision_text(F.lit("T"), F.array(F.lit("x")), F.lit(12), F.lit("demo"), F.lit("a"), F.lit(2), F.lit("r2"), F.lit(7), F.lit(20), F.lit("b local--files/p/a.png "))
    revision = spark.createDataFrame([("12", "12/r002.txt")], "key string, rel string").withColumn("f", X.frontmatter(text))
    links = spark.createDataFrame([("demo.wikidot.com/local--files/d/x.png", "ab" * 32, 3, bytearray(b"GIF8"))], "link string, sha256 string, size long, head binary")
    inputs = {"journals": journals, "files": revision, "links": links, "site": "demo", "watermark": "w"}
    site_import.import_into(site, **inputs, now=100)
    first = {k: sorted(map(str, t.collect())) for k, t in site.tables().items()}
    assert site_import.import_into(site, **inputs, now=100) == 2
    assert {k: sorted(map(str, t.collect())) for k, t in site.tables().items()} == first
    assert {r["path"]: r["content_type"] for r in site.tables()["files"].collect()} == {"http://demo.wikidot.com/local--files/d/x.png": "image/gif", "http://demo.wikidot.com/local--files/p/a.png": None}
    with pytest.raises(PySparkException, match="another page or site"):
        site_import.import_into(site, **(inputs | {"site": "other"}), now=100)
    assert site.numbers() == [1, 2]


def test_captured_change_pages(spark, tmp_path):
    (tmp_path / "p").mkdir()
    row = '<div class="changes-list-item"><td class="title"><a href="/a-%d">A</a></td><td class="revision-no">(rev. %d)</td><span class="odate time_%d">.</span><a onclick="userInfo(7)">u</a></div>'
    for k in range(2):
        (tmp_path / f"p/{k}.html").write_text("\ufeff" + row % (k, k, k))
    assert sorted(map(tuple, captured.change_pages(spark, str(tmp_path / "p")).collect())) == [("a-0", 0, 0, 7), ("a-1", 1, 1, 7)]
    (tmp_path / "p/x.gif").write_bytes(b"GIF8x")
    assert {r["name"]: r["media"] for r in captured.attachment_rows(spark, str(tmp_path / "p")).collect()}["x.gif"] == "image/gif"
    with pytest.raises((PySparkException, Py4JJavaError), match="(?i)malformed"):
        captured.articles(spark.createDataFrame([("a", "<html>")], "slug string, answer string")).collect()


def test_malformed_head(spark, tmp_path):
    store = publication.Store(spark, f"file://{tmp_path}/o")
    store.put("HEAD", b"nonsense\n")
    with pytest.raises(ValueError, match="malformed"):
        store.head()
    with pytest.raises(OSError, match="bytes"):
        store.put("HEAD", b"other size")


def test_versions_pin_a_reader(spark, tmp_path):
    table = VersionedTable(spark, f"file://{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.commit(spark.range(1))
    pinned = table.read()
    table.commit(spark.range(3), expected=1)
    assert pinned.count() == 1 and table.read().count() == 3 and table.read(1).count() == 1
    with pytest.raises(RuntimeError):
        table.commit(spark.range(2), expected=1)


def test_stream_upsert_equals_batch(spark, tmp_path):
    source = tmp_path / "feed"
    source.mkdir()
    for k in range(3):
        spark.createDataFrame([(f"s{i % 4}", k * 10 + i, 100 * k + i, i) for i in range(8)], discovery.FEED).coalesce(1).write.mode("append").json(str(source))
    table = VersionedSite(spark, f"file://{tmp_path}/state")
    stream = discovery.feed_stream(spark, str(source), 1)
    running = discovery.upsert_stream(stream, table, ["slug"], F.struct("ts", "rev_no"), {c: merge.keep_new for c in ("rev_no", "ts", "author")}, f"{tmp_path}/cp")
    running.awaitTermination(120)
    running.stop()
    got = {r["slug"]: r["rev_no"] for r in discovery.stream_state(table).collect()}
    assert set(got) == {"s0", "s1", "s2", "s3"}
    assert len(table.numbers()) == 3 and table.note() == "2"


def test_legacy_import(spark, tmp_path):
    (tmp_path / "j/1/2").mkdir(parents=True)
    (tmp_path / "j/1/2/3").write_text('slug: a\ntitle: "T"\ntags: ["x"]\n2\tr2\t20\t7\n1\tr1\t10\t7\nbad\n')
    (tmp_path / "j/stray").write_text("slug: b\n")
    raw = one(spark, X.revision_text(F.lit("T"), F.array(F.lit("x")), F.lit("123"), F.lit("site"), F.lit("a"), F.lit(2), F.lit("r2"), F.lit(7), F.lit(20), F.lit("body")), t=("string", ""))
    (tmp_path / "r").mkdir()
    (tmp_path / "r/r002.txt").write_text(raw)
    out = legacy.import_revisions(legacy.sharded_journals(spark, str(tmp_path / "j")), legacy.revision_files(spark, str(tmp_path / "r")), "site")
    assert sorted((r["page_id"], r["rev_no"], r["content"]) for r in out.collect()) == [(123, 1, None), (123, 2, "body")]


def test_symlinks(spark, tmp_path):
    sha = "ab" + "cd" + "e" * 60
    (tmp_path / "h").mkdir()
    (tmp_path / "h/a.png").symlink_to(f"../files_ca/ab/cd/{'e' * 60}")
    (tmp_path / "h/x/y").mkdir(parents=True)
    for name in ("h/x/b.png", "h/x/y/c.png", "top.png"):
        (tmp_path / name).symlink_to(f"/files_ca/ab/cd/{'e' * 60}")
    assert sorted(tuple(r) for r in legacy.symlink_blobs(spark, str(tmp_path)).collect()) == [(n, sha) for n in ("h/a.png", "h/x/b.png", "h/x/y/c.png", "top.png")]
    assert legacy.symlink_blobs(spark, str(tmp_path / "none")).count() == 0 and legacy.revision_files(spark, str(tmp_path / "none")).count() == 0


def test_config():
    text = """
data_dir = "data"
timeout_s = 40
monitor_interval_s = 1800 # a scan of the changes
zstd_level = 3
[instance]
name = "example"
sites = [
      { type = "wikidot", host = "alpha" }
    , { type = "rufoundation", host = "https://WWW.Example.org/", api_key = "k" }
    , { type = "rufoundation", host = "b.site", name = "beta" }
]
"""
    config = legacy.load_config(text)
    assert [(s.directory, s.platform, s.host, s.api_key) for s in config.sites] == [
        ("alpha", "wikidot", "alpha", None), ("www.example.org", "rufoundation", "https://WWW.Example.org/", "k"), ("beta", "rufoundation", "b.site", None)
    ]
    assert config.settings == {"data_dir": "data", "timeout_s": 40, "rate_limit_ms": 2000, "monitor_interval_s": 1800, "shell_interval_s": 86400, "out_interval_s": 300, "backfill_interval_s": 3600, "zstd_level": 3}
    assert config.state_dir(config.sites[0]) == "data/example/meta/alpha" and config.out_dir(config.sites[2]) == "data/example/out/beta"
    one_site = '[instance]\nname = "x"\nsites = [%s]\n'
    assert legacy.load_config(one_site % '{ type = "wikidot", host = "a" }').settings["data_dir"] == "data"
    for bad in (
        "", "timeout_s = 1\n", one_site % "", "x = 1\n" + one_site % '{ type = "wikidot", host = "a" }', 'zstd_level = "3"\n' + one_site % '{ type = "wikidot", host = "a" }',
        one_site % '{ type = "wikidot", host = "a", x = 1 }', one_site % '{ type = "wikidot", host = "a", api_key = "k" }', one_site % '{ type = "wikidot", host = "a", name = "n" }',
        one_site % '{ host = "a" }', one_site % '{ type = "other", host = "a" }', one_site % '{ type = "rufoundation", host = " " }',
        one_site % '{ type = "wikidot", host = "a.b" }, { type = "rufoundation", host = "http://A.b/" }', one_site % '{ type = "wikidot", host = "a" }' + "more = 1\n",
    ):
        with pytest.raises(ValueError):
            legacy.load_config(bad)
