"""Tables in layers, conflicts, the feed source, migrations, claims by site: failures and upkeep."""

import json
import os
import threading
from pathlib import Path

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandline.operators import layered, merge, migrations, publication, queue, site_import
from strandline.operators.layered import Conflict, Footprint, LayeredTable
from strandline.operators.versions import VersionedSite
from strandline.sources import blob_sink, feed_source, files
from strandline.streaming import discovery

KV = "k long, v string, n long"


def rows(spark, *found):
    return spark.createDataFrame(list(found), KV)


def held(df):
    return sorted(map(tuple, df.select("k", "v", "n").collect()))


@pytest.fixture
def table(spark, tmp_path):
    t = LayeredTable(spark, f"file://{tmp_path}/t")
    t.create(spark.range(100).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit(0).cast("long").alias("n")), ["k"], buckets=8)
    return t


def model(table):
    return {k: (v, n) for k, v, n in held(table.read())}


def test_changes_are_merged_when_read(spark, table):
    want = {k: (f"v{k}", 0) for k in range(100)}
    table.upsert(rows(spark, (1, "a", 1), (200, "new", 2)))
    want |= {1: ("a", 1), 200: ("new", 2)}
    assert model(table) == want
    table.upsert(rows(spark, (1, "b", 5), (2, None, 7)), {"v": merge.new_or_old, "n": lambda o, n: o + n})
    want |= {1: ("b", 6), 2: ("v2", 7)}
    table.delete(rows(spark, (3, None, None), (200, None, None), (999, None, None)).select("k"))
    del want[3], want[200]
    assert model(table) == want
    table.insert_or_ignore(rows(spark, (3, "again", 1), (4, "no", 1)))
    want[3] = ("again", 1)
    assert model(table) == want
    assert held(table.read_keys(rows(spark, (3, "", 0), (4, "", 0), (-1, "", 0)))) == [(3, "again", 1), (4, "v4", 0)]
    assert held(table.read(2)) == sorted((k, *x) for k, x in ({k: (f"v{k}", 0) for k in range(100)} | {1: ("a", 1), 200: ("new", 2)}).items())
    before = table.read()
    assert table.compact() == 6 and table.state()["deltas"] == [] and model(table) == want
    assert held(before) == held(table.read())  # a pinned reader still reads what it pinned
    assert table.compact() is None


def test_a_change_writes_what_it_changes(spark, tmp_path):
    t = LayeredTable(spark, f"file://{tmp_path}/t")
    t.create(spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"), F.col("id").alias("n")), ["k"], buckets=8)

    def size(folder):
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "t" / folder) for f in fs if f.endswith(".parquet"))

    t.upsert(rows(spark, *((k, "x", 1) for k in range(20))))
    base, delta = next(iter(t.state()["bases"].values()))[0], t.state()["deltas"][0][1]
    assert size(base) > 200 * size(delta)
    # The base is scanned and not dealt out by key: the few keys of the deltas are broadcast.
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_compaction_of_some_buckets_beside_writers(spark, table):
    table.upsert(rows(spark, *((k, "x", 1) for k in range(60))))
    state = table.state()
    running = table.begin().upsert(rows(spark, (5, "late", 9), (300, "late", 9)))
    table.compact(least_share=0.5)
    assert running.commit() == table.pinned(None)
    found = model(table)
    assert found[5] == found[300] == ("late", 9) and found[6] == ("x", 1) and len(found) == 101
    assert len(table.state()["deltas"]) <= 2 and state["deltas"]
    table.delete(table.read().select("k"))
    table.compact()
    assert table.read().count() == 0 and all(folder is None for folder, _ in table.state()["bases"].values())
    table.upsert(rows(spark, (1, "one", 1)))
    assert held(table.read()) == [(1, "one", 1)]


def test_two_writers_of_different_keys_both_land(spark, table):
    one, two = table.begin(), table.begin()
    one.upsert(rows(spark, (1, "one", 1)), {"v": merge.keep_new})
    two.upsert(rows(spark, (2, "two", 2)), {"v": merge.keep_new})
    assert (two.commit(), one.commit()) == (2, 3)
    assert model(table)[1] == ("one", 0) and model(table)[2] == ("two", 0)


def test_writers_of_one_key_conflict(spark, table):
    one, two = table.begin(), table.begin()
    one.upsert(rows(spark, (1, "one", 1)))
    two.upsert(rows(spark, (1, "two", 2), (3, "two", 2)))
    one.commit()
    with pytest.raises(Conflict):
        two.commit()
    assert model(table)[1] == ("one", 1) and model(table)[3] == ("v3", 0)
    # Tried again on top, it lands.
    assert layered.retried(table, lambda change: change.upsert(rows(spark, (1, "two", 2), (3, "two", 2)))) == 3
    assert model(table)[1] == ("two", 2)


def test_what_was_read_conflicts_with_what_was_written(spark, table):
    reader, whole, other = table.begin(), table.begin(), table.begin()
    reader.read_keys(rows(spark, (7, "", 0)))
    reader.upsert(rows(spark, (8, "from 7", 0)))
    whole.read()
    whole.upsert(rows(spark, (9, "from all", 0)))
    ignoring = table.begin().insert_or_ignore(rows(spark, (7, "seen", 0), (400, "new", 0)))
    other.delete(rows(spark, (7, "", 0)).select("k")).commit()
    for change in (reader, whole, ignoring):
        with pytest.raises(Conflict):
            change.commit()
    assert 7 not in model(table) and model(table)[8] == ("v8", 0) and 400 not in model(table)


def test_many_keys_are_noted_as_ranges(spark, table, monkeypatch):
    monkeypatch.setattr(layered, "EXACT_KEYS", 3)
    one, two = table.begin(), table.begin()
    one.upsert(rows(spark, *((k, "x", 1) for k in range(50)))).commit()
    assert Footprint.of_json(table.state()["wrote"]).hashes is None
    with pytest.raises(Conflict):
        two.upsert(rows(spark, *((k, "y", 1) for k in range(50, 100)))).commit()
    a, b = Footprint({1: (0, 10)}, {1, 9}), Footprint({1: (5, 20)}, {7})
    assert not a.meets(b) and a.meets(Footprint({1: (5, 20)})) and not a.meets(Footprint({2: (5, 20)}, None)) and Footprint(everything=True).meets(a) and not Footprint(everything=True).meets(Footprint())


def test_exact_changes_of_many_keys_meet_in_keys_only(spark, table, monkeypatch):
    monkeypatch.setattr(layered, "EXACT_KEYS", 3)
    even, odd, late = (table.begin(exact=True) for _ in range(3))
    for change, rest in ((even, 0), (odd, 1), (late, 1)):
        mine = change.read_keys(rows(spark, *((k, "", 0) for k in range(100) if k % 2 == rest)))
        change.upsert(mine.select("k", F.lit("x").alias("v"), F.lit(rest + 1).cast("long").alias("n")))
        change.delete(rows(spark, *((k, "", 0) for k in range(200, 260) if k % 2 == rest)).select("k"))
    assert (even.commit(), odd.commit()) == (2, 3)
    assert model(table) == {k: ("x", k % 2 + 1) for k in range(100)}
    with pytest.raises(Conflict):
        late.commit()
    # What was read counts, too: one key of many that another commit wrote.
    reader, whole = table.begin(exact=True), table.begin(exact=True)
    reader.read_keys(rows(spark, *((k, "", 0) for k in range(0, 50, 2))))
    reader.upsert(rows(spark, (301, "r", 0)))
    whole.read()
    whole.upsert(rows(spark, (302, "w", 0)))
    table.upsert(rows(spark, *((k, "z", 0) for k in (*range(1, 50, 2), 48))))
    for change in (reader, whole):
        with pytest.raises(Conflict):
            change.commit()


def test_racing_commits_all_land(spark, table):
    """Eight writers of their own keys at once: every one gets a number of its own."""
    failed = []

    def write(k):
        try:
            layered.retried(LayeredTable(spark, table.path), lambda change: change.upsert(rows(spark, (k, f"by {k}", k))))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and table.numbers() == list(range(1, 10))
    assert all(model(table)[k] == (f"by {k}", k) for k in range(8))


def test_a_lost_writer_changes_nothing(spark, table, monkeypatch):
    before = held(table.read())
    kept = files.move
    monkeypatch.setattr(files, "move", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        table.upsert(rows(spark, (1, "x", 1)))
    monkeypatch.setattr(files, "move", kept)
    assert held(table.read()) == before and table.numbers() == [1]
    # What it wrote goes with the next vacuum, once no writer can still name it.
    assert table.vacuum(grace_s=3_600) == [] and len(table.vacuum(grace_s=0)) == 1 and held(table.read()) == before


def test_bad_changes_are_refused_before_the_commit(spark, table):
    with pytest.raises(ValueError, match="two rows of one key"):
        table.upsert(rows(spark, (1, "a", 1), (1, "b", 2)))
    with pytest.raises(PySparkException, match="a key is null"):
        table.upsert(rows(spark, (None, "a", 1)))
    with pytest.raises(ValueError, match="nothing was changed"):
        table.begin().commit()
    with pytest.raises(Conflict, match="exists"):
        table.create(rows(spark, (1, "a", 1)), ["k"])
    assert table.numbers() == [1]


def test_vacuum_keeps_what_kept_versions_name(spark, table, tmp_path):
    table.upsert(rows(spark, (1, "a", 1)))
    table.compact()
    table.upsert(rows(spark, (2, "b", 1)))
    pinned = table.read()
    gone = table.vacuum(keep=2, grace_s=0)
    assert gone and held(pinned) == held(table.read()) and table.numbers() == [3, 4]
    assert held(table.read(3)) != held(table.read(4))
    assert table.vacuum(keep=2, grace_s=0) == []


def test_change_feed(spark, table):
    table.upsert(rows(spark, (1, "a", 1), (2, "v2", 0), (500, "in and out", 0)))
    table.delete(rows(spark, (3, "", 0), (500, "", 0)).select("k"))
    table.compact()
    table.upsert(rows(spark, (600, "new", 1)))
    found = {(r["k"], r["kind"], r["before"] and r["before"]["v"], r["after"] and r["after"]["v"]) for r in table.changes(1).collect()}
    assert found == {(1, "update", "v1", "a"), (3, "delete", "v3", None), (600, "insert", None, "new")}
    assert table.changes(5).count() == 0 and {r["k"] for r in table.changes(1, 2).collect()} == {1, 500}


# -- the feed as a source -------------------------------------------------


def entry(k):
    return {"slug": f"s{k % 5}", "rev_no": k, "ts": k * 10, "author": "u"}


def write_pages(folder, ks, size=3):
    """Entries ks, newest first, size a page."""
    folder.mkdir(exist_ok=True)
    for old in folder.glob("*.json"):
        old.unlink()
    ks = sorted(ks, reverse=True)
    for n in range(0, len(ks), size):
        (folder / f"{n // size + 1}.json").write_text("".join(json.dumps(entry(k)) + "\n" for k in ks[n : n + size]))


def run_feed(spark, folder, tmp_path, kind="json"):
    out = feed_source.feed_source(spark, str(folder), kind).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    out.awaitTermination()
    return sorted(r["rev_no"] for r in spark.read.schema(feed_source.SCHEMA).parquet(f"{tmp_path}/out").collect())


def test_feed_restarts_at_its_watermark(spark, tmp_path):
    folder = tmp_path / "feed"
    write_pages(folder, range(20))
    assert run_feed(spark, folder, tmp_path) == list(range(20))
    assert run_feed(spark, folder, tmp_path) == list(range(20))  # nothing new
    write_pages(folder, range(27))
    # Pages behind the one with the watermark cannot be read: they are not opened.
    for n in range(4, 10):
        (folder / f"{n}.json").write_text("no json\n")
    assert run_feed(spark, folder, tmp_path) == list(range(27))


def test_feed_batches_replay_alike(tmp_path):
    folder = tmp_path / "feed"
    reader = feed_source.FeedReader(str(folder), "json")
    assert reader.latestOffset() == {"newest": None} and reader.partitions(reader.initialOffset(), reader.latestOffset()) == []
    read = lambda a, b: [e[1] for p in reader.partitions(a, b) for e in reader.read(p)]
    write_pages(folder, range(10))
    first = reader.latestOffset()
    write_pages(folder, range(17))
    second = reader.latestOffset()
    write_pages(folder, range(23))
    # What came in after a batch's offset was taken belongs to the next one.
    assert sorted(read(reader.initialOffset(), first)) == list(range(10))
    assert sorted(read(first, second)) == list(range(10, 17)) and sorted(read(second, reader.latestOffset())) == list(range(17, 23))
    assert read(second, second) == []
    gone = {"newest": ["other", 1, 1, "u"]}
    assert sorted(read(gone, second)) == list(range(17))  # a watermark that is gone is looked for to the end


def test_feed_of_captured_pages(spark, tmp_path):
    row = '<div class="changes-list-item"><td class="title"><a href="/a-%d">A</a></td><td class="revision-no">(rev. %d)</td><span class="odate time_%d">.</span><a onclick="userInfo(7)">u</a></div>'
    folder = tmp_path / "feed"
    folder.mkdir()
    for n, ks in ((1, (5, 4)), (2, (3, 2))):
        (folder / f"{n}.html").write_text("﻿" + "".join(row % (k, k, k) for k in ks))
    assert run_feed(spark, folder, tmp_path, "html") == [2, 3, 4, 5]


def test_feed_pages_are_written_in_order(spark, tmp_path):
    feed = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 7).alias("slug"), F.col("id").alias("rev_no"), (F.col("id") % 50).alias("ts"), F.lit("u").alias("author"))
    feed_source.write_feed(feed.repartition(5), f"file://{tmp_path}/f", 64)
    pages = feed_source.page_files(str(tmp_path / "f"))
    found = [e for p in pages for e in feed_source.entries(p, "json")]
    assert len(pages) == 16 and all(len(p) == 1 for p in pages)
    assert [(e[2], e[1]) for e in found] == sorted(((k % 50, k) for k in range(1000)), reverse=True)


def test_layer_stream_replays_nothing(spark, tmp_path):
    folder = tmp_path / "feed"
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    table.create(spark.createDataFrame([], feed_source.SCHEMA), ["slug"], buckets=4)
    rules = dict.fromkeys(("rev_no", "ts", "author"), merge.keep_new)

    def run():
        discovery.layer_stream(feed_source.feed_source(spark, str(folder)), table, ["slug"], F.struct("ts", "rev_no"), rules, f"{tmp_path}/cp").awaitTermination()
        return {r["slug"]: r["rev_no"] for r in table.read().collect()}

    write_pages(folder, range(12))
    assert run() == {f"s{k % 5}": k for k in range(7, 12)}
    numbers = table.numbers()
    assert run() and table.numbers() == numbers
    write_pages(folder, range(14))
    assert run() == {f"s{k % 5}": k for k in range(9, 14)} and len(table.state()["deltas"]) == 2


# -- migrations, claims, numbers, locks -----------------------------------


def contents(site):
    return {k: (t.columns, sorted(map(str, t.collect()))) for k, t in site.tables().items()}


def test_steps_one_by_one_equal_all_at_once(spark, tmp_path):
    new, stepwise = (VersionedSite(spark, f"file://{tmp_path}/{k}") for k in "ab")
    assert migrations.migrate(new, "demo", 5)[0] == len(migrations.STEPS)
    for n in range(1, len(migrations.STEPS) + 1):
        assert migrations.migrate(stepwise, "demo", 5, upto=n)[0] == n
    assert contents(new) == contents(stepwise)
    numbers = new.numbers()
    assert migrations.migrate(new, "demo", 6) == (8, []) and new.numbers() == numbers


def test_an_old_site_is_repaired_in_one_commit(spark, tmp_path):
    site = VersionedSite(spark, f"file://{tmp_path}/s")
    migrations.migrate(site, "demo", 5, upto=5)
    old = site.tables()
    sha = "ab" * 32
    file_rows = [("local--files/p/a.png", None, sha, 4, "saved", 1, 1, "text/html"), ("http://demo.wikidot.com/local--files/q/[x", None, None, None, "pending", 1, None, None)]
    text = [(1, 1, "r1", 10, 7, "see local--files/p/b.png ", None)]
    site.commit({"files": spark.createDataFrame(file_rows, old["files"].schema), "revisions": spark.createDataFrame(text, old["revisions"].schema)})
    before = len(site.numbers())
    version, orphans = migrations.migrate(site, "demo", 9)
    assert version == 8 and len(site.numbers()) == before + 1
    got = {r["path"]: r["status"] for r in site.tables()["files"].collect()}
    assert got == {"http://demo.wikidot.com/local--files/p/a.png": "pending", "http://demo.wikidot.com/local--files/p/b.png": "pending"}
    jobs = site.tables()["jobs"]
    assert jobs.count() == jobs.select("id").distinct().count() == 2 and "archive_sha256" in site.tables()["out_state"].columns
    assert {r["sha256"] for o in orphans for r in o.collect()} == {sha}


def test_a_newer_or_unreadable_site_is_refused(spark, tmp_path):
    site = VersionedSite(spark, f"file://{tmp_path}/s")
    migrations.migrate(site, "demo", 5)
    for value, error in (("9", migrations.Newer), ("x", ValueError)):
        site.commit({"meta": spark.createDataFrame([("schema_version", value)], "key string, value string")})
        with pytest.raises(error):
            migrations.migrate(site, "demo", 5)


def test_a_failing_step_commits_nothing(spark, tmp_path):
    site = VersionedSite(spark, f"file://{tmp_path}/s")
    migrations.migrate(site, "demo", 5, upto=3)
    before = contents(site)

    def broken(tables, context):
        return {"jobs": tables["jobs"].withColumn("priority", F.raise_error(F.lit("broken")).cast("long")).unionByName(context.spark.createDataFrame([(1, "k", "{}", 1, "pending", 0, 0, 0, None)], tables["jobs"].schema).withColumn("priority", F.raise_error(F.lit("broken")).cast("long")))}

    with pytest.raises(PySparkException, match="broken"):
        migrations.migrate(site, "demo", 5, steps=(*migrations.STEPS[:4], broken))
    assert contents(site) == before and migrations.schema_version(site.tables()) == 3


def test_claims_of_all_sites(spark):
    jobs = [(k, f"s{k % 3}" if k < 30 else "hot", k % 2, "running" if k in (0, 3) or k == 31 else "pending", 5 if k != 1 else 50, 0) for k in range(200)]
    df = spark.createDataFrame(jobs, "id long, site string, priority int, status string, run_at long, attempts int")
    got = {}
    for r in queue.claim_by_site(df, 10, 4).collect():
        got.setdefault(r["site"], []).append(r["id"])
    free = {"s0": 2, "s1": 4, "s2": 4, "hot": 3}
    for site, n in free.items():
        due = sorted((j for j in jobs if j[1] == site and j[3] == "pending" and j[4] <= 10), key=lambda j: (-j[2], j[4], j[0]))
        assert sorted(got[site]) == sorted(j[0] for j in due[:n])
    assert "WindowGroupLimit" in queue.claim_by_site(df, 10, 4)._jdf.queryExecution().toString()


def test_new_jobs_are_numbered_densely(spark):
    jobs = spark.createDataFrame([(41,)], "id long")
    new = spark.range(5000).select(F.lit("k").alias("kind"), F.col("id").cast("string").alias("payload"))
    assert sorted(r["id"] for r in queue.numbered(new, jobs).collect()) == list(range(42, 5042))
    assert {(r["payload"], r["id"]) for r in queue.numbered(new, jobs).collect()} == {(r["payload"], r["id"]) for r in queue.numbered(new.repartition(7), jobs).collect()}
    assert sorted(r["id"] for r in queue.numbered(new.limit(2), jobs.where("false"), 100).collect()) == [100, 101]
    assert queue.numbered(new.where("false"), jobs).count() == 0


def test_a_journal_of_no_page_stops_the_import(spark):
    journals = spark.createDataFrame([("12", None), ("x1", None)], "key string, journal string")
    with pytest.raises(PySparkException, match="journal of no page: x1"):
        site_import.checked_journals(journals).collect()


def test_a_writer_that_lost_its_lock(spark, tmp_path):
    """It leaves its successor's lock alone and cannot move HEAD."""
    store = publication.Store(spark, f"file://{tmp_path}/o")
    with pytest.raises(RuntimeError, match="taken over"), store.locked() as slow:
        with store.locked(lease_s=-1) as quick:
            assert store.owns(quick) and not store.owns(slow)
            store.move_head("a" * 64, slow)
    with store.locked() as slow:
        successor = store.locked(lease_s=-1)
        quick = successor.__enter__()
    assert store.owns(quick) and store.move_head("b" * 64, quick)
    successor.__exit__(None, None, None)
    assert not Path(f"{tmp_path}/o/.publish.lock").exists()


# -- objects --------------------------------------------------------------


def blobs(spark, *found):
    return spark.createDataFrame([(bytearray(x) if x is not None else None,) for x in found], "content binary")


def test_a_run_publishes_all_or_nothing(spark, tmp_path):
    root = f"file://{tmp_path}/o"
    blob_sink.store_blobs(blobs(spark, b"a", b"b", b"a", None), root)
    first = sorted((r["sha256"][:4], r["size"]) for r in blob_sink.manifest(spark, root).collect())
    assert len(first) == 4 and blob_sink.list_blobs(spark, root).count() == 3
    broken = blobs(spark, b"c", b"d").withColumn("content", F.when(F.col("content") == F.lit(bytearray(b"d")), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("content")))
    with pytest.raises((PySparkException, Exception), match="lost"):
        blob_sink.store_blobs(broken, root)
    assert sorted((r["sha256"][:4], r["size"]) for r in blob_sink.manifest(spark, root).collect()) == first
    assert not list((tmp_path / "o/_aside").iterdir()) and not list((tmp_path / "o").rglob("*.part"))
    blob_sink.store_blobs(blobs(spark, b"a", b"c"), root)
    assert sorted((r["size"], r["written"]) for r in blob_sink.manifest(spark, root).collect())[-2:] and blob_sink.manifest(spark, root).count() == 6


def test_attempts_that_failed_are_in_no_manifest(tmp_path):
    """Two attempts of one task and one lost midway: the parts of the committed one count."""
    writer = blob_sink.BlobWriter(f"file://{tmp_path}/o", 0)
    good = writer.write(iter([(b"x",), (b"y",)]))
    again = writer.write(iter([(b"x",), (b"y",)]))

    def dying():
        yield (b"z",)
        raise OSError("killed")

    with pytest.raises(OSError, match="killed"):
        writer.write(dying())
    writer.commit([again, None])
    assert json.loads((tmp_path / f"o/_manifest/{writer.run}/parts").read_text()) == [again.name] != [good.name]
    sha = blob_sink.put_blob(*blob_sink._store(f"file://{tmp_path}/o"), b"x")
    assert sha[1] is False
    (tmp_path / "o" / files.blob_name(sha[0])).write_bytes(b"xx")
    with pytest.raises(OSError, match="bytes"):
        writer.write(iter([(b"x",)]))
    with pytest.raises(ValueError, match="append"):
        blob_sink.BlobStore({"path": "x"}).writer(None, True)


def test_objects_are_marked_then_swept(spark, tmp_path):
    import hashlib

    root, sha = f"file://{tmp_path}/o", {x: hashlib.sha256(x.encode()).hexdigest() for x in "abcd"}
    blob_sink.store_blobs(blobs(spark, *(x.encode() for x in "abcd")), root)
    marks = blob_sink.open_marks(spark, f"file://{tmp_path}/m")
    live = lambda names: spark.createDataFrame([(sha[x],) for x in names] + [(None,)], "sha256 string")
    listed = lambda: blob_sink.list_blobs(spark, root)
    name = {v: k for k, v in sha.items()}
    marked = lambda: {name[r["sha256"]]: r["since"] for r in marks.read().collect()}
    blob_sink.mark(marks, listed(), live("ab"), 100)
    assert marked() == {"c": 100, "d": 100}
    blob_sink.mark(marks, listed(), live("bc"), 150)  # c is referred to again, a no more
    assert marked() == {"a": 150, "d": 100}
    assert blob_sink.sweep(marks, live("bc"), root, 160, 60).collect()[0]["sha256"] == sha["d"]
    assert marked() == {"a": 150} and {name[r["sha256"]] for r in listed().collect()} == set("abc")
    # A reference that came after the mark saves the object, whatever its age.
    assert blob_sink.sweep(marks, live("abc"), root, 999, 60).count() == 0 and listed().count() == 3
    assert blob_sink.sweep(marks, live("bc"), root, 999, 60).count() == 1 and {name[r["sha256"]] for r in listed().collect()} == set("bc")
    assert blob_sink.list_blobs(spark, f"file://{tmp_path}/none").count() == 0 and blob_sink.manifest(spark, f"file://{tmp_path}/none").count() == 0
