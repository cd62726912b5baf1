"""Sections by parts and byte ranges, and publications of what changed."""

import hashlib
import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from strandline.operators import changed
from strandline.operators import publication as P
from strandline.operators.layered import LayeredTable
from strandline.plans import published as Q

SHELL = '{"title": "T", "subtitle": ""}'
#: Texts that hold what a reader of byte ranges cuts at, as far as JSON lets them.
NASTY = ['},{"path":"', "},{", ']}\n"\\', "é" * 40, '{"v":3,"site":"', ""]


def entries(spark, n):
    rows = [(f"{i:04d} {NASTY[i % len(NASTY)]}", i) for i in range(n)]
    return P.file_entries(spark.createDataFrame(rows, "path string, size long").select("path", F.lit(None).cast("string").alias("sha256"), "size", F.lit(NASTY[0]).alias("content_type"), F.lit("x").alias("status")))


def test_sections_have_the_same_bytes_in_any_number_of_parts(spark, tmp_path, monkeypatch):
    shas = []
    for size in (300, 5_000, 64 << 20):
        monkeypatch.setattr(P, "PART_BYTES", size)
        store = P.Store(spark, f"file://{tmp_path}/{size}")
        shas.append(P.put_section(store, "files", "s", entries(spark, 150).repartition(3), "path"))
        assert hashlib.sha256(store.get(P.object_name("files", shas[-1]))).hexdigest() == shas[-1]
        assert not any(Path(f"{tmp_path}/{size}/_aside").iterdir())
    assert len(set(shas)) == 1


@pytest.mark.parametrize("size", [50, 97, 1_000, 1 << 20])
def test_readers_of_byte_ranges_meet_every_entry_once(spark, tmp_path, size):
    store = P.Store(spark, f"file://{tmp_path}")
    site = 's"},{"path":'
    sha = P.put_section(store, "files", site, entries(spark, 60), "path")
    want = json.loads(store.get(P.object_name("files", sha)))["files"]
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k, v in zip(before, (size, 1), strict=True):
            spark.conf.set(k, v)
        read = P.read_section(store, "files", site, sha)
        assert sorted((r.asDict() for r in read.collect()), key=lambda r: r["path"]) == want
        assert sorted(json.loads(r.entry)["size"] for r in P.section_entries(store, "files", site, sha).collect()) == list(range(60))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_empty_section_and_a_section_of_another_site(spark, tmp_path):
    store = P.Store(spark, f"file://{tmp_path}")
    none = P.put_section(store, "files", "s", entries(spark, 5).limit(0), "path")
    assert P.read_section(store, "files", "s", none).count() == 0
    sha = P.put_section(store, "files", "s", entries(spark, 5), "path")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        P.read_section(store, "files", "other", sha).collect()


PAGES = "page_id long, slug string, title string, tags string"
REVISIONS = "page_id long, rev_no long, rev_id string, ts long, author string, content string"
FILES = "path string, sha256 string, size long, content_type string, status string"


def a_site(spark, root, packed=None):
    t = {n: LayeredTable(spark, f"file://{root}/{n}") for n in ("pages", "revisions", "files", "packed")}
    t["pages"].create(spark.createDataFrame([(i, f"p{i}", f"T{i}", '["a"]') for i in range(1, 7)], PAGES), ["page_id"], 2)
    revisions = [(i, k, f"r{i}-{k}", i * 10 + k, "me", None if i == 6 else f"text {i} {k}") for i in range(1, 7) for k in range(2)]
    t["revisions"].create(spark.createDataFrame(revisions, REVISIONS), ["page_id", "rev_no"], 2, by=["page_id"])
    t["files"].create(spark.createDataFrame([("b", "ab" * 32, 1, "image/png", "saved"), ("a", None, None, None, "missing")], FILES), ["path"], 2)
    return changed.Site("s", **(t | ({"packed": packed} if packed else {})))


def published(store):
    root, pages, files = P.read_publication(store)
    return root, {r.id: r.asDict() for r in pages.collect()}, {r.path: r.size for r in files.collect()}


def test_one_edit_packs_one_page_and_gives_what_a_whole_publication_gives(spark, tmp_path):
    store, site = P.Store(spark, f"file://{tmp_path}/out"), a_site(spark, tmp_path)
    first = changed.publish_changes(store, site, SHELL, Q.render, 3)
    assert (first.moved, first.packed, first.pages, first.files) == (True, 5, 6, 2)
    version = site.packed.pinned(None)
    again = changed.publish_changes(store, site, SHELL, Q.render, 3)
    assert (again.root, again.moved, again.packed, again.pages, again.files) == (first.root, False, 0, 0, 0)
    assert site.packed.pinned(None) == version
    files_before = P.read_publication(store)[0]["files"]

    site.revisions.upsert(spark.createDataFrame([(2, 2, "n", 99, "you", "new")], REVISIONS))
    site.pages.begin().upsert(spark.createDataFrame([(3, "p3", "other", "[]"), (9, "p9", "none", "[]")], PAGES)).delete(spark.createDataFrame([(5,)], "page_id long")).commit()
    out = changed.publish_changes(store, site, SHELL, Q.render, 3)
    assert (out.moved, out.packed, out.files) == (True, 1, 0)
    root, pages, _ = published(store)
    assert root["files"] == files_before and sorted(pages) == ["1", "2", "3", "4", "6", "9"]
    assert pages["2"]["revisions_stored"] == 3 and pages["2"]["updated_by"] == "you" and pages["3"]["title"] == "other" and pages["9"]["archive"] is None and pages["6"]["archive"] is None
    assert sorted(r.page_id for r in site.packed.read().collect()) == [1, 2, 3, 4]
    for page in pages.values():
        assert page["archive"] is None or store.exists(page["archive"])

    # Nothing to go on from: another store, and what was packed without a note.
    other = P.Store(spark, f"file://{tmp_path}/other")
    packed = LayeredTable(spark, f"file://{tmp_path}/packed2")
    packed.create(site.packed.read(), ["page_id"])
    whole = changed.publish_changes(other, changed.Site("s", site.pages, site.revisions, site.files, packed), SHELL, Q.render, 3)
    assert (whole.root, whole.packed) == (out.root, 0)
    anew = changed.publish_changes(P.Store(spark, f"file://{tmp_path}/anew"), changed.Site("s", site.pages, site.revisions, site.files, LayeredTable(spark, f"file://{tmp_path}/packed3")), SHELL, Q.render, 3)
    assert anew.packed == 4
    P.verify_publication(store)


def test_a_writer_lost_before_head_and_versions_that_are_gone(spark, tmp_path, monkeypatch):
    store, site = P.Store(spark, f"file://{tmp_path}/out"), a_site(spark, tmp_path)
    changed.publish_changes(store, site, SHELL, Q.render, 3)
    head = store.head()
    site.files.upsert(spark.createDataFrame([("c", None, None, None, "pending")], FILES))
    with monkeypatch.context() as m:
        m.setattr(P.Store, "move_head", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            changed.publish_changes(store, site, SHELL, Q.render, 3)
    assert store.head() == head and not store.exists(".publish.lock")
    out = changed.publish_changes(store, site, SHELL, Q.render, 3)
    assert out.moved and out.root != head and (out.packed, out.pages, out.files) == (0, 0, 0)
    assert sorted(published(store)[2]) == ["a", "b", "c"]

    site.files.delete(spark.createDataFrame([("b",)], "path string"))
    site.files.upsert(spark.createDataFrame([("d", None, None, None, "pending")], FILES))
    site.files.vacuum(keep=1, grace_s=0)
    out = changed.publish_changes(store, site, SHELL, Q.render, 3)
    assert (out.packed, out.pages, out.files) == (0, 6, 3) and sorted(published(store)[2]) == ["a", "c", "d"]


def test_groups_share_a_bucket(spark, tmp_path):
    table = LayeredTable(spark, f"file://{tmp_path}/t")
    table.create(spark.range(200).selectExpr("id % 20 AS g", "id AS k"), ["g", "k"], 8, by=["g"])
    table.delete(spark.createDataFrame([(3, 3), (3, 23)], "g long, k long"))
    table.upsert(spark.createDataFrame([(3, 500)], "g long, k long"))
    table.compact()
    read = table.read_groups(spark.createDataFrame([(3,)], "g long"))
    assert sorted(r.k for r in read.collect()) == [*range(43, 200, 20), 500]
    assert len({f.rsplit("_bucket=", 1)[1].split("/")[0] for f in read.inputFiles()}) == 1
    with pytest.raises(ValueError, match="not all keys"):
        LayeredTable(spark, f"file://{tmp_path}/u").create(spark.range(1), ["id"], by=["x"])
