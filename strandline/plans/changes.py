"""Merges and queue transitions over the driver's tables: the whole new state, checked in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import merge as M
from strandline.operators import queue
from strandline.plans.catalog import NOW
from strandline.sources import tables as T

PAGE_COLUMNS = ["page_id", "slug", "title", "updated_at", "discovered_at"]


def _page_delta(s, d):
    """Synced pages: every third one known, and some new."""
    p = T.pages(s, d)
    known = p.where("page_id % 3 = 0").select("page_id", F.concat("slug", F.lit("-x")).alias("slug"), F.upper("title").alias("title"), F.when(F.col("page_id") % 2 == 0, F.col("page_id") * 99).alias("updated_at"), F.lit(1).cast("long").alias("discovered_at"))
    fresh = p.where("page_id % 5 = 0").select((F.col("page_id") + 10_000_000).alias("page_id"), F.concat(F.lit("new-"), "slug").alias("slug"), "title", F.lit(None).cast("long").alias("updated_at"), F.lit(2).cast("long").alias("discovered_at"))
    return known.unionByName(fresh)


def m01(s, d):
    rules = {"slug": M.keep_new, "title": M.keep_new, "updated_at": M.new_or_old}
    return M.upsert(T.pages(s, d).select(PAGE_COLUMNS), _page_delta(s, d), ["page_id"], rules)


def _meta(s, d):
    return T.revisions(s, d).select("page_id", "rev_no", "content")


def m02(s, d):
    delta = _meta(s, d).select("page_id", (F.col("rev_no") + 2).alias("rev_no"), F.lit("new").alias("content"))
    return M.insert_or_ignore(_meta(s, d), delta, ["page_id", "rev_no"])


def _content(s, d, rule):
    delta = _meta(s, d).where("rev_no % 2 = 0").select("page_id", "rev_no", F.lit("fetched").alias("content"))
    return M.upsert(_meta(s, d), delta, ["page_id", "rev_no"], {"content": rule})


def m05(s, d):
    delta = _meta(s, d).where("content is null").select("page_id", "rev_no", F.lit("late").alias("content"))
    return M.update_existing(_meta(s, d), delta, ["page_id", "rev_no"], ["content"])


def _file_state(s, d):
    """One row a path."""
    return M.best_of_group(T.files(s, d).select("path", "sha256", "size", "status", "first_seen"), ["path"], [F.col("first_seen")])


def m06(s, d):
    state = _file_state(s, d)
    delta = state.where("status = 'pending'").select("path", F.sha2("path", 256).alias("sha256"), F.lit(7).cast("long").alias("size"), F.lit("saved").alias("status"), F.lit(-1).cast("long").alias("first_seen"))
    return M.upsert(state, delta, ["path"], {"sha256": M.keep_new, "size": M.keep_new, "status": M.keep_new})


def m07(s, d):
    state = _file_state(s, d)
    delta = state.where("first_seen % 4 = 0").select("path", F.lit("missing").alias("status"), F.lit(-1).cast("long").alias("first_seen"))
    return M.upsert(state, delta, ["path"], {"status": M.keep_new})


def m09(s, d):
    denied = T.denied_revisions(s, d)
    delta = T.revisions(s, d).where("rev_no % 4 = 1").select("page_id", "rev_no", F.lit("gone").alias("reason"))
    return M.replace_rows(denied, delta, ["page_id", "rev_no"])


def m12(s, d):
    """packed_at moves only where what was packed changed."""
    state = T.out_state(s, d).withColumn("packed_at", F.lit(1).cast("long"))
    delta = state.select("page_id", F.when(F.col("page_id") % 6 == 0, F.col("packed_revs") + 1).otherwise(F.col("packed_revs")).alias("packed_revs"), "archive_sha256", F.lit(2).cast("long").alias("packed_at"))
    changed = lambda _: ~F.col("o.packed_revs").eqNullSafe(F.col("n.packed_revs")) | ~F.col("o.archive_sha256").eqNullSafe(F.col("n.archive_sha256"))
    return M.upsert(state, delta, ["page_id"], dict.fromkeys(("packed_revs", "archive_sha256", "packed_at"), M.keep_new), where=changed)


def _jobs(s, d):
    return T.jobs(s, d)


def _failing_jobs(s, d):
    """Every job with an error of an earlier try."""
    return _jobs(s, d).withColumn("last_error", F.concat(F.lit("error "), "id"))


def _unique_jobs(s, d):
    """Durable jobs once each; the ephemeral ones as they are."""
    j = _jobs(s, d)
    durable = M.best_of_group(j.where("kind <> 'page.sync'"), ["kind", "payload"], [F.col("id")])
    return durable.unionByName(j.where("kind = 'page.sync'"))


def _new_jobs(s, d):
    p = T.pages(s, d)
    return p.select((F.col("page_id") + 50_000_000).alias("id"), F.when(F.col("page_id") % 3 == 0, F.lit("page.sync")).otherwise(F.lit("file.fetch")).alias("kind"), F.concat(F.lit('{"id":'), "page_id", F.lit("}")).alias("payload"), F.lit(10).cast("long").alias("priority"), F.lit(NOW).cast("long").alias("run_at"), F.lit(8).cast("long").alias("max_attempts"))


JOB = ["id", "kind", "payload", "priority", "status", "run_at", "attempts", "max_attempts", "last_error"]

QUERIES = {
    "m01_page_upsert": m01,
    "m02_insert_or_ignore": m02,
    "m03_content_if_absent": lambda s, d: _content(s, d, M.old_or_new),
    "m04_content_overwrite": lambda s, d: _content(s, d, M.keep_new),
    "m05_update_existing": m05,
    "m06_file_saved": m06,
    "m07_file_missing": m07,
    "m09_replace_denied": m09,
    "m12_conditional_upsert": m12,
    "m13_enqueue": lambda s, d: queue.enqueue(_unique_jobs(s, d), _new_jobs(s, d)).select(JOB),
    "m14_retune": lambda s, d: _jobs(s, d).withColumn("priority", F.when((F.col("kind") == "file.fetch") & F.col("status").isin("pending", "dead"), 10).otherwise(F.col("priority")).cast("long")).select("id", "priority"),
    "m15_delete": lambda s, d: M.delete_rows(_file_state(s, d), _file_state(s, d).where("path like '%|%'"), ["path"]),
    "i07_resurrect": lambda s, d: queue.enqueue(_unique_jobs(s, d), _new_jobs(s, d), resurrect=True).select(JOB),
    "i08_claim_state": lambda s, d: queue.apply_claim(_jobs(s, d), queue.claim(_jobs(s, d), NOW, 100), 100).select(JOB),
    "i09_fail": lambda s, d: queue.fail(_jobs(s, d), _jobs(s, d).where("status = 'running'").select("id", F.lit("boom").alias("error"), (F.col("id") % 7 == 0).alias("permanent")), NOW).select(JOB),
    "i10_complete": lambda s, d: queue.complete(_failing_jobs(s, d), _jobs(s, d).where("status = 'running'").select("id", F.when(F.col("id") % 2 == 0, F.lit(NOW + 60)).cast("long").alias("resched"))).select(JOB),
    "i11_recover": lambda s, d: queue.recover(_jobs(s, d)).select("id", "status"),
}

R, D, P, FI, J, O = (T.SQL[k] for k in ("revisions", "denied", "pages", "files", "jobs", "out_state"))
_PD = f"""(SELECT page_id, slug || '-x' AS slug, upper(title) AS title, CASE WHEN page_id % 2 = 0 THEN page_id * 99 END AS updated_at, 1::BIGINT AS discovered_at FROM {P} WHERE page_id % 3 = 0
  UNION ALL SELECT page_id + 10000000, 'new-' || slug, title, NULL, 2 FROM {P} WHERE page_id % 5 = 0)"""
_FS = f"(SELECT path, sha256, size, status, first_seen FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY first_seen) AS rn FROM {FI}) WHERE rn = 1)"
_UJ = f"(SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY kind, payload ORDER BY id) AS rn FROM {J}) WHERE rn = 1 OR kind = 'page.sync')"
_NJ = f"(SELECT page_id + 50000000 AS id, CASE WHEN page_id % 3 = 0 THEN 'page.sync' ELSE 'file.fetch' END AS kind, '{{\"id\":' || page_id || '}}' AS payload, 10::BIGINT AS priority, {NOW}::BIGINT AS run_at, 8::BIGINT AS max_attempts FROM {P})"
_COLS = ", ".join(JOB)
_ADDED = f"""SELECT id, kind, payload, priority, 'pending' AS status, run_at, 0::BIGINT AS attempts, max_attempts, NULL::VARCHAR AS last_error FROM {_NJ} n
  WHERE kind = 'page.sync' OR NOT EXISTS (SELECT 1 FROM {_UJ} j WHERE j.kind = n.kind AND j.payload = n.payload)"""
_CLAIM = f"(SELECT id FROM {J} WHERE status = 'pending' AND run_at <= {NOW} ORDER BY priority DESC, run_at, id LIMIT 100)"

ORACLE = {
    "m01_page_upsert": f"""SELECT page_id, coalesce(n.slug, o.slug) AS slug, coalesce(n.title, o.title) AS title, coalesce(n.updated_at, o.updated_at) AS updated_at, coalesce(o.discovered_at, n.discovered_at) AS discovered_at
      FROM {P} o FULL OUTER JOIN {_PD} n USING (page_id)""",
    "m02_insert_or_ignore": f"SELECT page_id, rev_no, content FROM {R} UNION ALL SELECT page_id, rev_no + 2, 'new' FROM {R} r WHERE NOT EXISTS (SELECT 1 FROM {R} x WHERE x.page_id = r.page_id AND x.rev_no = r.rev_no + 2)",
    "m03_content_if_absent": f"SELECT page_id, rev_no, CASE WHEN rev_no % 2 = 0 THEN coalesce(content, 'fetched') ELSE content END AS content FROM {R}",
    "m04_content_overwrite": f"SELECT page_id, rev_no, CASE WHEN rev_no % 2 = 0 THEN 'fetched' ELSE content END AS content FROM {R}",
    "m05_update_existing": f"SELECT page_id, rev_no, coalesce(content, 'late') AS content FROM {R}",
    "m06_file_saved": f"SELECT path, CASE WHEN status = 'pending' THEN sha256(path) ELSE sha256 END AS sha256, CASE WHEN status = 'pending' THEN 7 ELSE size END AS size, CASE WHEN status = 'pending' THEN 'saved' ELSE status END AS status, first_seen FROM {_FS}",
    "m07_file_missing": f"SELECT path, sha256, size, CASE WHEN first_seen % 4 = 0 THEN 'missing' ELSE status END AS status, first_seen FROM {_FS}",
    "m09_replace_denied": f"SELECT page_id, rev_no, 'gone' AS reason FROM {R} WHERE rev_no % 4 = 1 UNION ALL SELECT * FROM {D} WHERE rev_no % 4 <> 1",
    "m12_conditional_upsert": f"SELECT page_id, packed_revs + CASE WHEN page_id % 6 = 0 THEN 1 ELSE 0 END AS packed_revs, archive_sha256, CASE WHEN page_id % 6 = 0 THEN 2 ELSE 1 END::BIGINT AS packed_at FROM {O}",
    "m13_enqueue": f"SELECT {_COLS} FROM {_UJ} UNION ALL {_ADDED}",
    "m14_retune": f"SELECT id, CASE WHEN kind = 'file.fetch' AND status IN ('pending', 'dead') THEN 10 ELSE priority END::BIGINT AS priority FROM {J}",
    "m15_delete": f"SELECT * FROM {_FS} WHERE path NOT LIKE '%|%'",
    "i07_resurrect": f"""SELECT j.id, j.kind, j.payload, CASE WHEN b THEN n.priority ELSE j.priority END AS priority, CASE WHEN b THEN 'pending' ELSE status END AS status, CASE WHEN b THEN n.run_at ELSE j.run_at END AS run_at,
      CASE WHEN b THEN 0 ELSE attempts END AS attempts, j.max_attempts, CASE WHEN b THEN NULL ELSE last_error END AS last_error
      FROM (SELECT j.*, EXISTS (SELECT 1 FROM {_NJ} n WHERE n.kind = j.kind AND n.payload = j.payload) AND status IN ('done', 'dead') AND kind <> 'page.sync' AS b FROM {_UJ} j) j
      LEFT JOIN (SELECT * FROM {_NJ} WHERE kind <> 'page.sync') n ON n.kind = j.kind AND n.payload = j.payload UNION ALL {_ADDED}""",
    "i08_claim_state": f"SELECT id, kind, payload, priority, CASE WHEN c THEN 'running' ELSE status END AS status, run_at, attempts + c::INT AS attempts, max_attempts, last_error FROM (SELECT *, id IN {_CLAIM} AS c FROM {J})",
    "i09_fail": f"""SELECT id, kind, payload, priority, CASE WHEN f THEN CASE WHEN dead THEN 'dead' ELSE 'pending' END ELSE status END AS status,
      CASE WHEN f AND NOT dead THEN {NOW} + least(10 * (1::BIGINT << greatest(0, least(10, attempts - 1))::INT), 3600) ELSE run_at END AS run_at, attempts, max_attempts, CASE WHEN f THEN 'boom' ELSE last_error END AS last_error
      FROM (SELECT *, status = 'running' AS f, id % 7 = 0 OR (max_attempts > 0 AND attempts >= max_attempts) AS dead FROM {J})""",
    "i10_complete": f"""SELECT id, kind, payload, priority, CASE WHEN status = 'running' THEN CASE WHEN id % 2 = 0 THEN 'pending' ELSE 'done' END ELSE status END AS status,
      CASE WHEN status = 'running' AND id % 2 = 0 THEN {NOW + 60} ELSE run_at END AS run_at, attempts, max_attempts,
      CASE WHEN status = 'running' AND id % 2 = 0 THEN NULL ELSE 'error ' || id END AS last_error FROM {J} WHERE NOT (status = 'running' AND kind = 'page.sync')""",
    "i11_recover": f"SELECT id, CASE WHEN status = 'running' THEN 'pending' ELSE status END AS status FROM {J}",
}
