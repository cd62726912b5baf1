"""Merkle manifest of a dataset: a leaf a row, a tree a language, one root, and a proof for every leaf.

A leaf's place among its language's leaves comes without a global sort: rows
are counted by ever shorter prefixes of their doc_id (a radix of 8, then 12
bits a digit), and running sums over one digit, at most 4,096 values below one
prefix, add up to exact ranks from the top down. Nothing is numbered in one task.

The rank in base ``FANOUT`` keys the trie: a node is the prefix that its leaves
share. Nodes are reduced longest prefix first, ``LEVELS`` digits at a time: one
group holds the at most 512 nodes below a prefix, hashes them level by level,
and its last node goes to the next round, of 1/512 as many rows. Then the
rounds are gone through backwards, so that each group meets the siblings of its
own prefix once, and proves and folds all its leaves in place.

Defined cases: rows with one doc_id (null included, which comes first) follow
each other by leaf; rows that are equal in all columns have equal leaves, count
as many leaves as there are, and are told apart by nothing (they are counted
before anything moves, then dealt out again in blocks); null text stays null
when tampered with; a row without doc_id is not tampered with; an empty table
has no rows. Other columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import table

FANOUT = 8
#: Levels of the trie that one round reduces.
LEVELS = 3
#: Bits of doc_id below which prefixes are counted, longest prefix first.
SHIFTS = (8, 20, 32, 44, 56)
#: Rows that one row stands for when equal ones are dealt out again.
COPIES = 512
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_hash(text: Column) -> Column:
    return F.sha2(F.concat(*(_part(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def every_third(doc_id: Column) -> Column:
    """Whether 3 divides the CRC-32 of doc_id in decimals."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def running(groups: list[str], order: list[str]) -> Column:
    """What comes before a row in its group."""
    return F.coalesce(F.sum("n").over(Window.partitionBy(*groups).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))


def prefix_ranks(counts: DataFrame, group: list[str], key: str, shifts: tuple[int, ...] = SHIFTS) -> DataFrame:
    """group columns, key and first: rows of the group whose key is smaller; counts(group..., key, n) has each key once.

    key is a long; null comes first.
    """
    spark = counts.sparkSession
    name = [f"p{s}" for s in shifts]
    keyed = counts.withColumn("blank", F.col(key).isNull()).withColumn(key, F.coalesce(F.col(key), F.lit(0).cast("long")))
    levels = [table(spark, keyed.withColumn(name[0], F.shiftright(key, shifts[0])).groupBy(*group, "blank", name[0]).agg(F.sum("n").alias("n")))]
    for k in range(1, len(shifts)):
        upper = levels[-1].withColumn(name[k], F.shiftright(name[k - 1], shifts[k] - shifts[k - 1]))
        levels.append(upper.groupBy(*group, "blank", name[k]).agg(F.sum("n").alias("n")))
    # From the top down: a prefix begins where its parent does, after its smaller siblings.
    first = levels[-1].select(*group, "blank", name[-1], running(group, [F.desc("blank"), name[-1]]).alias("first"))
    for k in range(len(shifts) - 2, -1, -1):
        below = levels[k].withColumn(name[k + 1], F.shiftright(name[k], shifts[k + 1] - shifts[k]))
        below = below.withColumn("within", running([*group, "blank", name[k + 1]], [name[k]]))
        first = below.join(first, [*group, "blank", name[k + 1]]).select(*group, "blank", name[k], (F.col("first") + F.col("within")).alias("first"))
    rows = keyed.withColumn(name[0], F.shiftright(key, shifts[0]))
    rows = rows.withColumn("within", running([*group, "blank", name[0]], [key]))
    placed = rows.join(first, [*group, "blank", name[0]])
    return placed.select(*group, F.when(~F.col("blank"), F.col(key)).alias(key), (F.col("first") + F.col("within")).alias("first"))


def leaves_of(documents: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered, n): distinct leaves; tampered is null where nothing was tampered with."""
    own = documents.select(*(F.col(f"`{c}`") for c in FIELDS))
    hashed = own.select(F.col("lang"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(F.col("text")).alias("leaf"), F.when(every_third(F.col("doc_id")), leaf_hash(lower_ascii(F.col("text")))).alias("tampered"))
    return hashed.groupBy("lang", "doc_id", "leaf", "tampered").agg(F.count(F.lit(1)).alias("n"))


def language_numbers(leaves: DataFrame) -> DataFrame:
    """(lang, g, n): languages from 0 in byte order, null first, and their leaves."""
    counted = leaves.groupBy("lang").agg(F.sum("n").alias("n"))
    # Counted by the first bytes first, so that no window holds more than the languages that share them.
    head = counted.withColumn("head", F.substring(F.encode(F.coalesce("lang", F.lit("")), "utf-8"), 1, 2)).withColumn("blank", F.col("lang").isNull())
    heads = head.groupBy("blank", "head").agg(F.count(F.lit(1)).alias("n"))
    heads = heads.select("blank", "head", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("blank"), "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = F.row_number().over(Window.partitionBy("blank", "head").orderBy("lang")) - 1
    return head.withColumn("within", within).join(heads, ["blank", "head"]).select("lang", (F.col("first") + F.col("within")).cast("long").alias("g"), "n")


def ranked_leaves(leaves: DataFrame, languages: DataFrame) -> DataFrame:
    """(g, rank, doc_id, leaf, tampered): every leaf, ranked in its language by doc_id, ties by leaf."""
    spark = leaves.sparkSession
    numbered = leaves.join(F.broadcast(languages.select("lang", "g")) if languages.rows_written <= 1 << 16 else languages.select("lang", "g"), leaves["lang"].eqNullSafe(languages["lang"])).drop("lang")
    numbered = table(spark, numbered)
    ids = table(spark, numbered.groupBy("g", "doc_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("different")))
    first = prefix_ranks(ids.drop("different"), ["g"], "doc_id")
    # Different rows of one doc_id: ranked by leaf, through counts by its first digits.
    tied = numbered.join(ids.where("different > 1").select(F.col("g").alias("tg"), F.col("doc_id").alias("tid")), (F.col("g") == F.col("tg")) & F.col("doc_id").eqNullSafe(F.col("tid")), "left_semi")
    tied = tied.select("g", "doc_id", "leaf", "n", F.substring("leaf", 1, 3).alias("head"))
    heads = tied.groupBy("g", "doc_id", "head").agg(F.sum("n").alias("n"))
    heads = heads.select(F.col("g").alias("hg"), F.col("doc_id").alias("hid"), F.col("head").alias("hh"), running(["g", "doc_id"], ["head"]).alias("start"))
    inner = tied.select("g", "doc_id", "leaf", "head", running(["g", "doc_id", "head"], ["leaf"]).alias("within"))
    inner = inner.join(heads, (F.col("g") == F.col("hg")) & F.col("doc_id").eqNullSafe(F.col("hid")) & (F.col("head") == F.col("hh")))
    inner = inner.select(F.col("g").alias("ig"), F.col("leaf").alias("ileaf"), (F.col("start") + F.col("within")).alias("shift"))
    first = first.select(F.col("g").alias("fg"), F.col("doc_id").alias("fid"), "first")
    placed = numbered.join(first, (F.col("g") == F.col("fg")) & F.col("doc_id").eqNullSafe(F.col("fid"))).drop("fg", "fid")
    placed = placed.join(inner, (F.col("g") == F.col("ig")) & (F.col("leaf") == F.col("ileaf")), "left")
    placed = table(spark, placed.select("g", (F.col("first") + F.coalesce("shift", F.lit(0).cast("long"))).alias("rank"), "doc_id", "leaf", "tampered", "n"))
    alone = placed.where("n = 1").drop("n")
    blocks = placed.where("n > 1").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {COPIES}")))).repartition("leaf", "block")
    copy = F.explode(F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1))
    copies = blocks.withColumn("copy", copy).select("g", (F.col("rank") + F.col("copy")).alias("rank"), "doc_id", "leaf", "tampered")
    return alone.unionByName(copies)


def _join(hashes: Column) -> Column:
    return F.array_join(hashes, "")


def _above(nodes: Column) -> Column:
    """The hashes of every run of FANOUT nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda j: F.sha2(_join(F.slice(nodes, j * FANOUT + 1, F.lit(FANOUT))), 256))


def _siblings(nodes: Column, at: Column) -> Column:
    """What stands left and right of a node in its run, joined."""
    begin = at - at % FANOUT
    left = _join(F.slice(nodes, begin + 1, at - begin))
    right = _join(F.slice(nodes, at + 2, F.lit(FANOUT - 1) - (at - begin)))
    return F.struct(left.alias("l"), right.alias("r"))


def reduce_round(nodes: DataFrame, payload: list[str]) -> DataFrame:
    """nodes(g, n, rank, node, payload...) grouped by the prefix above LEVELS digits of rank: (g, n, prefix, rows, level0.., steps, top).

    n is the number of nodes of g in this round; a tree of fewer levels stops at its root.
    """
    wide = FANOUT**LEVELS
    grouped = nodes.withColumn("prefix", F.expr(f"rank div {wide}")).groupBy("g", "n", "prefix").agg(F.array_sort(F.collect_list(F.struct("rank", "node", *payload))).alias("rows"))
    out = grouped.withColumn("level0", F.col("rows.node")).withColumn("steps", sum((F.col("n") > FANOUT**k).cast("int") for k in range(LEVELS)))
    for k in range(1, LEVELS):
        out = out.withColumn(f"level{k}", F.when(F.col("steps") >= k, _above(F.col(f"level{k - 1}"))).otherwise(F.array().cast("array<string>")))
    last = _above(F.col(f"level{LEVELS - 1}"))[0]
    for k in range(LEVELS - 1, -1, -1):
        last = F.when(F.col("steps") == k, F.col(f"level{k}")[0]).otherwise(last)
    return out.withColumn("top", last)


def own_path(at: Column) -> Column:
    """The siblings of the node at place at of a group, from its level up to the group's last node."""
    levels = [F.when(F.col("steps") > k, _siblings(F.col(f"level{k}"), F.shiftright(at, 3 * k))) for k in range(LEVELS)]
    return F.filter(F.array(*levels), lambda x: x.isNotNull())


def tree(nodes: DataFrame, most: int, payload: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of nodes(g, n, rank, node, payload...), at most most a group: the first round's groups with path (above them), and (g, root)."""
    spark = nodes.sparkSession
    wide = FANOUT**LEVELS
    rounds = [table(spark, reduce_round(nodes, payload))]
    while most > wide:
        most = -(-most // wide)
        upper = rounds[-1].select("g", F.expr(f"(n + {wide - 1}) div {wide}").alias("n"), F.col("prefix").alias("rank"), F.col("top").alias("node"))
        rounds.append(table(spark, reduce_round(upper, [])))
    roots = rounds[-1].select("g", F.col("top").alias("root"))
    nothing = F.array().cast("array<struct<l: string, r: string>>")
    above = rounds[-1].withColumn("path", nothing)
    for k in range(len(rounds) - 2, -1, -1):
        paths = F.transform("rows", lambda x, i: F.struct(x["rank"].alias("rank"), F.concat(own_path(i), F.col("path")).alias("path")))
        each = above.select("g", F.explode(paths).alias("x")).select("g", F.col("x.rank").alias("prefix"), "x.path")
        above = rounds[k].join(each, ["g", "prefix"])
    return above, roots


def manifest(documents: DataFrame) -> DataFrame:
    """One row a document: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified."""
    spark = documents.sparkSession
    leaves = table(spark, leaves_of(documents))
    languages = table(spark, language_numbers(leaves))
    most, n_languages = languages.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    ranked = ranked_leaves(leaves, languages).withColumnRenamed("leaf", "node")
    sizes = languages.select("g", "n")
    groups, subroots = tree(ranked.join(F.broadcast(sizes) if n_languages <= 1 << 16 else sizes, "g"), most, ["doc_id", "tampered"])
    # The tree of the subroots: its one group is named 0, and its path goes on where the languages' end.
    upper, root = tree(subroots.select(F.lit(0).cast("long").alias("g"), F.lit(n_languages).cast("long").alias("n"), F.col("g").alias("rank"), F.col("root").alias("node")), n_languages, [])
    ends = F.transform("rows", lambda x, i: F.struct(x["rank"].alias("g"), x["node"].alias("subroot"), F.concat(own_path(i), F.col("path")).alias("end")))
    ends = upper.select(F.explode(ends).alias("x")).select("x.*").crossJoin(F.broadcast(root.select("root")))  # one row
    ends = ends.join(languages.select("g", "lang"), "g")
    whole = groups.join(F.broadcast(ends) if n_languages <= 1 << 12 else ends, "g")

    def proven(x, i):
        # transform() over one element names the path, which is used twice.
        one = F.transform(F.array(F.concat(own_path(i), F.col("path"), F.col("end"))), lambda path: F.struct(
            F.sha2(_join(F.transform(path, lambda s: F.concat(s["l"], s["r"]))), 256).alias("proof"),
            F.aggregate(path, F.coalesce(x["tampered"], x["node"]), lambda node, s: F.sha2(F.concat(s["l"], node, s["r"]), 256)).alias("folded"),
        ))
        return F.struct(x["doc_id"].alias("doc_id"), x["node"].alias("leaf"), one[0].alias("p"))

    rows = whole.select("lang", "subroot", "root", F.explode(F.transform("rows", proven)).alias("x"))
    return rows.select("x.doc_id", "lang", "x.leaf", "subroot", "root", F.col("x.p.proof").alias("proof_sha256"), F.col("x.p.folded").alias("folded_root"), (F.col("x.p.folded") == F.col("root")).alias("verified"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("lang")


QUERIES = {"op13_merkle_manifest": op13}


def _oracle(levels: int = 8, top_levels: int = 4) -> str:
    """SQL that unrolls the levels: FANOUT**levels leaves a language, FANOUT**top_levels languages."""
    part = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"
    leaf = lambda text: f"sha256({' || '.join(part(text if c == 'text' else c) for c in FIELDS)})"
    byte = "(SELECT k, k AS x FROM range(256) r(k))"
    for _ in range(8):
        byte = f"(SELECT k, xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END) AS x FROM {byte})"
    sql = [
        f"c AS (SELECT list(x ORDER BY k) AS crc FROM {byte})",
        "t AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), "
        "lambda h, b: xor(crc[(xor(h, b) & 255) + 1], h >> 8)), 4294967295) % 3 = 0 AS bad FROM documents d, c)",
        f"l AS (SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN bad THEN {leaf(f'''translate(text, '{UPPER}', '{LOWER}')''')} END AS tampered FROM t)",
        "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, count(*) AS n FROM l GROUP BY lang)",
        "a0 AS (SELECT g, n, doc_id, leaf, tampered, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM l JOIN g ON l.lang IS NOT DISTINCT FROM g.lang)",
        "n0 AS (SELECT g, n, r, leaf AS h FROM a0)",
        "p0 AS (SELECT g, n, r, doc_id, leaf, coalesce(tampered, leaf) AS f, '' AS proof, r AS leaf_r FROM a0)",
    ]

    def climb(n: int, count: int, extra: str) -> int:
        for _ in range(count):
            runs = f"s{n} AS (SELECT g, r // 8 AS q, list(h ORDER BY r) AS hs FROM n{n} GROUP BY g, r // 8)"
            nodes = f"n{n + 1} AS (SELECT g, any_value((n + 7) // 8) AS n, r // 8 AS r, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h FROM n{n} GROUP BY g, r // 8)"
            left, right = "coalesce(array_to_string(hs[1:r % 8], ''), '')", "coalesce(array_to_string(hs[r % 8 + 2:], ''), '')"
            paths = (
                f"p{n + 1} AS (SELECT p.g, (n + 7) // 8 AS n, r // 8 AS r, doc_id, leaf, leaf_r, CASE WHEN n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, "
                f"CASE WHEN n > 1 THEN sha256({left} || f || {right}) ELSE f END AS f{extra} FROM p{n} p JOIN s{n} s ON p.g = s.g AND p.r // 8 = s.q)"
            )
            sql.extend([runs, nodes, paths])
            n += 1
        return n

    n = climb(0, levels, "")
    sql.append(f"n{n + 1} AS (SELECT 0 AS g, (SELECT count(*) FROM n{n}) AS n, g AS r, h FROM n{n})")
    sql.append(f"p{n + 1} AS (SELECT 0 AS g, (SELECT count(*) FROM n{n}) AS n, p.g AS r, doc_id, leaf, leaf_r, proof, f, h AS subroot FROM p{n} p JOIN n{n} m ON p.g = m.g)")
    n = climb(n + 1, top_levels, ", subroot")
    return f"WITH {', '.join(sql)} SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = h AS verified FROM p{n}, n{n}"


ORACLE = {"op13_merkle_manifest": _oracle()}
