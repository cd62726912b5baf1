"""The training-data operators against brute force on small fixtures, and their defined edge cases."""

import hashlib
import itertools
import json
import math
import os
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import chat_format, common, crf, decontamination, html_extraction, jaccard_join, language_id, piece_sampling, sharding, substring_dedup, tokenizer_quality, toxicity
from strandline.llm.automaton import SuffixAutomaton

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id long, text string, lang string, source string, n_chars long, n_words string, score int, spans int, key string, component_id string"


def documents(spark, texts, langs=None, first=0):
    """Extra columns have the names that operators use inside."""
    rows = [(first + i, t, (langs or {}).get(i, "en"), "s", len(t or ""), "x", 1, 2, "k", "c") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(n)] for n in (3, 9, 10, 11, 12, 20, 21, 30, 60, 90, 150, 400)]
    texts = []
    for b in base:
        texts.append(" ".join(b))
        for _ in range(6):
            c = list(b)
            for _ in range(rng.choice((0, 0, 1, 1, 2, 3))):
                at = rng.randrange(len(c))
                if rng.random() < 0.5:
                    c[at] = rng.choice(words)
                else:
                    c = c[:at] + c[at + 1 :]
            texts.append((" " if rng.random() < 0.5 else "\n").join(c).replace("w1", "W1"))
    texts += [None, "", " \n\t", "one", "one", "one two", "One Two", "a b c", "x y z q", texts[40], texts[40]]
    rng.shuffle(texts)
    return texts


def brute_components(texts, size, percent):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t)) if t else []
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(texts)), 2):
        common_ = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * common_ >= percent * (len(sets[a]) + len(sets[b]) - common_):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return [(i, len(sets[i]), find(i)) for i in range(len(texts))]


@pytest.mark.parametrize(("size", "percent", "boundary"), [(3, 90, 19), (3, 90, 9), (3, 90, None), (5, 80, 14), (5, 80, None)])
def test_jaccard_equals_brute_force(spark, corpus, size, percent, boundary):
    got = jaccard_join.jaccard_join(documents(spark, corpus), size, percent, boundary).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(corpus, size, percent)


@pytest.mark.parametrize(("size", "percent", "block"), [(3, 90, 500), (3, 90, 2), (5, 80, 500)])
def test_jaccard_counts_every_link(spark, corpus, monkeypatch, size, percent, block):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", block)
    monkeypatch.setattr(jaccard_join, "COMPONENT_ROWS", block)
    base = [f"v{k}" for k in range(200)]
    texts = [*corpus, *(" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 200, 20))]
    sets = []
    for t in texts:
        w = WORD.findall(lower(t)) if t else []
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    classes = set(sets) - {frozenset()}
    degree = Counter()
    for a, b in itertools.combinations(classes, 2):
        common_ = len(a & b)
        if 100 * common_ >= percent * (len(a) + len(b) - common_):
            degree.update((a, b))
    got = {r["doc_id"]: r["n_links"] for r in jaccard_join.jaccard_join(documents(spark, texts), size, percent).collect()}
    assert got == {i: degree[s] for i, s in enumerate(sets)} and max(degree.values()) >= 9


@pytest.mark.parametrize("counted", [True, False])
def test_near_copies_with_a_null_doc_id(spark, counted):
    base = [f"v{k}" for k in range(200)]
    texts = [" ".join([*base[:k], f"x{k}", *base[k + 1 :]]) for k in range(0, 120, 20)]
    for without in (range(6), range(3), range(3, 6)):
        df = documents(spark, texts).withColumn("doc_id", F.when(~F.col("doc_id").isin(*without), F.col("doc_id")))
        low = min(set(range(6)) - set(without), default=None)
        assert {r["component_id"] for r in jaccard_join.jaccard_join(df, counted=counted).collect()} == {low}


@pytest.mark.parametrize("percent", [80, 90])
def test_keys_meet_for_every_linked_pair(percent):
    rng = np.random.default_rng(3)
    plan = jaccard_join.Plan(percent, 9)

    def keys(members, order):
        members = np.sort(members)
        sigs, _, early = jaccard_join.list_entries(members, np.array([0, len(members)]), plan, order)
        light = jaccard_join.light_keys(members, plan).tolist() if plan.light(len(members)) else []
        return {*sigs.tolist(), *light}, {*sigs[early].tolist(), *light}

    for n in [*range(2, 60), 100, 333, 1000]:
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        order = jaccard_join.Order(a[: n // 2], rng.integers(1, 1000, n // 2).astype(float))
        most = (100 - percent) * n // 100 + 1
        for gone in range(0, most + 1):
            for added in range(0, most + 1 - gone):
                b = np.concatenate([a[gone:], rng.integers(0, 1 << 63, added).astype(np.uint64)])
                inter = n - gone
                if gone + added and 100 * inter >= percent * (n + len(b) - inter):
                    (all_a, early_a), (all_b, early_b) = keys(a, order), keys(b, order)
                    assert all_a & all_b & (early_a | early_b), (n, gone, added)
            if n > 100:
                break


@pytest.mark.parametrize("counted", [True, False])
def test_a_hub_whose_near_copies_do_not_chain(spark, monkeypatch, counted):
    monkeypatch.setattr(jaccard_join, "LIST_ROWS", 64)
    monkeypatch.setattr(jaccard_join, "COMPONENT_ROWS", 64)
    monkeypatch.setattr(jaccard_join, "CENTRE_ROWS", 50)
    base = [f"v{k}" for k in range(202)]
    texts = [" ".join(base)]
    for k in range(300):
        own = list(base)
        for at in (k % 66 * 3, (k * 7 + 1) % 67 * 3, (k * 13 + 2) % 65 * 3):
            own[at] = f"x{k}-{at}"
        texts.append(" ".join(own))
    texts += texts[5:9] + [None, "other words only"]
    df = documents(spark, texts).withColumn("doc_id", F.when(~F.col("doc_id").isin(0, 17), F.col("doc_id")))
    got = jaccard_join.jaccard_join(df, counted=counted)
    want = Counter(c for _, _, c in brute_components(texts, 3, 90))
    assert Counter(r["component_id"] for r in got.collect()) == Counter({(1 if c == 0 else c): n for c, n in want.items()})
    if counted:
        sets = [frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) for w in (WORD.findall(t or "") for t in texts)]
        classes = list(set(sets) - {frozenset()})
        degree = Counter()
        for a, b in itertools.combinations(classes, 2):
            if 100 * len(a & b) >= 90 * len(a | b):
                degree.update((a, b))
        assert Counter(r["n_links"] for r in got.collect()) == Counter(degree[s] for s in sets)


def test_lists_carry_no_bitmaps_and_go_when_read(spark, corpus, monkeypatch):
    """Tables of lists, which outgrow the documents, hold keys only; all but the two that the result reads are deleted."""
    seen, real = [], jaccard_join.table

    def noted(session, df):
        seen.append(real(session, df))
        return seen[-1]

    monkeypatch.setattr(jaccard_join, "table", noted)
    base = [f"v{k}" for k in range(202)]
    hub = [" ".join(f"x{k}-{at}" if at in (k % 66 * 3, (k * 7 + 1) % 67 * 3) else w for at, w in enumerate(base)) for k in range(60)]
    out = jaccard_join.jaccard_join(documents(spark, [*corpus, *hub]), counted=False)
    assert any({"sig", "root"} <= set(t.columns) for t in seen)
    assert sum("bits" in t.columns for t in seen) == 2 and not any("bits" in t.columns for t in seen if "sig" in t.columns)
    large = [t for t in seen if {"early", "home", "lead", "bits"} & set(t.columns) and "shingle" not in t.columns or {"sig", "root"} <= set(t.columns)]
    assert len(large) >= 6 and not any(os.path.exists(t.written_path.removeprefix("file://")) for t in large)
    assert sorted(map(tuple, out.select("doc_id", "n_shingles", "component_id").collect())) == brute_components([*corpus, *hub], 3, 90)


@pytest.mark.parametrize("copies", [1, 3])
def test_substring_stage_leaves_only_its_spans(spark, monkeypatch, copies):
    """What is read is deleted, texts travel once, and windows are made distinct only where rows are repeated."""
    seen, real = [], substring_dedup.table

    def noted(session, df):
        seen.append((real(session, df), df._jdf.queryExecution().optimizedPlan().toString()))
        return seen[-1][0]

    monkeypatch.setattr(substring_dedup, "table", noted)
    monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", 0)
    rng = random.Random(4)
    shared = [f"s{rng.randrange(9_999)}" for _ in range(90)]
    texts = [" ".join([f"a{k}"] * 20 + shared[: 60 + 3 * k] + [f"b{k}"] * 20) for k in range(8)]
    df = documents(spark, texts)
    for _ in range(copies - 1):
        df = df.unionByName(documents(spark, texts[7:], first=7))
    out = substring_dedup.keep_rest(df)
    windows = [plan for t, plan in seen if t.columns == ["f", "doc_id", "th", "lo"]]
    assert len(windows) == 1 and ("Aggregate [f" in windows[0]) == (copies > 1)
    left = [t.columns for t, _ in seen if os.path.exists(t.written_path.removeprefix("file://"))]
    assert {"anchor", "block", "f"}.isdisjoint(c for columns in left for c in columns)
    assert "_row" in (hit := out._jdf.queryExecution().optimizedPlan().toString()) and not re.search(r"Project \[doc_id#\d+L, text#\d+, struct", hit)
    got = {r["doc_id"]: r["text"].split() for r in out.collect()}
    assert out.count() == 7 + copies and got[0] == texts[0].split()
    assert all(got[k] == [f"a{k}"] * 20 + shared[57 + 3 * k : 60 + 3 * k] + [f"b{k}"] * 20 for k in range(1, 8))


def test_recurring_shingles_are_reported(spark):
    """Three times among millions are enough: what is left unreported grows with the corpus and makes lists long."""
    shared = " ".join(f"s{k}" for k in range(20))
    found = jaccard_join.class_pass(documents(spark, [f"a{k} b{k} {shared} c{k}" for k in range(3)]).coalesce(1), 3)
    assert found.where("shingle is not null and c = 3").count() == 18


@pytest.mark.parametrize(("size", "long"), [(3, 5000), (5, 2500)])
def test_long_sets_with_wide_bitmaps(spark, size, long):
    rng = random.Random(1)
    base = [f"v{rng.randrange(10**6)}" for _ in range(long)]
    texts = [" ".join(base[: long - cut]) for cut in (0, 10, 400, 450, 1000, 2000)] + [" ".join(base[k:]) for k in (30, 700, 1500)]
    got = jaccard_join.jaccard_join(documents(spark, texts), size, 90).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == brute_components(texts, size, 90)


def test_keep_one(spark, corpus):
    out = jaccard_join.keep_one(documents(spark, corpus), 5, 80)
    assert out.columns == DOC.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    want = {i for i, n, c in brute_components(corpus, 5, 80) if i == c}
    assert {r["doc_id"] for r in out.collect()} == want


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = dict(map(tuple, common.components(spark, edges).collect()))
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def brute_substring(texts, window):
    words = [WORD.findall(t) if t else [] for t in texts]
    first = {}
    for i, w in enumerate(words):
        for p in range(len(w) - window + 1):
            first.setdefault(tuple(w[p : p + window]), i)
    out = []
    for i, w in enumerate(words):
        gone = set()
        for p in range(len(w) - window + 1):
            if first[tuple(w[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize(("window", "gram", "words", "shard"), [(50, 16, None, None), (8, 3, 0, None), (8, 3, 10**9, 300), (5, 5, 0, None), (5, 5, 10**9, None)])
def test_substring_equals_brute_force(spark, monkeypatch, window, gram, words, shard):
    """By broadcast automata, of one and of many shards, and by hash."""
    if words is not None:
        monkeypatch.setattr(substring_dedup, "REFERENCE_WORDS", words)
    if shard is not None:
        monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard)
    rng = random.Random(window)
    words = [f"w{k}" for k in range(30)] + ["é", "x y"]
    passages = [[rng.choice(words) for _ in range(rng.choice((window, window + 9, 3 * window)))] for _ in range(4)]
    texts = []
    for _ in range(50):
        parts = [[rng.choice(words) for _ in range(rng.randrange(2 * window))]]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            cut = rng.randrange(len(p) // 2)
            parts += [p[cut:], [rng.choice(words) for _ in range(rng.randrange(5))]]
        texts.append(" ".join(itertools.chain(*parts)))
    texts += [None, "", texts[3], texts[3], "a " * (3 * window)]
    got = substring_dedup.substring_dedup(documents(spark, texts).repartition(5), window, gram, with_text=True).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == brute_substring(texts, window)
    for r in got:
        assert hashlib.sha256(" ".join(WORD.findall(r["kept_text"] or "")).encode()).hexdigest() == r["kept_sha256"]


@pytest.mark.parametrize("shard", [10**6, 400])
def test_removal_against_a_reference(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", shard)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["é"]
    reference = [" ".join(rng.choice(words) for _ in range(n)) for n in (5, 30, 80)] + [None, "", "w1 w2"]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + f" {' '.join(reference[2].split()[k : k + 9])} end" for k in range(30)] + [None, "", reference[1], reference[1], "x " * 200]
    have = {tuple(w[i : i + 4]) for r in reference if r for w in [r.split()] for i in range(len(w) - 3)}
    df = documents(spark, texts).withColumn("doc_id", F.when(F.col("doc_id") != 3, F.col("doc_id")))
    got = substring_dedup.remove_against(df, spark.createDataFrame([(r,) for r in reference], "text string"), 4).collect()
    assert len(got) == len(texts)
    want = []
    for i, t in enumerate(texts):
        w = t.split() if t else []
        gone = {q for p in range(len(w) - 3) if tuple(w[p : p + 4]) in have for q in range(p, p + 4)}
        want.append((None if i == 3 else i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == sorted(want, key=str)
    for r in got:
        if r["n_removed"]:
            assert hashlib.sha256(" ".join(r["kept_text"].split()).encode()).hexdigest() == r["kept_sha256"]


def test_documented_functions_exist():
    for module in (jaccard_join, substring_dedup, decontamination):
        assert all(hasattr(module, name) for name in re.findall(r":func:`(\w+)`", module.__doc__))


def test_repeated_rows_do_not_remove_each_other(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = documents(spark, [text]).unionByName(documents(spark, [text]))
    assert [r["n_removed"] for r in substring_dedup.substring_dedup(df, with_text=False).collect()] == [0, 0]
    kept = substring_dedup.keep_rest(documents(spark, [text, text, "short"]))
    assert {(r["doc_id"], r["text"]) for r in kept.collect()} == {(0, text), (2, "short")}
    assert kept.columns == documents(spark, ["x"]).columns


def test_texts_are_cut_by_one_python_node(spark):
    """A second one takes as many workers again, which stay beside the stages after it."""
    passage = " ".join(f"w{k}" for k in range(60))
    texts = [passage, f"a {passage} b", passage, None, "short", ""]
    df = documents(spark, texts).withColumn("_spans", F.lit("x")).withColumn("n_chars", F.lit(-1))
    kept = substring_dedup.keep_rest(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"MapInArrow|ArrowEvalPython|MapInPandas", plan)) == 1
    got = {(r["doc_id"], r["text"], r["n_chars"], r["_spans"]) for r in kept.collect()}
    assert got == {(0, passage, -1, "x"), (1, "a b", 3, "x"), (3, None, -1, "x"), (4, "short", -1, "x"), (5, "", -1, "x")}


def test_waiting_workers_keep_no_tables_of_numbers():
    common.powers(1024), common.multipliers(1024), substring_dedup.prime_powers(1024, *substring_dedup.LongRuns.FIELDS[0])
    common.give_back()
    assert [f.cache_info().currsize for f in (common.powers, common.multipliers, substring_dedup.prime_powers)] == [0, 0, 0]


def items_of(texts):
    return [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) if t else [] for t in texts]


def test_decontamination_equals_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(12)] + ["É", "ß"]
    items = [" ".join(rng.choice(words) for _ in range(n)) for n in (1, 4, 9, 10, 11, 25, 40)] + [None, "--", "W1 w2, w3; w4"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(None, "w1"), (5, items[5])], "item_id long, text string")
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + " " + (rng.choice(items[:7]) if rng.random() < 0.6 else "") for _ in range(60)] + [None, "", "...", (items[6] + "; ").upper() * 2]
    for shard_bytes in (10**6, 60):
        monkeypatch.setattr(decontamination, "SHARD_BYTES", shard_bytes)
        got = decontamination.digest(decontamination.contaminated_spans(documents(spark, texts), bench)).collect()
        docs, tests = items_of(texts), items_of(items)
        for r in got:
            w, hit, found = docs[r["doc_id"]], set(), set()
            for i, t in enumerate(tests):
                k = min(10, len(t))
                grams = {tuple(t[p : p + k]) for p in range(len(t) - k + 1)} if k else set()
                for p in range(len(w) - k + 1):
                    if tuple(w[p : p + k]) in grams:
                        hit.update(range(p, p + k))
                        found.add(str(i))
            want = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want


def test_decontaminated_text(spark):
    item = " ".join(f"q{k}" for k in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = decontamination.keep_clean(documents(spark, [f"Before it, {item}; after it all and more words than that " + "pad " * 20, item, "clean", None]), bench)
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in out.collect()}
    assert set(got) == {0, 2, 3} and got[2] == ("clean", 5) and got[3] == (None, None)
    assert got[0][0].startswith("Before it, ; after it all") and out.columns == documents(spark, ["x"]).columns


def test_automaton_statistics():
    rng = random.Random(2)
    sequences = [[rng.choice(b"abc") for _ in range(n)] for n in (0, 1, 5, 12, 20)]
    a = SuffixAutomaton()
    for s in sequences:
        a.add(bytes([c]) for c in s)
    text = [rng.choice(b"abcd") for _ in range(200)]
    ids = [a.vocabulary.get(bytes([c]), -1) for c in text]
    runs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for i, (_, n) in enumerate(a.statistics(ids)):
        want = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k : i + 1]) in runs))
        assert n == want


def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"aa": "ka lo mi ra tu".split(), "bb": "sch ein ung pf tz".split()}
    def text(lang, n):
        return " ".join("".join(rng.choices(syllables[lang], k=rng.randint(1, 4))) for _ in range(n))
    texts = [text(lang, rng.randint(1, 60)) for lang in ("aa", "bb") for _ in range(40)]
    langs = {i: "aa" if i < 40 else "bb" for i in range(80)}
    model = language_id.learn(documents(spark, texts, langs).select("text", "lang"))
    probe = ["kalomi ratu", "schein ungpf", None, "", "123 ...", "Ωmega ωψχ ξζ Ωψψψψψψψ ψχξζ"]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, probe), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["aa", "bb", "und", "und", "und"]
    assert [got[i]["accepted"] for i in range(6)] == [True, True, False, False, False, False]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[2]["score"] == 0
    # Each context's probabilities add up to 1 over all seen characters, with what is left for unseen ones.
    counts = [(["a", "b"], np.array([3, 1])), (["aa", "ab", "ba"], np.array([2, 2, 1]))]
    kn = language_id.Model(counts)
    assert abs(sum(kn.of(f"a{c}") for c in "ab") + kn.gamma["a"] * kn.gamma[""] * kn.floor - 1) < 1e-9
    empty = language_id.learn(documents(spark, ["x"]).where("false").select("text", "lang"))
    assert [r["lang_pred"] for r in language_id.identify(documents(spark, ["abc"]), empty).collect()] == ["und"]


def brute_bits(texts, probe, order):
    """Bits per character of probe under interpolated Kneser-Ney of texts, by dictionaries and recursion."""
    top = Counter()
    for t in texts:
        for w in t.lower().split():
            s = f" {w} "
            for i in range(1, len(s)):
                top[s[max(0, i - order + 1) : i + 1]] += 1
    levels = {order: {g: c for g, c in top.items() if len(g) == order}}
    current = dict(top)
    for n in range(order - 1, 0, -1):
        lower = Counter(g[1:] for g in current if len(g) == n + 1)
        begun = Counter({g: c for g, c in current.items() if len(g) <= n})
        current = begun + lower
        levels[n] = {g: c for g, c in current.items() if len(g) == n}
    away = {n: language_id.discount(sum(c == 1 for c in x.values()), sum(c == 2 for c in x.values())) for n, x in levels.items()}

    def chance(gram):
        n = len(gram)
        if n == 0:
            return 1.0 / (max(1, len(levels[1])) + 1)
        after = {g: c for g, c in levels[n].items() if g[:-1] == gram[:-1]}
        total = sum(after.values())
        if not total:
            return chance(gram[1:])
        return max(after.get(gram, 0) - away[n], 0) / total + sum(min(c, away[n]) for c in after.values()) / total * chance(gram[1:])

    bits = length = 0
    for w in probe.lower().split():
        s = f" {w} "
        for i in range(1, len(s)):
            bits -= math.log2(chance(s[max(0, i - order + 1) : i + 1]))
            length += 1
    return bits / length


def test_scores_equal_a_brute_force_model(spark):
    rng = random.Random(8)
    learned = {"aa": [" ".join("".join(rng.choices("abcdé", k=rng.randint(1, 5))) for _ in range(20)) for _ in range(3)], "bb": [" ".join("".join(rng.choices("cdefg", k=rng.randint(1, 5))) for _ in range(20)) for _ in range(3)]}
    rows = [(t, lang) for lang, texts in learned.items() for t in texts] + [(None, "aa"), ("x", None)]
    model = language_id.learn(spark.createDataFrame(rows, "text string, lang string"))
    probes = ["abc dé", "gfe cd", "Abba zzz cab", "é", "q" * 300, "cd " * 50, "cd " * 50]
    got = {r["doc_id"]: r for r in language_id.identify(documents(spark, probes), model).collect()}
    for i, probe in enumerate(probes):
        want = {lang: brute_bits(texts, probe, language_id.ORDER) for lang, texts in learned.items()}
        assert abs(got[i]["bits"] - min(want.values())) < 1e-3
        assert got[i]["lang_pred"] == min(want, key=lambda k: (round(want[k], 4), k))


def test_limits_reject_no_more_than_their_share(spark, monkeypatch):
    monkeypatch.setattr(language_id, "SLACK", 0.0)
    rng = random.Random(9)
    texts = [" ".join("".join(rng.choices("abcdefgh", weights=range(1, 9), k=rng.randint(1, 6))) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    df = documents(spark, texts)
    model = language_id.learn(df.select("text", "lang"), slack=0.0)
    assert language_id.identify(df, model).where("not accepted").count() <= math.ceil(len(texts) * language_id.REJECTED)


def test_limits_come_from_every_learning_row(spark):
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choices("abcdefgh", weights=range(1, 9), k=rng.randint(1, 6))) for _ in range(rng.randint(1, 5))) for _ in range(7_000)]
    rows = [(t, lang) for t, lang in zip(texts, ["aa"] * 6_000 + ["bb"] * 1_000, strict=True)] + [(texts[0], "aa")] * 50
    df = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    model = language_id.learn(df, slack=0.0)
    scored = language_id.identify(df.select("text", F.struct("lang", "text").alias("own")), model, carry="own").where("own.lang = lang_pred").select("own.lang", "own.text", "bits").distinct().collect()
    for k, lang in enumerate(model.languages):
        own = [r["bits"] for r in scored if r["lang"] == lang]
        assert model.limits[k] == np.quantile(own, 1 - language_id.REJECTED, method="higher")
    assert sum(r["lang"] == "aa" for r in scored) > 4_000


def test_quantiles_are_of_all_values(spark):
    rng = random.Random(12)
    values = [("aa", rng.choice([rng.random() * 9, 5.0, 5.0 + rng.random() * 1e-9, 5.0 + rng.random() * 1e-14])) for _ in range(3_000)] + [("bb", 3.5)] * 2_000 + [("cc", 0.0)]
    df = spark.createDataFrame(values, "lang string, bits double").groupBy("lang", "bits").agg(F.count(F.lit(1)).alias("c"))
    want = {lang: np.quantile([v for x, v in values if x == lang], 1 - language_id.REJECTED, method="higher") for lang in ("aa", "bb", "cc")}
    assert language_id.quantiles(df) == want and language_id.quantiles(df.where("false")) == {}


def test_gram_cut_off_bounds_the_model(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(50)) for _ in range(10)]
    model = language_id.learn(documents(spark, texts).select("text", "lang"), max_grams=100)
    assert all(len(keys) <= 100 for keys, _ in model.grams)


def test_every_gram_is_kept(spark):
    rng = random.Random(2)
    texts = [" ".join("".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(4)) for _ in range(3000)) for _ in range(20)]
    model = language_id.learn(documents(spark, texts).select("text", "lang"))
    want = {s[i : i + 4] for t in texts for s in (f" {w} " for w in t.split()) for i in range(len(s) - 3)}
    assert len(want) > 1 << 17 and len(model.grams[3][0]) == len(want)


def test_cut_grams_leave_discounts_and_totals_whole(spark):
    texts = ["abab abac abad bbbb abab abab"]
    rows = documents(spark, texts).select("text", "lang")
    whole, discounts = language_id.gram_counts(rows, 2, None)
    cut, again = language_id.gram_counts(rows, 2, 3)
    want = Counter(s[i : i + 2] for w in texts[0].split() for s in [f" {w} "] for i in range(len(s) - 1))
    assert discounts == again and discounts["en", 2] == language_id.discount(list(want.values()).count(1), list(want.values()).count(2))
    totals = {r["gram"]: r["total"] for r in whole.collect() if r["n"] == 2}
    assert totals == {g: sum(c for k, c in want.items() if k[0] == g[0]) for g in want}
    kept = {n: [r for r in cut.collect() if r["n"] == n] for n in (1, 2)}
    assert len(kept[2]) <= 3 and all(r["total"] == totals[r["gram"]] for r in kept[2])
    model = language_id.Model([([r["gram"] for r in kept[n]], [r["c"] for r in kept[n]]) for n in (1, 2)], [again["en", n] for n in (1, 2)], [np.array([r["total"] for r in kept[n]], float) for n in (1, 2)])
    gram = max(kept[2], key=lambda r: r["c"])["gram"]
    mine = [r["gram"] for r in kept[2] if r["gram"][0] == gram[0]]
    taken = sum(max(want[g] - again["en", 2], 0) / totals[g] for g in mine)
    assert abs(model.gamma[gram[0]] - (1 - taken)) < 1e-9


class TinyPieces:
    """A vocabulary small enough to enumerate all segmentations."""

    def __init__(self, weights):
        import ahocorasick

        self.count = len(weights)
        self.names = list(weights)
        self.length = np.array([len(p) for p in self.names], np.int64)
        self.logp = np.log(np.array(list(weights.values())) / sum(weights.values()))
        self.bytes = [p.replace("▁", " ").encode() for p in self.names]
        self.byte_id, self.byte_logp = {}, -20.0
        self.matcher = ahocorasick.Automaton()
        for i, p in enumerate(self.names):
            self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        self.number, self.tied = piece_sampling.bigram_table(self.names)


def segmentations(text, pieces):
    if not text:
        return [()]
    return [(i, *rest) for i, p in enumerate(pieces.names) if text.startswith(p) for rest in segmentations(text[len(p) :], pieces)]


def test_samples_without_replacement_follow_plackett_luce():
    pieces = TinyPieces({"▁": 3, "a": 2, "b": 2, "ab": 3, "▁a": 2, "ba": 1})
    lattice = piece_sampling.Lattice(pieces)
    every = segmentations("▁ab▁ba", pieces)
    weight = {s: math.exp(sum(pieces.logp[i] for i in s)) for s in every}
    total = sum(weight.values())
    p = {s: w / total for s, w in weight.items()}
    n = 4000
    found = piece_sampling.sample_texts(["ab ba"] * n, [piece_sampling.row_seed(i, 3) for i in range(n)], lattice, 2)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    second = Counter(tuple(f[1][0].tolist()) for f in found)
    for s in every:
        expected2 = sum(p[r] * p[s] / (1 - p[r]) for r in every if r != s)
        assert abs(first[s] / n - p[s]) < 4 * math.sqrt(p[s] / n) + 0.003
        assert abs(second[s] / n - expected2) < 4 * math.sqrt(expected2 / n) + 0.003
    for rows in found[:50]:
        assert rows[0][2] >= rows[1][2] and tuple(rows[0][0].tolist()) != tuple(rows[1][0].tolist())
        assert all(abs(math.exp(lp) - p[tuple(ids.tolist())]) < 1e-6 and q <= 0 for ids, lp, _, q in rows)
    all_of_them = piece_sampling.sample_texts(["ab ba"], [1], lattice, 50)[0]
    assert {tuple(r[0].tolist()) for r in all_of_them} == set(every) and all(r[3] == 0 for r in all_of_them)


def test_signs_of_the_vocabulary_round_trip():
    """A text's own U+2581, NUL, a character of no piece, and a very long word."""
    lattice = piece_sampling.lattice_of(piece_sampling.VOCABULARY)
    texts = ["a\u2581b \u2581", "\u2581", " ", "\x00a\x00", "\U0001f9ff x", "\u0e01\u0e02" * 3, "ab" * 20_000, "a b " * 5_000]
    for text, found in zip(texts, piece_sampling.sample_texts(texts, list(range(len(texts))), lattice, 2), strict=True):
        assert found and all(lattice.pieces.decode(ids.tolist()).decode() == text for ids, *_ in found)
        assert len({tuple(ids.tolist()) for ids, *_ in found}) == len(found)


def test_samples_round_trip_under_any_partitioning(spark):
    texts = ["Hello  wörld\n été 日本\x00!", "", None, " x", "a\tb", "▁x a▁b", "word " * 300, "é" * 200]
    df = documents(spark, texts)
    one, two = (sorted(map(tuple, piece_sampling.sample_digest(df.repartition(k)).collect())) for k in (1, 4))
    assert one == two
    assert all(r[-1] is True for r in one if r[1]) and {r[0] for r in one if r[1] == 0} == {2}
    whole = {r["doc_id"]: r["ids"] for r in piece_sampling.sample_digest(df, with_ids=True).collect()}
    assert whole == {r["doc_id"]: None if r["samples"] is None else [x["ids"] for x in r["samples"]] for r in piece_sampling.sample(df).collect()}
    rows = piece_sampling.sample(df).where("samples is not null").select("doc_id", F.explode("samples").alias("s")).select("doc_id", "s.ids")
    assert all(r["text"] == texts[r["doc_id"]] for r in piece_sampling.decode(rows).collect())


def test_sharding_laws(spark):
    texts = [None, "", "é"] + [f"text {k % 7}" for k in range(300)]
    df = documents(spark, texts)
    out = sharding.external_shuffle(df, 16, bucket_bytes=200).collect()
    assert len(out) == len(texts)
    for s in range(16):
        slots = sorted(r["_slot"] for r in out if r["_shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["_grown"] in (r["_shard"], 16) for r in out) and any(r["_grown"] == 16 for r in out)
    assert all(r["_size"] == len((r["text"] or "").encode()) + 1 and r["_crc"] == zlib.crc32((r["text"] or "").encode()) for r in out)
    again = {(r["doc_id"], r["_shard"], r["_slot"]) for r in sharding.external_shuffle(df.repartition(7), 16, bucket_bytes=200).collect()}
    assert again == {(r["doc_id"], r["_shard"], r["_slot"]) for r in out}
    assert sharding.external_shuffle(df.where("false")).count() == 0
    plan = sharding.external_shuffle(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeated_rows_spread_over_buckets(spark):
    """400 equal rows, 300 without doc_id and text, and rows that differ in one other column only."""
    rows = [(7, "same", "a")] * 400 + [(None, None, None)] * 300 + [(8, "t", f"s{k}") for k in range(50)] + [(k, f"t{k}", "x") for k in range(100, 500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed = sharding.numbered(df)
    assert placed.count() == len(rows) and placed.distinct().count() == len(rows)
    out = sharding.external_shuffle(df, 4, bucket_bytes=100).collect()
    assert len(out) == len(rows)
    for s in range(4):
        own = [r for r in out if r["_shard"] == s]
        assert sorted(r["_slot"] for r in own) == list(range(len(own)))
    # A copy group does not lie together: its rows are spread over its whole shard.
    same = sorted(r["_slot"] for r in out if r["doc_id"] == 7)
    shard = [r for r in out if r["_shard"] == next(r["_shard"] for r in out if r["doc_id"] == 7)]
    others = len(shard) - len(same)
    gaps = sum(b - a > 1 for a, b in zip(same, same[1:], strict=False))
    assert others == 0 or gaps >= min(others, len(same)) // 4
    again = sharding.external_shuffle(df.repartition(5), 4, bucket_bytes=100).collect()
    key = lambda r: (str(r["doc_id"]), r["source"] or "", r["_shard"], r["_slot"])
    assert sorted(map(key, again)) == sorted(map(key, out))


def test_offsets_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "GROUP", 3)
    counts = spark.createDataFrame([(s, b, b * 2 + 1) for s in (0, 2) for b in range(20) if b % 4 != 1], "_shard int, _bucket int, _n long")
    got = {(r["_shard"], r["_bucket"]): r["_offset"] for r in sharding.bucket_offsets(counts).collect()}
    assert got == {(s, b): sum(k * 2 + 1 for k in range(b) if k % 4 != 1) for s in (0, 2) for b in range(20) if b % 4 != 1}


def test_shards_are_written(spark, tmp_path):
    df = documents(spark, [f"t{k}" for k in range(40)])
    sharding.write_shards(df, str(tmp_path / "o"), 4)
    back = spark.read.parquet(str(tmp_path / "o"))
    assert back.select("row.*").columns == df.columns
    assert back.count() == 40 and {r["_shard"] for r in back.select("_shard").distinct().collect()} <= {0, 1, 2, 3}


def test_chat_collapse(spark):
    def conv(cid, *turns):
        return [(cid, i, r, t) for i, (r, t) in enumerate(turns)]

    a, b, c = ("user", "hi"), ("assistant", "yo"), ("user", None)
    rows = conv(1, a) + conv(2, a, b) + conv(3, a, b, c) + conv(4, a, b, c) + conv(5, b) + conv(6, a, ("assistant", "")) + conv(7, ("user", "")) + conv(8, c) + [(None, 0, None, "n")]
    got = {r["conv_id"]: (r["n_turns"], r["n_equal"], r["rendered"]) for r in chat_format.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {3, 5, 6, 7, 8, None}
    assert got[3] == (3, 2, "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>user\n<|im_end|>\n")
    plan = chat_format.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_tokenizer_base_measures(spark):
    rng = random.Random(6)
    texts = [None, "", "a b", "é ü ß " * 20, "x y z a b c d e " * 5, "dup line\n dup line\ndup line\n\ndup line", "#*$%&|<> @@ ",
             *(" ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randrange(120))) for _ in range(40))]
    for r in tokenizer_quality.measure(documents(spark, texts)).collect():
        text = texts[r["doc_id"]] or ""
        w = WORD.findall(text)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(repeat) > 30 * len(w)) and not (r["base_failed"] and r["kept"])


def test_fertility_equals_the_public_tokenizers(spark):
    """Whole texts, cut by the tokenizers themselves: a word never shares a token with its neighbour."""
    import sentencepiece
    import tiktoken

    pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_quality.PIECES)
    cutter = tokenizer_quality.Cutter(tokenizer_quality.PIECES, tokenizer_quality.RANKS)
    assert isinstance(cutter.second, tiktoken.Encoding)
    texts = ["The quick brown fox jumps", "Съешь ещё этих мягких булок", "héllo wörld", "a", "日本語 テスト", "\U0001f9ff\U0001f9ff x", "word " * 3000, "w" * 5000, "x y", "x y", None, ""]
    got = {r["doc_id"]: r for r in tokenizer_quality.measure(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").split()
        ids = [k for w in words for k in pieces.encode(w)]
        if not ids:
            assert got[i]["n_tokens"] == 0 and got[i]["chars_per_token"] is None
            continue
        chars = sum(map(len, words))
        share = [c / len(ids) for c in Counter(ids).values()]
        second = sum(len(cutter.second.encode_ordinary(" " + w)) for w in words)
        want = (len(ids), chars / len(ids), sum(map(pieces.is_byte, ids)) / len(ids), -sum(p * math.log2(p) for p in share), chars / second)
        assert np.allclose([got[i][c] for c in ("n_tokens", "chars_per_token", "byte_share", "token_entropy", "chars_per_token_2")], want, atol=1e-9)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_bands_hold_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    fitted = tokenizer_quality.fit_bands(spark.read.parquet(f"{sf}/documents.parquet").join(good, "doc_id", "left_semi"), slack=0.0)
    assert "Latin" in fitted
    for script, band in fitted.items():
        fixed = tokenizer_quality.BANDS[script]
        assert fixed.least_chars <= band.least_chars and fixed.most_chars >= band.most_chars and fixed.most_bytes >= band.most_bytes
        assert fixed.least_entropy <= band.least_entropy and fixed.least_chars_2 <= band.least_chars_2


def test_script_bands(spark):
    plain = "The quick brown fox jumps over the lazy dog while many people watch from the other side of the river and talk about it. "
    noise = " ".join(f"{c}$$$%%%&&&" for c in "abcdefghijklmnopqrstuvwxyz")
    got = {r["doc_id"]: r for r in tokenizer_quality.measure(documents(spark, [plain, noise, "Съешь ещё этих мягких французских булок да выпей же чаю " * 3])).collect()}
    assert got[0]["kept"] and not got[1]["kept"] and got[2]["script"] == "Cyrillic"


def test_entropy_is_judged_in_short_texts(spark):
    rng = random.Random(7)
    words = [rng.choice(("house", "river")) for _ in range(8)]
    while len(words) < 40:
        # No window of 8 words comes twice, so that the base rule sees no repeats.
        seen = {tuple(words[i : i + 8]) for i in range(len(words) - 7)}
        words.append(next(w for w in rng.sample(("house", "river"), 2) if (*words[-7:], w) not in seen))
    junk = " ".join(words)
    got = tokenizer_quality.measure(documents(spark, [junk])).first()
    assert got["n_tokens"] < tokenizer_quality.ENTROPY_TOKENS and not got["base_failed"] and not got["kept"]
    bounds = [tokenizer_quality.entropy_bound(3.5, n) for n in (20, 50, 199, 200, 5000)]
    assert bounds == sorted(bounds) and bounds[-2:] == [3.5, 3.5]


def brute_marginals(model, emissions):
    n, labels = emissions.shape
    weight = {path: math.exp(sum(emissions[i, y] for i, y in enumerate(path)) + sum(model.move[a, b] for a, b in itertools.pairwise(path))) for path in itertools.product(range(labels), repeat=n)}
    z = sum(weight.values())
    return np.array([[sum(w for p, w in weight.items() if p[i] == y) / z for y in range(labels)] for i in range(n)]), max(weight, key=weight.get)


def test_crf_recursions():
    rng = np.random.default_rng(1)
    model = crf.Crf(1, 2)
    model.move = rng.normal(size=(2, 2))
    lengths = np.array([1, 4, 7, 2])
    emissions = rng.normal(size=(14, 2)) * 2
    marginals, _, _ = model.forward_backward(emissions, lengths)
    best = model.viterbi(emissions, lengths)
    starts = np.cumsum(lengths) - lengths
    first = np.zeros(14, bool)
    first[starts] = True
    fast = toxicity.marginals(emissions, first, model.move)
    for s, n in zip(starts, lengths, strict=True):
        want, path = brute_marginals(model, emissions[s : s + n])
        assert np.allclose(marginals[s : s + n], want) and np.allclose(fast[s : s + n], want[:, 1])
        assert tuple(best[s : s + n]) == path
    long = rng.normal(size=(2000, 2))
    head = np.zeros(2000, bool)
    head[0] = True
    assert np.allclose(toxicity.marginals(long, head, model.move), model.forward_backward(long, np.array([2000]))[0][:, 1])


def test_document_scores_equal_brute_force():
    """Marginals of each text on its own, all of them in the noisy-or."""
    rng = np.random.default_rng(5)
    vocabulary = {f"w{k}": k for k in range(1, 9)}
    tagger = toxicity.Tagger(vocabulary, *(rng.normal(size=(9, 2)) for _ in range(3)), rng.normal(size=(toxicity.SHAPES, 2)), rng.normal(size=(2, 2)), 1.3, -0.4)
    texts = [b"w1 w2 W3! ...", None, b"w4", b"", b"unknown w5 w5 w6", b"w1 w2 W3! ..."]
    p, starts = toxicity.Scorer(tagger).marginals(texts)
    scores = tagger.score(toxicity.Scorer(tagger).evidence(p, starts))
    model = crf.Crf(1, 2)
    model.move = tagger.move
    for i, text in enumerate(texts):
        words = (text or b"").split()
        rows = [tagger.row(w) for w in words]
        e = np.zeros((len(words), 2))
        for k, (own, five, six, shape) in enumerate(rows):
            e[k] = tagger.own[own] + tagger.own[five] + tagger.own[six] + tagger.shapes[shape]
            if k:
                e[k] += tagger.before[rows[k - 1][0]]
            if k + 1 < len(rows):
                e[k] += tagger.after[rows[k + 1][0]]
        want = brute_marginals(model, e)[0][:, 1] if words else np.zeros(0)
        assert np.allclose(p[starts[i] : starts[i + 1]], want)
        x = min(max(1 - math.prod(1 - q * q for q in want), 1e-6), 1 - 1e-6)
        assert abs(scores[i] - 1 / (1 + math.exp(-(1.3 * math.log(x / (1 - x)) - 0.4)))) < 1e-6


def test_toxicity(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    texts, toxic = [], []
    for k in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        if k % 6 == 0:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(("scumbag", "Scumbag!", "vermin***")))
        texts.append(" ".join(w))
        toxic.append(int(k % 6 == 0))
    texts += [None, "", "nice"]
    labels = spark.createDataFrame([(i, y, 1) for i, y in enumerate(toxic) if i < 180] + [(None, 1, 1), (3, None, 1)], "doc_id long, toxic int, text int")
    model = toxicity.learn(documents(spark, texts), labels)
    got = {r["doc_id"]: r for r in toxicity.tag(documents(spark, texts), model).collect()}
    assert all(got[i]["predicted"] == y for i, y in enumerate(toxic)) and len(got) == len(texts)
    assert got[240]["score"] == got[241]["score"] < 0.5
    hit = got[0]
    assert all(re.search("(?i)scumbag|vermin", texts[0][s["start"] : s["end"]]) for s in hit["spans"]) and hit["spans"]
    none = toxicity.learn(documents(spark, texts), labels.where("false"))
    assert {r["score"] for r in toxicity.tag(documents(spark, texts), none).collect()} == {0.0}


@pytest.fixture(scope="module")
def extractor():
    return html_extraction.train()


def test_html_blocks(extractor):
    page = (
        '<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a><li><a href="/b">About</a></ul></nav>'
        '<div class="cookie-notice"><p>We use cookies on this site.</p></div><aside class="sidebar"><p>Related things to read.</p></aside>'
        '<article><h1>Title &amp; more</h1><p><b>First   paragraph of the text,\n with a lot to say about it.<br><p>Second &lt;one&gt; is here &amp;amp; done.</p><script>var t="</p>";</script>'
        '<div class="ad"><p>Buy this now, it is cheap.</p></div><ul><li>point one</li><li>point two</li></ul></article>'
        '<section class="comments"><p>I liked this article a lot, thanks.</p></section><form><p>Subscribe to our letter.</p><input></form><footer>&copy; 2020 Site &middot; Some words here.'
    )
    assert extractor.extract([page]) == ["Title & more\nFirst paragraph of the text, with a lot to say about it.\nSecond <one> is here &amp; done.\npoint one\npoint two"]
    assert extractor.extract([None, "", "<html><body></body></html>"]) == ["", "", ""]


@pytest.mark.parametrize("unit", ["<a ", '<a x="', "<div><p>", "<td><li>", "</p>", "<!", '<a x="1>', "<table><b><p>", "<a '>\" ", "<b>x"])
def test_hostile_pages_are_read_in_linear_time(unit):
    begin = time.time()
    html_extraction.leaf_blocks(unit * (1_000_000 // len(unit)), {"t:div": 0})
    assert time.time() - begin < 30


def test_deep_pages_with_many_names(extractor):
    page = "".join(f'<div class="c{k} content">x{k} ' for k in range(5_000))
    begin = time.time()
    extractor.extract([page, None, "", "<", "<p", "a < b", "<p>a<p", '<p title="a>b">c'])
    assert time.time() - begin < 30


#: Pages by hand, in layouts that the generator of training pages does not write; * marks main blocks.
HANDMADE = [
    """<html><body><div class="topbar"><a href="/">Home</a> <a href="/x">News</a></div><table><tr><td class="leftcol"><ul><li><a href="/1">One</a></li><li><a href="/2">Two</a></li></ul></td>
    <td class="maincol"><h1>*The harbour was closed on Monday</h1><p>*Ships waited outside the bay for two days, the port office said.</p><p>*Nobody was hurt, and work went on in the evening.</p></td></tr></table><div class="bottom">Copyright 2020 Harbour News. All rights reserved.</div></body></html>""",
    """<html><body><header><h2>Daily</h2><nav><a href="/a">A</a><a href="/b">B</a></nav></header><main><article><h1>*On bread</h1><p>*Mix flour, water and salt, then wait until the dough has doubled.</p><ol><li>*Knead it for ten minutes.</li><li>*Let it rest under a cloth.</li></ol>
    <blockquote>*Good bread takes its time, as my grandmother used to say.</blockquote></article><section id="comments"><h3>3 comments</h3><p>Great recipe, thank you!</p></section></main><footer><p>Contact us | Privacy | Terms</p></footer></body></html>""",
    """<html><body><div id="cookie-notice">We use cookies. <button>Accept</button></div><div id="page"><div id="content"><h1>*Release 4.2</h1><p>*This version mends the crash at start and reads files twice as fast.</p><pre>*install --now</pre><p>*Thanks to everybody who sent reports in spring.</p></div>
    <div id="sidebar"><h4>Related</h4><ul><li><a href="/r1">Release 4.1</a></li></ul></div></div></body></html>""",
    """<body><div id="wrap"><div id="head"><a href="/">Start</a> <a href="/w">Werke</a></div><div id="txt"><h1>*Über das Wetter</h1><p>*Am Morgen lag Nebel über dem Fluss, und die Fähre fuhr nicht.</p><p>*Gegen Mittag kam die Sonne heraus.</p></div><div id="footer">© 2011 Wetterblatt</div></div></body>""",
    """<body><div class="page"><ul class="menu"><li><a href="/a">About</a></li><li><a href="/c">Contact</a></li></ul><div class="entry"><h2>*A walk by the lake</h2><p>*We left early and met nobody on the path.</p><dl><dt>*Distance</dt><dd>*Eleven miles, most of them flat.</dd></dl></div><div class="comments"><p>I did this walk too, lovely.</p></div></div></body>""",
    """<body><section><h1>*How to mend a bicycle tube</h1><ol><li>*Take the wheel off and the tube out.</li><li>*Find the hole in a bowl of water.</li><li>*Roughen, glue, wait, press the patch on.</li></ol></section><aside><p>See also our <a href="/p">pumps</a>.</p></aside><form><label>Mail</label><input><button>Join</button></form></body>""",
    """<body><div class="ad"><p>Buy two, get one free today!</p></div><article><p>*The council voted for the bridge, by nine to four.</p><div class="ad">Cheap flights to the south.</div><p>*Work begins in spring, if the river allows.</p></article><div class="related"><h3>More</h3><p><a href="/1">Old bridge closes</a></p></div></body>""",
    """<body><center><font size="2"><h1>*My stamps</h1><p>*I began to collect in 1974, with a blue one from Norway.</p><p>*Write to me if you have doubles to trade.</p></font></center><div class="copyright">(c) 1999 me</div></body>""",
]

#: Short pages: (page, main text). Their labels alone leave none.
SHORT = [
    ('<div class="wrap"><h2>Notes</h2><p>Short.</p><p>Another short line.</p><p>Es regnet heute in der Stadt.</p></div>', "Notes\nShort.\nAnother short line.\nEs regnet heute in der Stadt."),
    ("<p>Short.</p>", "Short."),
    ("<body><p>One.</p><p>Two words.</p></body>", "One.\nTwo words."),
    ("<div><p>Hello world</p></div>", "Hello world"),
    ('<div id="nav"><a href="/">Home</a></div><div id="foo"><p>Kurz.</p></div><div id="footer">© 2020 X</div>', "Kurz."),
    ('<div class="cookie">We use cookies.</div><div class="x9"><p>A line.</p></div><form><p>Your mail</p></form>', "A line."),
    ('<nav><a href="/">Home</a></nav><footer>(c) 2020</footer>', ""),
    ('<div class="cookie">We use cookies. Accept?</div>', ""),
    ('<div style="display:none"><p>Not to be seen.</p></div>', ""),
    ('<div><a href="/a">All of this is a link</a></div>', ""),
    ("<script>x</script><style>p{}</style>", ""),
]


@pytest.mark.parametrize(("page", "text"), SHORT)
def test_short_pages_keep_their_text(extractor, page, text):
    assert extractor.extract([page]) == [text]


def test_accuracy_on_pages_by_hand(extractor):
    hit = said = wanted = 0
    for page in HANDMADE:
        gold = {" ".join(m.split()) for m in re.findall(r">\*([^<]+)<", page)}
        got = set(extractor.extract([page.replace(">*", ">")])[0].split("\n")) - {""}
        hit, said, wanted = hit + len(gold & got), said + len(got), wanted + len(gold)
    assert hit / wanted >= 0.9 and hit / said >= 0.85, (hit, said, wanted)


def test_html_held_out_accuracy(extractor):
    good = bad = 0
    for page, main in html_extraction.labelled_pages(80, seed=1234):
        got = set(extractor.extract([page])[0].split("\n"))
        want = {" ".join(x.split()) for x in main}
        good += len(got & want)
        bad += len(got ^ want)
    assert bad < 0.03 * good


def test_empty_tables_and_clashing_columns(spark, extractor):
    empty = documents(spark, ["x"]).where("false")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_join.jaccard_join(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert decontamination.contaminated_spans(empty, bench).count() == 0
    assert decontamination.digest(decontamination.contaminated_spans(documents(spark, ["a b"]), bench)).first()["n_hit"] == 0
    assert piece_sampling.sample_digest(empty).count() == 0
    assert tokenizer_quality.measure(empty).count() == 0
    assert jaccard_join.keep_one(empty).count() == 0 and substring_dedup.keep_rest(empty).count() == 0
    pages = spark.createDataFrame([(1, None, None, 5)], "page_id long, url string, html string, text int")
    assert html_extraction.extract_pages(pages, extractor).first()["text"] == ""
    assert html_extraction.extract_pages(pages.where("false"), extractor).count() == 0
    assert chat_format.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    null_id = documents(spark, ["same text here", "same text here"]).withColumn("doc_id", F.when(F.col("doc_id") > 0, F.col("doc_id")))
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in jaccard_join.jaccard_join(null_id).collect()) == [(0, 1), (1, 1)]
    assert substring_dedup.substring_dedup(null_id).count() == 2 and jaccard_join.keep_one(null_id).count() == 2


def test_very_long_text(spark):
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(150_000))
    df = documents(spark, [long, long + " tail", "short"])
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(df).collect()} == {0: 0, 1: 0, 2: 2}
    assert {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(df, with_text=False).collect()} == {0: 0, 1: 150_000, 2: 0}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    def prose(n):
        return " ".join("".join(rng.choices("an be co de fa gu hi".split(), k=rng.randint(1, 3))) for _ in range(n))
    passage, item = prose(60), prose(20)
    base = prose(200)
    texts = [base, base, base + " more", prose(80) + " " + passage, passage + " " + prose(80), prose(90) + " " + item + " " + prose(30), prose(50), None, "123 456"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.table(spark, stage(spark, docs, str(tmp_path)))
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "piece_sampling":
            assert docs.columns == [x.split()[0] for x in schema.split(", ")]
    assert set(seen["language_id"]) == {0, 1, 2, 3, 4, 5, 6}
    assert set(seen["ngram_jaccard_join"]) == {0, 3, 4, 5, 6}
    assert passage in seen["substring_dedup"][3]["text"] and passage not in seen["substring_dedup"][4]["text"]
    assert item not in seen["benchmark_decontamination"][5]["text"] and seen["benchmark_decontamination"][6]["text"] == texts[6]
    assert set(seen["piece_sampling"]) == {0, 3, 4, 5, 6} and all(r["round_trip"] for r in seen["piece_sampling"].values())
    assert [json.dumps(sorted(x)) for x in (seen["piece_sampling"], {r["doc_id"]: 0 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()})] == [json.dumps([0, 3, 4, 5, 6])] * 2


def thue_morse(n):
    """A word of n letters and its complement: any polynomial modulo 2**64 takes them for one from 1,024 letters on."""
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 4096, 8192])
def test_thue_morse_words_differ(spark, n):
    word, other = thue_morse(n)
    hashes, _ = common.word_hashes([word.encode(), other.encode(), word.upper().encode()], lower=True)
    assert hashes[0] == hashes[2] != hashes[1]
    joined = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_join(documents(spark, [word, other])).collect()}
    assert joined == {0: 0, 1: 1}
    rest = " ".join(f"w{k}" for k in range(49))
    cut = {r["doc_id"]: r["n_removed"] for r in substring_dedup.substring_dedup(documents(spark, [f"{rest} {word}", f"{rest} {other}", f"{rest} {word}"])).collect()}
    assert cut == {0: 0, 1: 0, 2: 50}
    seven = "one two three four five six seven"
    measured = tokenizer_quality.measure(documents(spark, [f"{word} {seven} {other} {seven}", f"{word} {seven} {word} {seven}"])).collect()
    assert {r["doc_id"]: r["n_repeat_words"] for r in measured} == {0: 0, 1: 16}
    sampled = piece_sampling.sample_digest(documents(spark, [word, other])).collect()
    assert all(r["round_trip"] for r in sampled) and sampled[0]["ids_sha256"] != sampled[1]["ids_sha256"]


def test_thue_morse_texts_differ():
    """Runs of words as well: two words in the order of the sequence, and the other way round."""
    a, b = (np.frombuffer(bytes(x, "ascii"), np.uint8) for x in thue_morse(4096))
    names = common.mix(np.arange(256, dtype=np.uint64))
    start, length = np.array([0]), np.array([2048])
    assert substring_dedup.LongRuns(names[a]).runs(start, length) != substring_dedup.LongRuns(names[b]).runs(start, length)
    both = substring_dedup.LongRuns(np.concatenate([names[a], names[a]])).runs(np.array([5, 4101]), np.array([3000, 3000]))
    assert both[0] == both[1]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _size long, _copy string, _slot string, _th string, _spans string, _row string, key string, _shard string, row string, copy int, whole int"


def clashing(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 1, 2, "c", "d", "no number", "e", "f", "g", "h", "i", 3, 4) for k, t in enumerate(texts)], CLASH)


def test_columns_named_as_the_plans_own(spark):
    passage = " ".join(f"word{k}" for k in range(60))
    df = clashing(spark, [passage, f"new {passage} end", "alone", "alone", None])
    out = sharding.external_shuffle(df, 4).collect()
    assert len(out) == 5 and sorted(r["_crc"] for r in out) == sorted(zlib.crc32((r["text"] or "").encode()) for r in out)
    kept = substring_dedup.keep_rest(df)
    assert kept.columns == df.columns and {r["doc_id"]: r["_th"] for r in kept.collect()} == dict.fromkeys(range(5), "no number")
    assert jaccard_join.keep_one(df, size=5, percent=80).columns == df.columns
    benchmark = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    assert decontamination.keep_clean(df, benchmark).columns == df.columns
    assert tokenizer_quality.measure(df).count() == substring_dedup.substring_dedup(df).count() == 5
    assert toxicity.__doc__ and piece_sampling.sample_digest(df).count() == 5


def test_nothing_is_left_in_the_shared_folder(spark):
    from pathlib import Path

    from strandline.session import checkpoint_root, shared_folder

    root = Path(checkpoint_root(spark).removeprefix("file://"))
    common.drop_tables()
    before = set(root.glob("strandline-*"))  # other processes' folders
    sharding.write_shards(documents(spark, ["a", "b"]), shared_folder(spark, "shards"), 2).count()
    common.drop_tables()
    assert set(root.glob("strandline-*")) == before
