"""The llm operators against brute force, libraries and held-out labels, with their edge cases."""

import datetime as dt
import itertools
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pointloom.llm import language, leakage, queries, runs, splits, tokens
from tests.compare import assert_same, connect

PATH = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    assert_same(queries.queries()[name](spark, PATH), connect(PATH), queries.oracle_sql()[name])


# ---- runs ---------------------------------------------------------------------------------------------------------


def run_cost(weights, states, path, penalty):
    return sum(w * runs.APART[s][p] for w, s, p in zip(weights, states, path)) / 100 + penalty * sum(a != b for a, b in zip(path, path[1:]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 4), st.integers(0, 5)), min_size=1, max_size=5), st.sampled_from([0.25, 1.0, 2.5, 6.0]))
def test_segment_is_optimal(rows, penalty):
    w, s = [r[0] for r in rows], [r[1] for r in rows]
    got = runs.segment(w, s, penalty)
    best = min(run_cost(w, s, path, penalty) for path in itertools.product(range(6), repeat=len(s)))
    assert abs(run_cost(w, s, got, penalty) - best) < 1e-9
    if penalty < 0.5 and all(a != b for a, b in zip(s, s[1:])):
        assert got == s


def test_likeness_of_states_decides(spark):
    """A flicker joins its run, and between two runs a record goes to the one whose word is nearer: not what counting equal
    neighbours gives."""
    assert runs.APART[3][4] < runs.APART[3][0] < 200 and all(runs.APART[k][k] == 0 for k in range(6))
    states = [4] * 6 + [3] + [0] * 6 + [2] + [0] * 3 + [1] * 9
    df = spark.createDataFrame([("s", "t", k, v, k * 0.1) for k, v in enumerate(states)], RECORD)
    got = sorted((r["start_frame"], r["end_frame"], r["state"], r["frames"], r["same_frames"]) for r in runs.collapse_runs(df, 2.0).collect())
    assert got == [(0, 6, "sitting", 7, 6), (7, 16, "upright", 10, 9), (17, 25, "descending", 9, 9)]
    assert runs.collapse_runs(df, runs.EXACT).count() == 6


RECORD = "session_id string, track_id string, frame_index int, state int, stamp_sec double"


@pytest.mark.parametrize("penalty", [0.25, 1.0, 2.5])
def test_blocks_give_the_uncut_segmentation(spark, penalty):
    rng = random.Random(3)
    rows = []
    for track in "ab":
        t, s = 0.0, 0
        for k in range(300):
            t += 0.1 if rng.random() < 0.97 else 2.0
            s = s if rng.random() < 0.8 else rng.randint(0, 3)
            rows.append(("s", track, k * (1 + k % 2), -1 if rng.random() < 0.03 else s, t))
    df = spark.createDataFrame(list({r[:3]: r for r in rows}.values()), RECORD)
    key = ["track_id", "start_frame", "end_frame", "state", "frames", "same_frames"]
    get = lambda b: runs.collapse_runs(df, penalty, block=b).select(*key).toPandas().sort_values(key[:2]).values.tolist()
    whole, cut = get(10**6), get(16)
    assert sum(r[4] for r in whole) == df.filter("state >= 0").count()
    assert whole == cut
    assert penalty < 0.5 or any(r[4] > r[5] for r in whole)


def test_run_states_and_deliveries(spark):
    t = lambda h: dt.datetime(2026, 1, 1, h)
    rows = [
        (1, "s", "t", 1, 1.0, "LYING", t(1)), (2, "s", "t", 2, 1.3, " ly-ing\n", t(1)), (3, "s", "t", 4, 1.8, "ｌying", t(1)), (4, "s", "t", 5, 1.8, "lyng", t(1)), (5, "s", "t", 6, 2.0, "lying", t(1)),
        (6, "s", "t", 7, 2.1, "upright", t(1)), (7, "s", "t", 7, 2.1, "lying", t(2)), (8, "s", "t", 7, 2.1, "sitting", None), (9, "s", "t", 8, 2.2, None, t(1)), (10, "s", "t", 9, 2.3, "lying", t(1)), (11, "s", None, 3, 1.0, "lying", t(1)),
        (12, "s", "t", None, 1.0, "lying", t(1)), (13, "s", "u", 1, None, "upright", t(1)), (14, "s", "u", 2, 1.0, "upright", t(1)), (15, None, "u", 2, 1.0, "?", t(1)),
    ]
    cols = "record_id long, session_id string, track_id string, frame_index int, stamp_sec double, state string, recv_ts timestamp, frames int, n int"
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], cols)
    got = sorted((r["track_id"], r["state"], r["start_frame"], r["end_frame"], r["frames"], round(r["duration_sec"] or 0, 3)) for r in runs.posture_runs(df, runs.EXACT).collect())
    assert [g[:5] for g in got] == [("t", "lying", 1, 4, 3), ("t", "lying", 5, 7, 3), ("t", "lying", 9, 9, 1), ("u", "upright", 1, 1, 1), ("u", "upright", 2, 2, 1)] and got[0][5] == 0.8
    assert runs.posture_runs(spark.createDataFrame([], cols)).count() == 0


def test_hot_track_is_split(spark):
    df = spark.range(300_000).selectExpr("'s' as session_id", "'t' as track_id", "cast(id as int) as frame_index", "cast((id div 1000) % 6 as int) as state", "id * 0.1 as stamp_sec")
    got = runs.collapse_runs(df)
    assert got.count() == 300 and got.agg(F.min("frames"), F.max("frames")).first() == (1000, 1000)


# ---- splits -------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_hash_to_min(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 60):03d}", f"n{rng.randint(0, 60):03d}") for _ in range(45)] + [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(40)] + [(None, "x")]
    label = {n: n for e in edges if e[0] for n in e}
    for _ in label:
        for a, b in edges:
            if a:
                label[a] = label[b] = min(label[a], label[b])
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == label


CATALOG = "sid string, subject string, author string, source_bag_sha256 string, frame_count int, component string"


def test_names_and_splits(spark):
    sha = "AB" * 32
    rows = [
        ("s1", "S0000398", None, None, 10, "x"), ("s2", "subj:s000-0398", "fobir‑000514", None, 10, "x"), ("s3", "TBD", " Fobir 000514 ", "sha256:" + sha.lower(), None, "x"), ("s4", "?", "@fobir_000999", "SHA256=" + sha, 10, "x"),
        ("s5", "n.a.", "not recorded", "sha256:", 10, "x"), ("s6", "N/A", "not recorded", "0" * 64, 10, "x"), ("s6", None, None, None, None, "x"), (None, "S0000398", None, None, 1, "x"),
    ]
    c = spark.createDataFrame(rows, CATALOG)
    assert {tuple(r) for r in splits.session_components(c).collect()} == {("s1", "s1"), ("s2", "s1"), ("s3", "s1"), ("s4", "s1"), ("s5", "s5"), ("s6", "s6")}
    own = {tuple(r) for r in splits.session_components(c, nobody=["", "tbd", "na"]).collect()}
    assert ("s6", "s5") in own  # "not recorded" is a name where the list doesn't have it
    meta = spark.createDataFrame([("s1", k % 5, "r") for k in range(20)], "session_id string, frame_index int, recv string")
    t = spark.createDataFrame([("train", 0.8), ("test", 0.2), (None, 0.5)], "split_name string, split_share double")
    got = {r["sid"]: r for r in splits.session_splits(c, meta, t).collect()}
    assert got["s1"]["frames"] == 5 and got["s3"]["frames"] == 0 and len({got[s]["split_name"] for s in ("s1", "s2", "s3", "s4")}) == 1
    assert splits.session_splits(spark.createDataFrame([], CATALOG), meta, t).count() == 0


def test_split_shares_of_the_tables(spark):
    got = queries.p2_splits(spark, PATH).cache()
    total = got.agg(F.sum("frames")).first()[0]
    want = {r[0]: r[1] for r in spark.read.parquet(f"{PATH}/split_targets.parquet").select("split_name", "split_share").collect()}
    have = {r[0]: r[1] / total for r in got.groupBy("split_name").agg(F.sum("frames")).collect()}
    assert max(abs(have.get(n, 0) - w / sum(want.values())) for n, w in want.items()) < 0.1
    assert got.groupBy("component").agg(F.count_distinct("split_name").alias("n")).filter("n > 1").count() == 0


def test_split_shares(spark):
    s = spark.range(30_000).selectExpr("cast(id as string) as sid", "case when id < 9000 then 'hot' else cast(id div 3 as string) end as component", "id % 100 as frames")
    t = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, split_share double")
    got = splits.assign_splits(s, t)
    total = got.agg(F.sum("frames")).first()[0]
    for name, share in (("train", 0.8), ("validation", 0.1), ("test", 0.1)):
        part = got.filter(F.col("split_name") == name).agg(F.sum("frames")).first()[0] / total
        assert abs(part - share) < 0.02
    assert got.groupBy("component").agg(F.count_distinct("split_name").alias("n")).filter("n > 1").count() == 0


# ---- tokens -------------------------------------------------------------------------------------------------------


def library():
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokens.load_ranks(), special_tokens={})


ODD = ["", None, " ", "\t\n  x", "a" * 3000, "ab" * 700 + "中" * 400, "it's we'LL \r\n\r\n  end  ", " x\x85y z　", "<|endoftext|> ﷽ 𝛼𝛽 👍🏽", "½ ⅔ №12 ١٢٣", "\x00\x07 \x1c", "é naïve", "  \n \n", "한국어 문장", "x﻿​"]


def test_encode_matches_the_library_and_decodes(spark):
    enc = library()
    rng = random.Random(1)
    pool = "ab c'\n\t é中🙂1٣_ ſK"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["it's"] * 3
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, ids int, word int")
    got = tokens.encode_texts(spark, df)
    rows = {r["doc_id"]: list(r["ids"]) for r in got.collect()}
    assert len(rows) == len(texts)
    bad = [(t, rows[k]) for k, t in enumerate(texts) if rows[k] != enc.encode_ordinary(t or "")]
    assert not bad, bad[:2]
    back = {r["doc_id"]: r["text"] for r in tokens.decode_ids(got).collect()}
    assert all(back[k] == (t or "") for k, t in enumerate(texts))
    assert tokens.encode_texts(spark, df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_heap_merge(word):
    ranks = test_heap_merge.ranks = getattr(test_heap_merge, "ranks", None) or tokens.load_ranks()
    enc = test_heap_merge.enc = getattr(test_heap_merge, "enc", None) or library()
    assert tokens.merge_word(word.encode(), ranks) == (enc._core_bpe.encode_single_piece(word.encode()) if word else [])


def test_cached_folded_and_long_words_give_the_same(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    of = lambda **k: {r["doc_id"]: list(r["ids"]) for r in tokens.encode_texts(spark, df, **k).collect()}
    one, enc = of(), library()
    assert all(one[r["doc_id"]] == enc.encode_ordinary(r["text"] or "") for r in df.select("doc_id", "text").collect())
    assert of(cache_words=0) == one and of(cache_words=300) == one and of(fold_bytes=12) == one


def test_ids_need_no_shuffle_of_texts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = tokens.encode_texts(spark, df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


# ---- leakage ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(4))
def test_matches_are_the_longest(seed):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(8)]
    items = leakage.Items([(k, " ".join(rng.choices(vocab, k=12))) for k in range(4)] + [(9, None), (10, " ")])
    docs = [rng.choices([*vocab, "zz"], k=60) for _ in range(5)]
    many = leakage.SLICE
    try:
        leakage.SLICE = [many, 7][seed % 2]
        rows = list(zip(*[x.tolist() for x in leakage.matches(items, docs, 3)]))
    finally:
        leakage.SLICE = many
    got = set(rows)
    assert len(rows) == len(got)
    want = set()
    for i, item in enumerate(items.texts):
        for d, doc in enumerate(docs):
            for q, p in itertools.product(range(len(item)), range(len(doc))):
                if item[q] == doc[p] and not (q and p and item[q - 1] == doc[p - 1]):
                    n = 0
                    while q + n < len(item) and p + n < len(doc) and item[q + n] == doc[p + n]:
                        n += 1
                    if n >= 3:
                        want.add((d, i, p, q, n))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_suffix_array(seed):
    rng = np.random.RandomState(seed)
    words = np.append(rng.randint(0, 4, 300), [0]).astype("int32")
    words[200:240] = words[100:140]
    live = np.flatnonzero(words)
    tail = lambda p: words[p : p + int(np.argmin(words[p:]))].tolist()[:25]
    order, lcp = leakage.suffix_array(words, live, 25)
    assert sorted(order.tolist()) == live.tolist() and [tail(p) for p in order] == sorted(tail(p) for p in live)
    for i in range(1, len(order)):
        a, b = tail(order[i - 1]), tail(order[i])
        assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def test_stock_phrase_in_all_items_and_documents():
    """Places times suffixes are met in slices: memory stays linear, and nothing is lost."""
    rng = random.Random(4)
    stock = "all of the notes in this folder were read out before the hall closed".split()
    own = [[f"i{k}w{j}" for j in range(30)] for k in range(300)]
    items = leakage.Items([(k, " ".join(stock + w)) for k, w in enumerate(own)])
    docs = [stock + [f"d{k}"] + stock + (own[k] if k < 300 else []) + [rng.choice(stock) for _ in range(5)] for k in range(1500)]
    tracemalloc.start()
    d, i, p, q, n = leakage.matches(items, docs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {(a, b) for a, b, c in zip(d.tolist(), i.tolist(), n.tolist()) if c > 20} == {(k, k) for k in range(300)}
    assert len(d) == len({*zip(d.tolist(), i.tolist(), p.tolist(), q.tolist())}) >= 2 * 300 * 1500 and peak < 400_000_000


def test_shards_by_characters(spark):
    text = "the long evaluation passage about nine grey herons standing near the old mill was read aloud twice"
    rows = [(k, ("filler " * (k % 7) + text + " end") if k % 3 == 0 else "nothing of that kind here at all, really not") for k in range(60)]
    df, items = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), spark.createDataFrame([(1, text)], "item_id long, text string")
    old = leakage.SHARD_CHARS
    try:
        for size in (1, 300, 5_000, old):
            leakage.SHARD_CHARS = size
            assert {r["doc_id"] for r in leakage.leaked_items(spark, df, items).collect()} == set(range(0, 60, 3))
    finally:
        leakage.SHARD_CHARS = old
    leakage.MAX_ITEM_CHARS, kept = 10, leakage.MAX_ITEM_CHARS
    try:
        with pytest.raises(ValueError):
            leakage.leaked_items(spark, df, items)
    finally:
        leakage.MAX_ITEM_CHARS = kept


def test_leaks(spark):
    item = "The ceiling sweep above the radiator produced 341 padded islands next to the rusty shower stall. Probe box 118 swallowed every echo behind the cushion, so the stewards restarted the tally from 7.50 today."
    zh = "工作室里编排好的倒地从第45秒开始，处于手推车最远的边缘，不过被子附近的格子仍然相连，尽管有462个倾斜的邻点。"
    first, second = item.split(". ", 1)
    words = item.split()
    docs = {
        1: "Intro. " + item + " End.", 2: "> " + item.upper().replace(".", "").replace(",", "") + "\n", 3: second + " other text in between goes here and on " + first, 4: first, 5: "above the radiator produced nothing. behind the cushion lay a hat.",
        6: " ".join(w if k % 11 else "altered" for k, w in enumerate(words)), 7: "\n> ".join(" ".join(words[k : k + 5]) for k in range(0, len(words), 5)), 8: None, 9: "", 10: "   ", 11: " ".join(zh), 12: zh[:10], 13: "x " * 20000 + item, 14: item.replace("e", "é"), 15: item,
    }
    df = spark.createDataFrame([(k, t, 5) for k, t in docs.items()] + [(1, docs[1], 5)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(70, item), (71, item + "!"), (72, zh), (73, None), (74, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaked_items(spark, df, items).collect()}
    assert got == {(d, i) for d in (1, 2, 3, 6, 7, 13, 14, 15) for i in (70, 71)} | {(11, 72)}
    assert {r["doc_id"] for r in leakage.clean_documents(spark, df, items).collect()} == {4, 5, 8, 9, 10, 12}
    assert leakage.leaked_items(spark, df.limit(0), items).count() == 0 and leakage.leaked_items(spark, df, items.limit(0)).count() == 0


# ---- language -----------------------------------------------------------------------------------------------------


def test_automaton_and_phrases():
    rng = random.Random(2)
    text = "".join(rng.choice("abc ") for _ in range(200))
    a = language.Automaton(text)

    def greedy(s):
        i = n = 0
        while i < len(s):
            k = 1
            while i + k <= len(s) and s[i : i + k] in text:
                k += 1
            i += max(1, k - 1)
            n += 1
        return n

    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    for s in texts:
        assert a.phrases(s) == greedy(s)
    # the packed table steps many texts through all automata at once, long ones too
    other = "".join(rng.choice("bcde ") for _ in range(150))
    both, one, two = language.Languages({"aa": text, "bb": other}), a, language.Automaton(other)
    texts += ["".join(rng.choice("abcdef ") for _ in range(3000)), "", "xyz", "a"]
    got = both.phrase_counts(texts)
    for s, row in zip(texts, got):
        want = [x.phrases(s) for x in (one, two)]
        assert all(g == w or np.isinf(g) for g, w in zip(row, want)), s
    assert np.isfinite(got).any(1).tolist() == [bool(set(s) & set("abcde")) for s in texts]


@pytest.mark.parametrize(
    "label,code",
    [("en-US", "en"), ("zh-Hans", "zh"), ("中文", "zh"), ("français", "fr"), ("Deutsch", "de"), (" PT_br ", "pt"), ("jpn", "ja"), ("und", None), ("zxx", None), ("", None), (None, None), ("??", None), ("N/A", None), ("auto", None), ("null", None), ("unknown", None), ("nl", "nl"), ("sw", "sw"), ("Swahili", "sw"), ("afr", "af"), ("Cymraeg", "cy"), ("Galician", "gl"), ("德语", "de"), ("allemand", "de"), ("iw", "he"), ("none", None)],
)
def test_labels(spark, label, code):
    assert language.language_code(label, language.language_names(spark)) == code


def test_sentences():
    s = lambda t: [x[2] for x in language.sentences(t)]
    assert s("# A heading of four words.\nThe box moved by 3.5 metres today. OK.\n[12] trk_01 2.1/3\nf=1 trk_2 h=0.2m n=3\n\nLast one is here now!") == ["The box moved by 3.5 metres today.", "Last one is here now!"]
    assert s("> The long line goes\n> on in the next one.\n\nshort phrase") == ["The long line goes on in the next one."]
    assert s("Il ne faut pas comparer les chiffres.\u200b We counted nine points again.") == ["Il ne faut pas comparer les chiffres.", "\u200b We counted nine points again."]
    assert s("高度门限拒绝了候选。好。") == ["高度门限拒绝了候选。"] and s(None) == s("") == s("  \n ") == []
    for a, b, t in language.sentences("One two three four. Five six seven eight!"):
        assert "One two three four. Five six seven eight!"[a:b].strip() == t


def test_languages_on_held_out_documents(spark):
    """Fitted on one half of the labelled documents, judged on the other half's plain cases."""
    docs = spark.read.parquet(f"{PATH}/documents.parquet").filter("text is not null")
    lang = language.fit_languages(docs.filter("doc_id % 2 = 0"))
    assert {"en", "zh"} <= set(lang.codes) and all(len(c) == 2 for c in lang.codes)
    rows = docs.filter("doc_id % 2 = 1 and lang in ('en', 'zh', 'de', 'fr', 'es', 'ja', 'pt')").select("lang", "text").collect()
    at, _, _, found, _ = lang.read([r["text"] for r in rows])
    single = [(r["lang"], {lang.codes[c] for c in found[at == k]}) for k, r in enumerate(rows)]
    single = [(a, b) for a, b in single if len(b) == 1]
    assert len(single) > 100 and np.mean([b == {a} for a, b in single]) > 0.85  # labels themselves are wrong at times


def test_document_languages_edges(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    lang = language.fit_languages(docs)
    en, zh = "The new bracket sits lower than the old one. Nobody could explain the jump at the window.", "高度门限拒绝了很多候选。没有人看过视频之前这个结果只能算未知。"
    rows = [(1, en, "en"), (2, en, None), (3, en, "de"), (4, en + " " + zh, "en"), (5, zh, "zh-CN"), (6, None, None), (7, "", "en"), (8, " \n", None), (9, "f=1 trk_2 h=0.2m n=3", "xx"), (10, zh, "und")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, lang string, sentences int")
    got = {(r["doc_id"], r["lang_code"]) for r in language.document_languages(spark, df, lang).filter("is_case").collect()}
    assert got == {(2, "en"), (3, "en"), (4, "en"), (4, "zh"), (10, "zh")}
    seg = [(r["segment"], r["lang_code"], r["sentences"]) for r in language.language_segments(spark, df, lang).filter("doc_id = 4").orderBy("segment").collect()]
    assert seg == [(0, "en", 2), (1, "zh", 2)]
    assert language.document_languages(spark, df.limit(0), lang).count() == 0
    assert language.document_languages(spark, df, language.Languages({})).count() == 0
