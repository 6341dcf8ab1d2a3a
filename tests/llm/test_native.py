import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from oracle import same_rows  # noqa: E402

from gridloom.llm import chat_rotation, decontamination, url_filters  # noqa: E402
from gridloom.llm.chat_rotation import SEGMENT, rotate  # noqa: E402
from gridloom.llm.decontamination import MASKS, TIGHT, TIGHT_MASK, overlaps  # noqa: E402
from gridloom.llm.queries import ORACLES, QUERIES  # noqa: E402
from gridloom.llm.url_filters import rule_table, url_filter  # noqa: E402


@pytest.mark.parametrize("name", ["op1_decontamination", "op2_chat_rotation", "op8_url_filters"])
@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_same_as_sql(spark, name, sf):
    assert same_rows(spark, QUERIES, ORACLES, name, sf)


def test_masks_leave_no_stretch_unhit():
    from itertools import combinations

    for size in range(11, 21):
        masks = MASKS + [TIGHT_MASK] * (size in TIGHT)
        for miss in combinations(range(size), size * 3 // 20):
            assert any(all(o + k not in miss for k, c in enumerate(m) if c == "1") for m in masks for o in range(size - len(m) + 1))


@pytest.fixture(params=["broadcast", "shuffled"])
def way(request, monkeypatch):
    if request.param == "shuffled":
        monkeypatch.setattr(decontamination, "BROADCAST_BYTES", 0)


def test_substitutions(spark, way):
    rng = random.Random(4)
    item = [f"b{k}" for k in range(30)]
    docs, want = [], set()
    for k in range(60):
        w = list(item)
        wrong = rng.sample(range(30), k % 10)
        for j in wrong:
            w[j] = "zz"
        docs.append((k, " ".join([f"p{k}"] * (k % 4)) + " " + ", ".join(w).upper()))
        if any(sum(j in wrong for j in range(s, s + 20)) <= 3 for s in range(11)):
            want.add(k)
    docs += [(100, " ".join(item[:12])), (101, "tiny item here now"), (102, None), (103, ""), (None, " ".join(item))]
    bench = [(7, " ".join(item)), (8, "tiny, item here"), (9, None), (10, "")]
    got = {(r.doc_id, r.item_id) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == {(k, 7) for k in want} | {(101, 8), (None, 7)}


def test_short_items_lose_no_alignment(spark, way):
    """Items of 11 to 20 words with every allowed choice of substitutions, against what alignment by hand says."""
    from itertools import combinations

    docs, bench, want = [], [], set()
    for size in range(11, 21):
        item = [f"s{size}w{k}" for k in range(size)]
        bench.append((size, " ".join(item)))
        allowed = size * 3 // 20
        for wrong in (allowed, allowed + 1):
            for miss in list(combinations(range(size), wrong))[:: 1 if wrong == allowed and size < 20 else 7]:
                words = ["zz" if k in miss else w for k, w in enumerate(item)]
                docs.append((len(docs), " ".join(["pre", *words, "post"])))
                if wrong == allowed:
                    want.add((len(docs) - 1, size))
    got = {(r.doc_id, r.item_id) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()}
    assert got == want


def test_decontamination_empty(spark, way):
    docs, bench = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert overlaps(docs.limit(0), bench).count() == 0 and overlaps(docs, bench.limit(0)).count() == 0 and overlaps(docs, bench).count() == 1


def test_long_repeated_and_odd_documents(spark, way):
    """Very long texts, repeated words, repeated rows and clashing columns."""
    item = [f"q{k}" for k in range(25)]
    filler = " ".join(f"f{k % 9973}" for k in range(150_000))
    docs = [(1, f"{filler} {' '.join(item)} {filler}", "x"), (1, filler, "x"), (2, "la " * 30_000, "y"), (3, filler, None), (4, " ".join(item[:20]), "z")]
    bench = [(7, " ".join(item), 1), (8, "la " * 15, 2)]
    got = {tuple(r) for r in overlaps(spark.createDataFrame(docs, "doc_id long, text string, item string"), spark.createDataFrame(bench, "item_id long, text string, key int")).collect()}
    assert got == {(1, 7, 20, 20, 150_000), (4, 7, 20, 20, 0), (2, 8, 15, 15, 0)}


def test_whole_tables_by_the_shuffled_way(spark, way):
    from gridloom.llm.tables import table

    d = "/root/testdata/sf0.001"
    same_rows(spark, {"op1": lambda s, d: overlaps(table(s, d, "documents"), table(s, d, "benchmark"))}, {"op1": ORACLES["op1_decontamination"]}, "op1")
    assert d


def rotated(spark, rows):
    """What the SQL gives, and what the operator gives, as sorted rows."""
    import duckdb

    got = sorted([tuple(r) for r in rotate(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()], key=repr)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn INT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = sorted(con.execute(chat_rotation.SQL).fetchall(), key=repr)
    return got, want


def test_rotation(spark):
    rows = [(1, 0, "ann", "hi", 0), (1, 1, "bob", "yo", 0), (1, 2, "system", "be nice", 0), (1, 70, None, None, 0), (None, None, "ann", "x", 0)]
    odd = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, speaker int")
    got = {(r.conv_id, r.speaker): r for r in rotate(odd).collect()}
    r = got[(1, "bob")]
    assert r.text == "<|im_start|>user name=ann\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n<|im_start|>system\nbe nice<|im_end|>\n<|im_start|>user name=unknown\n<|im_end|>\n"
    assert [r.text[a:b] for a, b in [map(int, s.split("-")) for s in r.masks.split(",")]] == ["yo<|im_end|>\n"] and r.n_target == len("yo<|im_end|>\n")
    assert set(got) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")} and all(r.segment == r.offset == 0 for r in got.values())
    assert rotate(odd.limit(0)).count() == 0


def test_rotation_of_long_dialogues(spark):
    """5,000 messages of one conversation with turns of their own, and 6,000 with few turn numbers, null ones and null ids: as the SQL says."""
    rng = random.Random(6)
    rows = [(7, k, rng.choice(["ann", "bob", "cy"]), f"m{k}" * rng.randrange(3)) for k in range(5000)]
    rows += [(1, rng.choice([None, 0, 1, 2]), rng.choice(["ann", "bob", None, "system"]), f"m{rng.randrange(2000)}") for _ in range(6000)]
    rows += [(None, None, "ann", f"n{k}") for k in range(2500)] + [(2, 0, "bob", "y"), (2, 1, "ann", None), (3, 0, "eve", "z " * 200_000)]
    rng.shuffle(rows)
    got, want = rotated(spark, rows)
    assert got == want
    whole = {}
    for conv, who, segment, offset, n, _, text, masks in sorted(got, key=repr):
        assert n <= SEGMENT and offset == len(whole.get((conv, who), "")) and segment == len(whole.get((conv, who), "")) // max(1, offset) * segment
        whole[conv, who] = whole.get((conv, who), "") + text
        for a, b in (map(int, s.split("-")) for s in masks.split(",") if s):
            assert whole[conv, who][:a].endswith("<|im_start|>assistant\n") and whole[conv, who][b - 11 : b] == "<|im_end|>\n"
    assert whole[7, "ann"].count("assistant\n") == sum(r[0] == 7 and r[2] == "ann" for r in rows)


@pytest.fixture(params=["columns", "rows", "shuffled"])
def join(request, monkeypatch):
    if request.param != "columns":
        monkeypatch.setattr(url_filters, "MOST_KINDS", 0)
    if request.param == "shuffled":
        monkeypatch.setattr(url_filters, "BROADCAST_RULES", 0)


def test_url_query_each_way(spark, join):
    same_rows(spark, QUERIES, ORACLES, "op8_url_filters")


def test_url_rules(spark, join):
    rules = rule_table(spark, [("com/a", "block"), ("x.com/a", "allow"), ("x.com", "block"), ("com", "allow"), ("x.com/a", "block")])
    urls = [(1, "http://Y.x.COM/ab?q"), (1, "http://Y.x.COM/ab?q"), (2, None), (3, "no url"), (None, "ftp://com#z"), (4, "a://b://c/d"), (5, "://x.com"), (6, "http://notx.com/a"), (7, "http://" + "a." * 3000 + "x.com/" + "p" * 5000)]
    got = sorted([(r.page_id, r.rule, r.verdict) for r in url_filter(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()], key=str)
    assert got == sorted([(1, "x.com/a", "block"), (1, "x.com/a", "block"), (2, None, "allow"), (3, None, "allow"), (None, "com", "allow"), (4, None, "allow"), (5, "x.com", "block"), (6, "com/a", "block"), (7, "x.com", "block")], key=str)
    odd = spark.createDataFrame([(*u, "h", "r", None) for u in urls], "page_id long, url string, host string, rule string, best int")
    assert sorted([(r.page_id, r.rule, r.verdict) for r in url_filter(odd, rules).collect()], key=str) == got and url_filter(odd.limit(0), rules).count() == 0
    assert url_filter(spark.createDataFrame(urls, "page_id long, url string"), rules.limit(0)).filter("verdict = 'allow' and rule is null").count() == len(urls)
