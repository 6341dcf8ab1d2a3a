import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gridloom.llm.queries import QUERIES
from gridloom.llm.tables import new_folder
from gridloom.llm.token_store import LEAST, MOST, Words, crc_join, cuts, digest, ids_of, merkle, pack, read_store, store_root, unpack, verify_store, write_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


def want(rows, end=2):
    """doc_id -> expected digest row, by the library itself."""
    lib, start, out = Tokenizer.from_file(PATH), 0, []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [end]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    return out


def test_cuts_move_with_content():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 50_000, 60_000).astype("<u4")
    c = cuts(ids)
    sizes = np.diff([0, *c])
    assert c[-1] == len(ids) and sizes[:-1].min() >= LEAST and sizes.max() <= MOST and 800 < sizes.mean() < 2500
    shifted = cuts(np.concatenate([ids[:37], ids]))
    assert len({x + 37 for x in c} & set(shifted)) > 0.8 * len(c)
    assert cuts(ids[:0]) == [] and cuts(ids[:5]) == [5]
    big = np.concatenate([ids, ids, ids])
    assert len({x + 60_000 for x in c[2:-1]} & set(cuts(big))) > 0.8 * len(c)


def test_parts():
    ids = np.array([1, 2, 70_000], dtype="<u4")
    assert (unpack(pack(ids)) == ids).all() and (unpack(pack(ids[:2])) == ids[:2]).all()
    a, b = b"hello", b"x" * 1000
    assert crc_join(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]))[0] == zlib.crc32(a + b)
    x, y, z = digest(b"a"), digest(b"b"), digest(b"c")
    assert merkle([x, y, z]) == digest(b"\1" + digest(b"\1" + x + y) + z) and merkle([x]) == x
    texts = ["a<|endoftext|>b  c", "", "Thntblere of\n\nthen"]
    lib = Tokenizer.from_file(PATH)
    assert [np.frombuffer(r, "<u4").tolist() for r in ids_of(texts, PATH)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_ids_of_odd_strings():
    """Against the library on texts of odd characters, spaces, marks and special strings."""
    rng = random.Random(4)
    alphabet = [*"abcxyzABÉéßжд中文かな١٢३🙂é'.,;:!?-_#*0123456789", "\u0301", "\u200d", " ", " ", " ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "\r", "  ", "\n\n", " \n", "<|endoftext|>", "'s", "n't ", "word", "Word. ", "and, "]
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(20_000)]
    texts += [" ".join(rng.choices(["the", "cat.", "sat,", "don't", "x1", "naïve.", "É,", "\nnew", "a.b", "..."], k=rng.randrange(1, 12))) for _ in range(12_000)]
    lib = Tokenizer.from_file(PATH)
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(r, "<u4").tolist() for r in ids_of(texts, PATH)] == want


def test_words_memo_turns_over():
    asked = []
    memo = Words(lambda t: asked.append(t) or t.encode(), " ", most=5)
    for k in range(40):
        assert memo["often"] == b" often" and memo[f"w{k}."] == f" w{k}.".encode()
    assert asked.count(" often") == 1


def test_marks_are_asked_once():
    asked = []
    memo = Words(lambda t: asked.append(t) or t.encode(), " ", most=5)
    for k in range(40):
        assert memo[f"w{k * 'x'}."] == f" w{k * 'x'}.".encode() and memo[f"v{k * 'x'},"] == f" v{k * 'x'},".encode()
    assert asked.count(".") == 1 and asked.count(",") == 1 and memo["."] == b" ."


@pytest.mark.parametrize("sf", ["0.001"])
def test_documents(spark, sf):
    d = f"/root/testdata/sf{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in QUERIES["op5_token_store"](spark, d).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want(rows)


def test_round_trip_and_tampering(spark):
    long = " ".join(f"word{k % 977} {k}" for k in range(6000))
    rows = [(3, long), (3, long), (1, None), (None, "x"), (2, long + " more"), (9, "")]
    path = new_folder(spark, "store")
    write_store(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int"), path, PATH, end_id=2)
    got = sorted([(r.doc_id, r.start, r.n, zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())) for r in read_store(spark, path).collect()], key=lambda r: r[1])
    assert got == want(rows)
    assert sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in verify_store(spark, path).collect()], key=lambda r: r[1]) == want(rows)
    chunks = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    other = new_folder(spark, "store")
    spark.read.parquet(f"{path}/recipes").write.partitionBy("kind").parquet(f"{other}/recipes")
    some = chunks.agg({"key": "min"}).first()[0]
    chunks.filter(chunks.key != some).write.partitionBy("kind").parquet(f"{other}/objects")
    with pytest.raises(Exception, match="does not add up"):
        verify_store(spark, other).collect()
    with pytest.raises(Exception, match="missing"):
        read_store(spark, other).collect()


@pytest.fixture(scope="module")
def store(spark):
    path = new_folder(spark, "store")
    rows = [(k, " ".join(f"t{k * j % 89}" for j in range(5 + k))) for k in range(40)]
    write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path, PATH, end_id=2)
    return path


@pytest.mark.parametrize("change", ["lost", "swapped", "doubled", "renamed", "part"])
def test_changed_recipes(spark, store, change):
    recipes, other = spark.read.parquet(f"{store}/recipes"), new_folder(spark, "store")
    one, two = (F.col("kind") == "recipe") & (F.col("doc_id") == 7), (F.col("kind") == "recipe") & (F.col("doc_id") == 8)
    if change == "lost":
        recipes = recipes.filter(~one)
    elif change == "doubled":
        recipes = recipes.union(recipes.filter(one))
    elif change == "swapped":
        recipes = recipes.withColumn("doc_id", F.when(one, 8).when(two, 7).otherwise(F.col("doc_id")))
    elif change == "renamed":
        recipes = recipes.withColumn("doc_id", F.when(one, 700).otherwise(F.col("doc_id")))
    else:
        recipes = recipes.filter("kind = 'recipe' or part > 0")
    recipes.write.partitionBy("kind").parquet(f"{other}/recipes")
    for folder in ("objects", "manifest"):
        kept = spark.read.parquet(f"{store}/{folder}")
        kept.write.partitionBy("kind" if folder == "objects" else "level").parquet(f"{other}/{folder}")
    with pytest.raises(Exception, match="store's root|add up"):
        verify_store(spark, other).collect()


def test_root_does_not_depend_on_batches_or_partitions(spark, store):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was, got = spark.conf.get(key), {store_root(spark, store)}
    try:
        for batch, parts in ((3, 1), (10_000, 7)):
            spark.conf.set(key, batch)
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            path = new_folder(spark, "store")
            rows = [(k, " ".join(f"t{k * j % 89}" for j in range(5 + k))) for k in range(40)]
            write_store(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), path, PATH, end_id=2)
            got.add(store_root(spark, path))
    finally:
        spark.conf.set(key, was)
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(got) == 1 and next(iter(got))[1] == 40


def test_empty(spark):
    path = new_folder(spark, "store")
    write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH, end_id=2)
    assert verify_store(spark, path).count() == 0 and read_store(spark, path).count() == 0
