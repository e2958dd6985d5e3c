"""Bounds that must hold on any table, and results that must not hang on how rows lie together."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import language_id, substring_dedup, toxicity
from citeloom.llm.common import bounded_keys, rows_of


def keys_of(docs, *strata):
    return docs.select("doc_id", F.xxhash64("text").alias("h"), *strata)


def test_a_sample_is_bounded_by_rows(spark):
    few_ids = spark.range(20_000).select((F.col("id") % 50).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    chosen = bounded_keys(keys_of(few_ids), 400)
    assert chosen.count() == 400 and rows_of(few_ids, chosen).count() == 400
    copies = few_ids.withColumn("text", F.lit("one text"))
    assert rows_of(copies, bounded_keys(keys_of(copies), 400)).count() == 50
    nulls = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    kept = rows_of(nulls, bounded_keys(keys_of(nulls), 5000))
    assert kept.count() == 2000 and kept.filter("doc_id IS NULL").count() == 0


def test_a_sample_reaches_every_stratum(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"), F.when(F.col("id") < 7, "rare").otherwise(F.concat(F.lit("l"), F.col("id") % 3)).alias("lang"))
    got = Counter(r.lang for r in rows_of(docs, bounded_keys(keys_of(docs, "lang"), 100, ["lang"])).collect())
    assert sum(got.values()) == 100 and got["rare"] == 7 and min(got[f"l{k}"] for k in range(3)) >= 30
    again = bounded_keys(keys_of(docs.repartition(5), "lang"), 100, ["lang"])
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in bounded_keys(keys_of(docs, "lang"), 100, ["lang"]).collect()}
    many = docs.withColumn("lang", F.col("text"))
    assert bounded_keys(keys_of(many, "lang"), 100, ["lang"]).count() == 100


def test_models_of_repeated_ids(spark, monkeypatch):
    read = []
    monkeypatch.setattr(language_id, "train", lambda rows: read.append(rows))
    monkeypatch.setattr(language_id, "SAMPLE", 60)
    docs = spark.range(4000).select((F.col("id") % 9).alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 500).alias("text"), F.concat(F.lit("l"), F.col("id") % 2).alias("lang"))
    language_id.fit(docs)
    assert len(read[0]) == 60
    monkeypatch.setattr(toxicity, "train", lambda rows: read.append(rows))
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    labels = spark.range(9).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    toxicity.fit(docs, labels)
    assert len(read[1]) <= 80 and {label for _, label in read[1]} == {0, 1}


def test_anchors_do_not_hang_on_the_slice(monkeypatch):
    real = substring_dedup._gram_hashes
    # few high bits, so that many strings are told apart by low bits or not at all
    monkeypatch.setattr(substring_dedup, "_gram_hashes", lambda b: (real(b) >> np.uint64(61) << np.uint64(61)) | (real(b) >> np.uint64(38)))
    rnd = np.random.default_rng(3)
    for _ in range(30):
        passage = rnd.integers(97, 123, substring_dedup.LENGTH, dtype=np.uint8)
        alone = substring_dedup.anchors(passage, np.zeros(1, np.int64))
        at = int(rnd.integers(0, 200_000))
        inside = np.concatenate([rnd.integers(97, 123, at, dtype=np.uint8), passage, rnd.integers(97, 123, 300_000, dtype=np.uint8)])
        begin, stop, place, h = substring_dedup.anchors(inside, np.zeros(1, np.int64))
        k = int(np.searchsorted(begin, at, side="right")) - 1
        assert begin[k] <= at < stop[k]
        assert (place[k] - at, h[k]) == (alone[2][0], alone[3][0])


@pytest.mark.parametrize("size", [200, 2_300_000])
def test_a_passage_goes_whatever_lies_beside_it(spark, size):
    rnd = random.Random(size)
    letters = lambda n: "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = letters(100)
    head, tail = letters(size // 3), letters(size - size // 3)
    docs = spark.createDataFrame([(1, passage), (2, head + passage + tail)], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.removed(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 100)
    assert got[2].kept_sha256 == hashlib.sha256((head + tail).encode()).hexdigest()
