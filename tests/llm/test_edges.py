"""Paths that small tables seldom take, odd rows, and clashing names, against plain Python."""

import hashlib
import heapq
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import chat, common, decontaminate, exact_dedup, exchange, jaccard, language_id, packing, queries, sharding, substring_dedup, suffixes, token_counts, toxicity
from citeloom.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, row long, _row string, _key string, _copy string, own_tox_score string, tox_score string, n_hit string, own_n_hit string, _b string, _start string, set_id string, name string"
ODD = [
    (None, "no id, some words here", 1), (None, "no id, some words here", 1), (1, None, 2), (2, "", 3), (3, "a tie of words one two three", 4), (3, "a tie of words one two three", 4),
    (3, "another text of the same id", 5), (4, "long " * 40_000, 6), (5, "a tie of words one two three", 7), (6, " \n\t ", 8), (7, "ends with a very long run" + " " * 200_000, 9),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, k, *[f"{n}{k}" for n in range(11)]) for i, t, k in ODD], CLASH).repartition(3)


def digest(t):
    return hashlib.sha256((t or "").encode()).hexdigest()


# -- shared helpers ------------------------------------------------------------------------
def test_components_of_chains_and_hot_hubs(spark):
    random.seed(2)
    edges = [(k, k + 1) for k in range(300)] + [(1000, 1001 + k) for k in range(400)] + [(5000, 5000), (6001, 6000), (6000, 6001)]
    random.shuffle(edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(301)}, **{k: 1000 for k in range(1000, 1401)}, 6000: 6000, 6001: 6000}


def test_groups_hot_and_cold(spark):
    rows = spark.createDataFrame([(k if k > 700 else None, k) for k in range(1200)], "key long, v long")
    groups = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = common.with_groups(rows, groups, ["key"], "n").collect()
    assert len(got) == 1200 and {(r.key, r.n) for r in got} == {(None, 701), *((k, 1) for k in range(701, 1200))}


def test_ranks_are_gapless_with_a_hot_key(spark):
    rows = spark.createDataFrame([(k % 3 if k > 900 else 0, k, "x") for k in range(1500)], "key long, v long, _b string")
    got = common.ranked(rows, ["key"], ["v"], "rank").collect()
    for key in range(3):
        assert sorted(r.rank for r in got if r.key == key) == list(range(sum(r.key == key for r in got)))
    assert {r._b for r in got} == {"x"}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(Conf)

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        common._shared_folder(Session)


def test_exchange_tells_what_is_shared(spark):
    random.seed(3)
    held = {d: [random.randrange(400) if random.random() < 0.5 else d * 1000 + k for k in range(60)] + [7] * (30 if d % 2 else 0) for d in range(40)}
    rows = spark.createDataFrame([(d, v) for d, v in held.items()], "d long, v array<long>").repartition(6)
    spread = lambda x: jaccard.mixed(np.array(x, np.uint64))

    def chunks(batches):
        for b in batches:
            ids, lists = b.column("d").to_pylist(), b.column("v").to_pylist()
            yield exchange.Chunk(np.concatenate([spread(v) for v in lists]), np.repeat(np.arange(len(ids)), [len(v) for v in lists]), np.array(ids, "<i8").tobytes())

    def finish(answer, _):
        ids = np.frombuffer(answer.kept, "<i8")
        yield exchange.pa.RecordBatch.from_arrays([exchange.pa.array(c, exchange.pa.int64()) for c in (ids[answer.holders], (answer.tokens >> np.uint64(1)).astype(np.int64), answer.counts)], names=["d", "token", "n"])

    found = exchange.shared_tokens(rows, chunks, finish, "d long, token long, n long")
    counts = {}
    for v in held.values():
        for x in v:
            counts[x] = counts.get(x, 0) + 1
    got = {}
    for r in found.collect():
        got.setdefault(r.d, []).append(r.n)
    assert {d: sorted(ns) for d, ns in got.items()} == {d: sorted(counts[x] for x in v if counts[x] > 1) for d, v in held.items() if any(counts[x] > 1 for x in v)}


# -- packing and tokens --------------------------------------------------------------------
def letters(n):
    random.seed(n)
    out = []
    for _ in range(n):
        top = random.choice([127, 0x3000, 0x3000, 0x1FFFF, 0x10FFFF])
        out.append("".join(c for c in (chr(random.randrange(top)) for _ in range(random.randint(1, 12))) if not "\ud800" <= c <= "\udfff"))
    return out


def test_token_counts_and_ids_are_the_library_s_on_any_letters():
    counter, encoder = token_counts.TokenCounter(tokenizer_path("word_bpe_49k.json")), packing.Encoder(tokenizer_path("byte_bpe_50k.json"))
    known = 0
    for s in [*letters(6000), "ङो\U000187fd", "(ऑ\U0001f3af\U000125b8", "İΣς ΣΑΣ <|endoftext|>x", "a\x1cb\x85c᠎d"]:
        assert counter.count(s) == len(counter.tokenizer.encode(s, add_special_tokens=False).ids), ascii(s)
        assert encoder.ids(s).tolist() == encoder.slow(s), ascii(s)
        known += not token_counts.unsettled().search(s)
    assert known > 1000  # both ways are taken


@pytest.mark.parametrize("sign", [" ", "a", "é", "\n", "漢", "1", "!"])
def test_very_long_runs(sign):
    counter, encoder, text = token_counts.TokenCounter(tokenizer_path("word_bpe_49k.json")), packing.encoder(tokenizer_path("byte_bpe_50k.json")), sign * 600_000
    assert encoder.ids(text).tolist() == encoder.slow(text)
    assert counter.count(text) == len(counter.tokenizer.encode(text, add_special_tokens=False).ids)


def test_packing_on_odd_rows(spark, odd):
    packed = packing.pack(odd, tokenizer_path("byte_bpe_50k.json"), with_ids=True)
    rows = packed.collect()
    encoder = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    sizes = sorted(len(encoder.ids(t or "")) + 1 for _, t, _ in ODD)
    assert sorted(r.doc_tokens for r in rows if r.start == 0) == sizes and sum(r.length for r in rows) == sum(sizes)
    ids = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert sorted(ids) == list(range(len(ids))) and max(ids.values()) <= 1024 and sum(ids.values()) == sum(sizes)


# -- chat --------------------------------------------------------------------------------------
def test_chat_parts(spark):
    nan, inf = float("nan"), float("inf")
    parts = [
        ("text", "see <|image|>", None, None, None, None, None), ("image", None, "i.png", 28, 30, None, None), ("image", None, "bad", -5, 10, None, None), ("audio", None, "a.wav", None, None, 1.01, None),
        ("audio", None, "b", None, None, nan, None), ("audio", None, "c", None, None, inf, None), ("audio", None, "d", None, None, 1e300, None), ("document", None, "p.pdf", None, None, None, 3),
        ("hologram", None, "h", None, None, None, None), (None, "plain", None, None, None, None, None), None,
    ]
    content = "array<struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
    turns = spark.createDataFrame([(1, 0, "user", parts), (1, 1, None, None), (1, 1, None, []), (2, 0, "assistant", [("text", "ok", None, None, None, None, None)])], f"conv_id long, turn int, role string, content {content}")
    rows = chat.format_turns(turns).collect()
    first = next(r for r in rows if r.role == "user")
    assert [(a.kind, a.ref, a.tokens) for a in first.attachments] == [("image", "i.png", 6), ("image", "bad", 1), ("audio", "a.wav", 26), ("audio", "b", 1), ("audio", "c", 1), ("audio", "d", 1), ("document", "p.pdf", 1536), ("unknown", "h", 1)]
    assert first.expanded_tokens == sum(a.tokens for a in first.attachments)
    assert all(first.formatted[a.at :].startswith(f"<|{a.kind}|>") for a in first.attachments)
    assert chat.unescape(first.formatted[len("<|turn|>user\n") :]).startswith("see <|image|><|image|>") and first.formatted.count("<|image|>") == 2
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert (back[1].n_turns, back[1].loss_chars, back[2].loss_chars) == (3, 0, 2)


def test_chat_on_odd_turns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "assistant", "x"), (1, 0, "assistant", "x"), (None, 1, "assistant", "n" * 300_000), (2, None, None, "\\<|end|>\\")]
    turns = spark.createDataFrame([(*r, "c", "d") for r in rows], "conv_id long, turn int, role string, text string, formatted string, loss_start string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert got[1].turns_sha256 == digest("assistant\nx\nassistant\nx\nuser\na\nuser\nb\n") and (got[1].loss_chars, got[1].loss_sha256) == (2, digest("xx"))
    assert got[None].loss_chars == 300_000 and got[2].turns_sha256 == digest("\n\\<|end|>\\\n")
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


# -- exact copies ------------------------------------------------------------------------------
@pytest.mark.parametrize("hash_sql", ["xxhash64(block)", "cast(0 as bigint)", "cast(length(block) % 3 as bigint)"])
def test_exact_groups_though_all_hashes_collide(spark, hash_sql):
    random.seed(5)
    texts = ["".join(random.choice("ab") for _ in range(random.randrange(12))) for _ in range(60)] + ["aaaa" * 9] * 25 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(docs, 4, hash_sql).collect()}
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == (t or "")]
        assert got[i] == (max(same), len(same), i == max(same))


def test_exact_on_odd_rows(odd):
    groups = exact_dedup.exact_groups(odd).collect()
    assert len(groups) == len(ODD) and sum(r.kept for r in groups) == len({t or "" for _, t, _ in ODD})
    kept = exact_dedup.drop_exact(odd)
    assert kept.columns == odd.columns
    # of a group the largest id stays, with the values of its own columns
    assert sorted((repr(r.doc_id), digest(r.text)) for r in kept.collect()) == sorted((repr(max((j for j, u, _ in ODD if (u or "") == t and j is not None), default=None)), digest(t)) for t in {u or "" for _, u, _ in ODD})
    assert {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}


# -- Jaccard -----------------------------------------------------------------------------------
def near(seed):
    random.seed(seed)
    word = lambda: f"w{random.randrange(400)}"
    base, chain, tail = [word() for _ in range(70)], [word() for _ in range(200)], [word() for _ in range(50)]
    texts = []
    for _ in range(60):
        t = list(base)
        for _ in range(random.randrange(3)):
            t[random.randrange(70)] = word()
        texts.append(" ".join(t))
    texts += [" ".join(chain[3 * k : 3 * k + 70]) for k in range(40)] + [" ".join([word() for _ in range(random.choice([4, 12, 40]))] + tail) for _ in range(40)]
    texts += [" ".join(word() for _ in range(random.randrange(9))) for _ in range(30)]
    random.shuffle(texts)
    return texts


@pytest.mark.parametrize("block", [1500, 9])
def test_jaccard_of_large_groups(spark, block):
    texts = near(4)
    sets = [({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if (w := t.split()) else set()) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.alike(docs, block=block).collect()}
    assert got == {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def test_jaccard_on_odd_rows(odd):
    rows = jaccard.alike(odd).collect()
    assert len(rows) == len(ODD) and {r.n_shingles for r in rows if r.doc_id in (1, 2, 6)} == {0}
    assert {r.component_id for r in rows if r.doc_id == 5} == {3}
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and {tuple(r) for r in kept.collect()} <= {tuple(r) for r in odd.collect()}
    assert {r.doc_id for r in jaccard.alike(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()} == {None, *map(str, range(1, 8))}


# -- decontamination ---------------------------------------------------------------------------
def test_many_benchmarks_in_one_session(spark):
    docs = common.settle(spark.createDataFrame([(k, f"term{k % 25} stays") for k in range(100)], "doc_id long, text string").repartition(4))
    for k in range(25):
        bench = spark.createDataFrame([(k, f"term{k}")], "item_id long, text string")
        hit = {r.doc_id for r in decontaminate.find_items(docs, bench).filter("n_hit > 0").collect()}
        assert hit == {d for d in range(100) if d % 25 == k}


@pytest.mark.parametrize("limit", [1 << 20, 300])
def test_windows_in_one_block_or_many(spark, odd, limit):
    random.seed(6)
    word = lambda: f"v{random.randrange(12)}"
    items = {k: " ".join(word() for _ in range(random.choice([1, 3, 9, 10, 11, 20]))) for k in range(40)}
    docs = {k: "-".join(word() for _ in range(random.randrange(200))) for k in range(30)}
    wins = {k: {tuple(t.split()[i : i + 10]) for i in range(max(1, len(t.split()) - 9))} for k, t in items.items()}
    want = {}
    for d, t in docs.items():
        w, hit, ids = re.findall(r"v\d+", t), set(), set()
        for k, ws in wins.items():
            for win in ws:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit.update(range(i, i + len(win)))
                        ids.add(str(k))
        want[d] = (len(w), len(hit), len(ids), digest(",".join(sorted(ids))))
    bench = spark.createDataFrame([*items.items(), (99, None)], "item_id long, text string")
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.find_items(rows, bench, limit=limit).collect()}
    assert got == want
    kept = decontaminate.drop_contaminated(odd, spark.createDataFrame([(1, "no id, some words")], "item_id long, text string"))
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.filter("doc_id IS NOT NULL").collect()))


# -- shards ------------------------------------------------------------------------------------
def test_shards_against_exact_scheduling(spark, odd):
    random.seed(7)
    texts = ["x" * random.choice([0, 5, 5, 40, 700, 9000, 90_000]) + str(random.randrange(60)) for _ in range(500)] + ["hot"] * 250 + [None, "", "é" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    rows = sharding.shards_by_bytes(docs).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    jobs, home, slots, load = {}, {}, {}, [0] * 16
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        assert home.setdefault(raw, r.shard) == r.shard
        jobs[raw] = jobs.get(raw, 0) + r.size
        slots.setdefault(r.shard, []).append(r.slot)
        load[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    exact = [(0, k) for k in range(16)]
    for size in sorted(jobs.values(), reverse=True):
        x, k = heapq.heappop(exact)
        heapq.heappush(exact, (x + size, k))
    assert max(load) <= 1.01 * max(exact)[0] and min(load) >= 0.99 * min(exact)[0]
    assert sharding.shards_by_bytes(odd).count() == len(ODD)


@pytest.mark.parametrize("count", [1, 63, 65, 5000])
def test_a_run_of_equal_jobs_is_dealt_as_by_the_heap(count):
    random.seed(count)
    loads = [float(random.randrange(3000)) for _ in range(16)]
    heap = [(x, k) for k, x in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(count):
        x, k = heapq.heappop(heap)
        heapq.heappush(heap, (x + 7, k))
    given = sharding.deal(loads, 7.0, count)
    assert sum(given) == count and sorted(loads) == sorted(x for x, _ in heap)


# -- suffix arrays and repeated passages ---------------------------------------------------------
def test_suffix_arrays_of_many_names():
    random.seed(8)
    for n, top in ((1, 3), (2, 3), (50, 3), (400, 2), (3000, 4), (3000, 2000), (2500, 700)):
        t = np.array([*(random.randrange(1, top + 1) for _ in range(n)), 0])
        if n > 2000:
            t = np.concatenate([t[:-1], t[:-1], t[: n // 2], [0]])  # long repeats: names recur, so they are sorted in turn
        tail = t.tolist()
        order = suffixes.suffix_array(t)
        assert order.tolist() == sorted(range(len(tail)), key=lambda i: tail[i : i + 6000])
        share = suffixes.common_prefixes(t, order)
        for a, b in list(zip(order, order[1:]))[:: max(1, n // 40)]:
            k = 0
            while tail[a + k] == tail[b + k]:
                k += 1
            assert share[b] == k


def repeats(rows):
    data = {i: (t or "").encode() for i, t in rows}
    seen, want = set(), {}
    for i in sorted(data):
        hit = bytearray(len(data[i]))
        for k in range(len(data[i]) - 99):
            s = data[i][k : k + 100]
            if s in seen:
                hit[k : k + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(b for b, h in zip(data[i], hit) if not h)
        want[i] = (len(data[i]), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return want


@pytest.mark.parametrize("settings", [{}, {"frequent": 3}, {"frequent": 3, "bucket": 2000, "shard": 3000}])
def test_repeated_passages(spark, monkeypatch, settings):
    monkeypatch.setattr(substring_dedup, "REMEMBERED", 20)
    random.seed(9)
    pool = [" ".join(f"w{random.randrange(300)}" for _ in range(60)) for _ in range(30)]
    rows = []
    for i in range(250):
        parts = []
        for _ in range(random.randrange(6)):
            p = random.choice(pool)
            a = random.randrange(len(p) // 2)
            parts += [p[a : random.randrange(a, len(p))], random.choice(["", f"w{random.randrange(300)}"])]
        rows.append((i * 3, " ".join(parts)))
    rows += [(5000, None), (5001, ""), (5003, pool[0] * 20), (5004, "a" * 3000), (5005, "ab" * 900), (5006, "é" * 400), (5007, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.removed(docs, **settings).collect()}
    assert got == repeats(rows)


def test_repeated_passages_on_odd_rows(odd):
    rows = substring_dedup.removed(odd, with_text=False).collect()
    assert len(rows) == len(ODD) and {r.n_bytes for r in rows if r.doc_id in (1, 2)} == {0}
    assert all(r.kept_text is None for r in rows)
    assert {r.doc_id for r in substring_dedup.removed(odd.withColumn("doc_id", F.col("doc_id").cast("string"))).collect()} == {None, *map(str, range(1, 8))}


# -- models ------------------------------------------------------------------------------------
def test_labels_that_contradict_each_other_teach_nothing(spark):
    docs = spark.createDataFrame([(k, f"vile{k} words" if k % 2 else f"kind{k} words") for k in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k in range(80) for y in (0, 1)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert all(r.tox_score < 0.1 for r in toxicity.score(docs, model).collect())


def test_chains_add_to_single_words():
    texts = [("you are vile and foul and base here", 1) if k % 2 else (f"the calm sea number {k} was blue today", 0) for k in range(300)]
    model = toxicity.train(texts)
    alone = toxicity.replace(model, steps=np.zeros((2, 2)))
    e = np.array([model.emission(w) for w in "you are vile and foul and base here".split()])
    assert not np.allclose(model.marginals(e), alone.marginals(e)) and model.marginals(e).min() >= alone.marginals(e).min()


def test_rejection_follows_the_held_back_part():
    p = np.array([[0.99, 0.01], [0.9, 0.1], [0.8, 0.2], [0.6, 0.4]])
    assert language_id.rejection(p, np.array([0, 0, 0, 0])) == 0.5
    assert language_id.rejection(p, np.array([0, 0, 0, 1])) == 0.8
    assert language_id.rejection(p, np.array([1, 0, 0, 0])) == 1.0


def test_toxic_rows_go_with_any_columns(spark, odd):
    model = toxicity.Field(layer=np.array([4.0, 0.0, 0.0, 0.0]))
    assert toxicity.drop_toxic(odd, model).count() == 0
    model.layer = np.array([-4.0, 0.0, 0.0, 0.0])
    kept = toxicity.drop_toxic(odd, model)
    assert kept.columns == odd.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, odd.collect()))


# -- the registered queries ----------------------------------------------------------------------
def test_queries_read_every_row(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for name in ("op3_exact_dedup", "op4_toxicity", "op5_language_id", "op6_jaccard", "op7_decontaminate", "op8_token_counts", "op9_shards", "op10_substrings"):
        assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF).select("doc_id").collect()) == sorted(docs), name
    counter = token_counts.TokenCounter(tokenizer_path("word_bpe_49k.json"))
    for r in queries.op8_token_counts(spark, SF).collect():
        n = len(counter.tokenizer.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 2048)
    want = repeats(docs.items())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_substrings(spark, SF).collect()} == want
    load = [0] * 16
    for r in queries.op9_shards(spark, SF).collect():
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(docs[r.doc_id].encode()) + 1, zlib.crc32(docs[r.doc_id].encode()), "bytes", None)
        load[r.shard] += r.size
    assert max(load) - min(load) <= 0.02 * sum(load) / 16 + max(len(t.encode()) for t in docs.values())
    encoder = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: [*encoder.slow(t), 0] for i, t in docs.items()}
    rows = queries.op1_packing(spark, SF).collect()
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert len({r.sequence_id for r in rows}) <= math.ceil(sum(map(len, ids.values())) / 1024 * 1.02) + 1
