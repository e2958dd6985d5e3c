"""The operators against plain Python on small tables: nulls, empty texts, ties, copies, extra columns."""

import hashlib
import re
import zlib

import pytest

from citeloom.llm import chat, decontaminate, exact_dedup, jaccard, packing, sharding, substring_dedup, token_counts
from citeloom.llm.queries import PROBE, tokenizer_path

WORDS = [f"w{i}" for i in range(60)]
LONG = " ".join(WORDS)
ROWS = [
    (1, LONG, "a"), (2, LONG, "b"), (3, None, None), (4, "", "a"), (5, " ".join(WORDS[:58] + ["x", "y"]), "a"),
    (6, "Short Text", "a"), (7, "short text", "a"), (8, "é" * 150 + "ab", "c"), (9, "z" + "é" * 150, "c"), (10, LONG * 80, "d"),
]
SCHEMA = "doc_id long, text string, name string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text(t):
    return t or ""


def test_exact_dedup(docs, none):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_groups(docs).collect()}
    for i, t, _ in ROWS:
        same = [j for j, u, _ in ROWS if text(u) == text(t)]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(text(t).encode()).hexdigest())
    assert exact_dedup.exact_groups(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    ids = {i: [*tok.encode(text(t), add_special_tokens=False).ids, 0] for i, t, _ in ROWS}
    rows = packing.pack(docs, tokenizer_path("byte_bpe_50k.json")).collect()
    ends, seqs = {}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == ends.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        ends[r.doc_id] = r.start + r.length
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert ends == {i: len(v) for i, v in ids.items()}
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(seqs) <= sum(map(len, ids.values())) // 1024 + 2
    assert packing.pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("hot", [1, 20, 60, 100, 200])
def test_packing_of_a_hot_length(hot):
    histogram = {n: 4 for n in range(1, 1024, 3)} | {1024: 300}
    histogram[hot] = histogram.get(hot, 0) + sum(histogram.values()) // 2  # a third of all pieces
    ranks, packs = {}, 0
    for run in packing.plan(histogram):
        at = 0
        for size, rank, offset in run.slots:
            assert offset == at
            at += size
            ranks.setdefault(size, []).append((rank, rank + run.count))
        assert at == run.fill <= 1024
        packs += run.count
    for size, n in histogram.items():
        edges = sorted(ranks[size])
        assert [a for a, _ in edges] == [0, *(b for _, b in edges[:-1])] and edges[-1][1] == n
    assert sum(size * n for size, n in histogram.items()) >= 0.97 * 1024 * packs
    assert sum(run.count for run in packing.plan({hot: 10_000})) == -(-10_000 // (1024 // hot))


def test_packing_of_copies(spark):
    rows = [(k, LONG if k % 3 == 0 else None if k % 3 == 1 else LONG * 3) for k in range(300)]
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path("byte_bpe_50k.json")).collect()
    assert sorted(r.doc_id for r in packed) == list(range(300))
    at = {}
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert sorted(at) == list(range(len(at))) and max(at.values()) <= 1024
    assert sum(at.values()) >= 0.9 * 1024 * len(at)


def test_jaccard(docs, none):
    sets = {}
    for i, t, _ in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text(t)))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.alike(docs).collect()}
    assert got == {i: (len(sets[i]), root[i]) for i in sets}
    assert jaccard.alike(none).count() == 0


def test_jaccard_keeps_unlinked_rows_of_one_id(spark):
    other = [f"v{i}" for i in range(60)]
    rows = [
        (1, LONG), (1, " ".join(other)), (2, " ".join(WORDS[:59] + ["x"])), (3, " ".join(other[:59] + ["x"])),
        (None, " ".join(other[1:])), (None, "one of its own"), (None, "another one"), (4, None), (4, "!"), (4, "!"), (5, " "),
    ]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(repr, map(tuple, kept.collect()))) == sorted(map(repr, [*rows[:2], *rows[5:9], rows[10]]))


def test_substrings(docs, none):
    data = {i: text(t).encode() for i, t, _ in ROWS}
    seen, want = set(), {}
    for i in sorted(data):
        hit = bytearray(len(data[i]))
        for k in range(len(data[i]) - 99):
            s = data[i][k : k + 100]
            if s in seen:
                hit[k : k + 100] = b"\1" * 100
            seen.add(s)
        runs = len(re.findall(b"\1+", bytes(hit)))
        kept = bytes(b for b, h in zip(data[i], hit) if not h)
        want[i] = (len(data[i]), sum(hit), runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.removed(docs).collect()}
    assert got == want
    assert substring_dedup.removed(none).count() == 0


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, " ".join(WORDS[20:32])), (20, "SHORT-text"), (3, None), (4, "")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.find_items(docs, bench).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1] == (60, 12, 1, digest("1")) and got[6] == (2, 2, 1, digest("20"))
    assert got[3] == (0, 0, 0, digest("")) and got[8][1] == 0
    assert decontaminate.find_items(none, bench).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()}
    for i, t, _ in ROWS:
        n = len(tok.encode(text(t), add_special_tokens=False).ids)
        assert got[i] == (len(text(t).encode()), n, n > 2048)
    assert token_counts.token_counts(none, path).count() == 0


def test_shards(docs, none):
    rows = sharding.shards_by_bytes(docs).collect()
    assert sorted(r.doc_id for r in rows) == [i for i, _, _ in ROWS]
    home = {r.doc_id: r.shard for r in rows}
    assert home[1] == home[2] and home[3] == home[4]
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shards_by_bytes(none).count() == 0


def test_chat_reads_control_strings_back(spark):
    turns = spark.createDataFrame([*PROBE, (5, 0, "user", None), (5, 1, "assistant", "")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    said = PROBE[1][3]
    want = "".join(f"{r}\n{t}\n" for _, _, r, t in PROBE)
    assert got[-1].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert (got[-1].loss_chars, got[-1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert (got[5].n_turns, got[5].loss_chars) == (2, 0)
