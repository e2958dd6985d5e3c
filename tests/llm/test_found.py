"""Secrets, the conversation trie and spelling variants against their SQL and plain Python."""

import hashlib
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from citeloom.llm import prefix_trie, secret_scan, spelling


def in_duckdb(sql, **tables):
    con = duckdb.connect()
    for name, (kinds, rows) in tables.items():
        con.execute(f"CREATE TABLE {name} ({kinds})")
        if rows:
            con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(rows[0]))})", rows)
    return con.sql(sql)


def counted(df):
    return Counter(tuple(map(str, r)) for r in df.collect())


# secrets


def plain_secrets(text):
    out = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return sorted(out)


def noise(rnd):
    parts = ["password", "Passwd", "secret", "toKen", "apikey", "api_key", ":", "=", "'", '"', " ", "AKIA", "0123", "é", "\n", "-", "_", "/", " x ", "ſecret", "a" * 70]
    kinds = [string.hexdigits[:16], string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_lowercase + string.digits]
    return "".join(rnd.choice(parts) if rnd.random() < 0.6 else "".join(rnd.choices(rnd.choice(kinds), k=rnd.randint(3, 60))) for _ in range(rnd.randint(0, 14)))


def test_secrets_against_sql_and_plain_patterns(spark):
    rnd = random.Random(5)
    rows = [(i, noise(rnd)) for i in range(400)] + [(400, None), (401, ""), (402, "word " * 50_000 + "token=" + "k9" * 40_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, spans string").repartition(3)
    got = secret_scan.find_secrets(docs)
    assert counted(got.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")) == Counter(
        tuple(map(str, r)) for r in in_duckdb(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({secret_scan.oracle()})", documents=("doc_id bigint, text varchar", rows)).fetchall()
    )
    for r in got.collect():
        base = [x[2] for x in plain_secrets(rows[r.doc_id][1] or "")]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) - {""} <= set(r.spans.split(","))


def test_entropy_windows_and_allow_list():
    s = secret_scan.Scanner()
    key = "q7Zp2Lx9Vb4Nw8Kd3Rt6Ys1H"
    assert [x[2] for x in s.spans(f"is {key} .")[1]] == ["entropy_base64"]
    for quiet in ("z" * 100, "abcdefghijklmnopqrstuvwxyz0123456789", "under-the-hood/of_all_the_words/here", "0f8fad5b-d9cb-469f-a165-70867728950e", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"):
        assert s.spans(f"see {quiet} here") == ([], [])
    loud = secret_scan.Scanner(allowed=())
    assert loud.spans("see wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY here")[1]
    # windows that meet are one span, and a span inside a fixed one is left out
    assert [x[:2] for x in s.spans(key * 3)[1]] == [(0, 72)]
    assert [x[2] for x in s.spans(f"token={key}")[1]] == ["assign"]


def test_secrets_of_no_rows_and_odd_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.find_secrets(none).count() == 0
    same = spark.createDataFrame([(None, "secret: abcdef"), (1, "secret: abcdef"), (1, "secret: abcdef")], "doc_id long, text string")
    assert [(r.doc_id, r.spans) for r in secret_scan.find_secrets(same).collect()] == [(None, "assign:0:14"), (1, "assign:0:14"), (1, "assign:0:14")]


# the trie


def plain_trie(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    below = lambda k: [x for x in nodes if x[: len(k)] == k]
    for k, v in nodes.items():
        kids = [x for x in nodes if len(x) == len(k) + 1 and x[: len(k)] == k]
        leaves = [x for x in below(k) if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes)]
        saved = sum((len(nodes[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below(k) if x)
        ends = ",".join(str(c) for c in sorted(v) if len(built[c]) == len(k))
        yield min(v), len(k), min(nodes[k[:-1]]) if k else None, len(v), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()


def conversations(rnd, n, depth):
    rows = []
    for _ in range(n):
        c = rnd.randrange(200)
        rows += [(c, t if rnd.random() < 0.9 else None, rnd.choice(["user", "user", None]), rnd.choice(["a", "a", "b b", "", None])) for t in range(rnd.randint(1, depth))]
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize(("seed", "n", "depth", "block", "wide"), [(1, 60, 5, 3, 2), (2, 25, 9, 2, 3)])
def test_trie_with_small_blocks(spark, seed, n, depth, block, wide):
    rows = conversations(random.Random(seed), n, depth) + [(None, 0, "user", "lost")]
    turns = spark.createDataFrame([(*r, 7) for r in rows], f"{TURNS}, depth long").repartition(3)
    got = prefix_trie.trie(turns, block=block, wide=wide)
    assert counted(got) == Counter(tuple(map(str, r)) for r in plain_trie(rows))


def test_trie_against_sql(spark):
    rows = conversations(random.Random(3), 120, 4) + [(c, t, "user", f"long {t % 3} way") for c in (401, 404) for t in range(150)]
    columns = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    want = in_duckdb(f"SELECT {columns} FROM ({prefix_trie.oracle()})", conversations=("conv_id bigint, turn bigint, role varchar, text varchar", rows))
    assert counted(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == Counter(tuple(map(str, r)) for r in want.fetchall())


def test_trie_of_one_and_of_none(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).count() == 0
    for rows in ([(1, 0, "user", "one two")], [(21, 0, None, None)]):  # the latter has no turn left
        got = prefix_trie.trie(spark.createDataFrame(rows, TURNS))
        assert counted(got) == Counter(tuple(map(str, r)) for r in plain_trie(rows))


# spelling variants


def plain_variants(rows):
    n = Counter()
    for doc_id, text in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}

    def near(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in n if x != w and near(w, x)] for w in n}
    form = {}
    for w, others in close.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        yield w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None


def misspelt(rnd, rows):
    seeds = ["verschieden", "überall", "straßenbahn", "çaíste", "network", "aaaaaa", "aaaaab", "mississippi", "ÉÉÉÉÉÉ"]
    out = []
    for i in range(rows):
        words = []
        for _ in range(40):
            w = rnd.choice(seeds[: 2 + i % len(seeds)])
            for _ in range(rnd.choice([0, 0, 0, 0, 1, 1, 2])):
                k = rnd.randrange(len(w))
                w = rnd.choice([w[:k] + w[k + 1 :], w[:k] + rnd.choice("abß") + w[k:], w[:k] + rnd.choice("abÿ") + w[k + 1 :]])
            words.append(w.title() if rnd.random() < 0.2 else w)
        out.append((i if rnd.random() < 0.95 else None, rnd.choice([" ", ", ", "1"]).join(words)))
    chain = "chainwordss " * 300 + "chainwords " * 50 + "chainword " * 8
    return [*out, (rows, None), (rows, ""), (rows, chain)]


@pytest.mark.parametrize("group", [1, 64])
def test_variants(spark, group):
    rows = misspelt(random.Random(8), 150)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(4)
    got = spelling.variants(docs, group).select("word", "form", "root", "n", "n_near", "form_n")
    want = Counter(tuple(map(str, r)) for r in plain_variants(rows))
    assert sum(want.values()) > 100 and any(r[1] not in ("None", r[2]) for r in want)
    assert counted(got) == want


def test_variants_against_sql(spark):
    rows = misspelt(random.Random(9), 120)
    want = in_duckdb(f"SELECT word, form, root, n, n_near, form_n FROM ({spelling.oracle()})", documents=("doc_id bigint, text varchar", rows))
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"))
    assert counted(got.select("word", "form", "root", "n", "n_near", "form_n")) == Counter(tuple(map(str, r)) for r in want.fetchall())


def test_variants_of_none(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
