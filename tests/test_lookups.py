"""Title matches, whole lookups, and batches that break off and are taken up again."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.operators import batch as B
from citeloom.operators import lookups as L
from citeloom.operators import matching as M
from citeloom.operators import works as W
from citeloom.sinks import payloads as P

STOP = {"the", "of", "and", "in", "on", "for", "a", "an", "to", "with", "by"}


def plain_matches(refs, hits, top=5, least=0.8):
    words = lambda t: {w for w in (t or "").lower().split() if w not in STOP}
    out = {}
    for ref, title in refs:
        a = words(title)
        for source in {s for s, _, _ in hits}:
            scored = []
            for s, o, t in hits:
                b = words(t)
                if s == source and a and b and len(a & b) / min(len(a), len(b)) >= least:
                    scored.append((-len(a & b) / min(len(a), len(b)), o))
            for place, (score, o) in enumerate(sorted(scored)[:top], 1):
                out[(ref, source, place)] = (o, round(-score, 9))
    return out


@pytest.mark.parametrize("postings", [3, 4096])
def test_title_matches_against_brute_force(spark, postings, monkeypatch):
    monkeypatch.setattr(M.similar, "__defaults__", (0.8, postings))
    rnd = random.Random(postings)
    pool = [f"w{k}" for k in range(40)]
    # one word that nearly every title has, titles of that word alone, copies, and none
    title = lambda: " ".join(["network"] * (rnd.random() < 0.9) + rnd.choices(pool[: rnd.choice([6, 40])], k=rnd.randint(1, 7)))
    refs = [(i, title()) for i in range(60)] + [(60, "network"), (61, None), (62, ""), (63, "the of"), (64, "network")]
    hits = [(rnd.choice(["crossref", "openalex"]), f"o{i:03d}", title()) for i in range(150)] + [("crossref", f"n{i}", "network") for i in range(8)] + [("eric", "x", None)]
    got = M.title_matches(spark.createDataFrame(refs, "ref_id int, title string"), spark.createDataFrame(hits, "source string, ord string, title string"))
    assert {(r.ref_id, r.source, r.place): (r.ord, round(r.overlap, 9)) for r in got.collect()} == plain_matches(refs, hits)


@pytest.mark.parametrize("rare", [0, 2, 40, 10_000])
def test_titles_by_classes_against_brute_force(spark, rare):
    rnd = random.Random(rare)
    # three frequent words and a number that one or two titles have: all titles of a kind are alike
    title = lambda: " ".join([rnd.choice(["red", "blue"]), rnd.choice(["bolt", "ring"]), "brand", str(rnd.randint(1, 3)), str(rnd.randint(1, 200))][: rnd.choice([2, 4, 5, 5, 5, 5])])
    refs = [(i, title()) for i in range(80)]
    hits = [(rnd.choice(["crossref", "openalex", "eric"]), f"o{i:03d}", title()) for i in range(300)]
    got = M.title_matches(spark.createDataFrame(refs, "ref_id int, title string"), spark.createDataFrame(hits, "source string, ord string, title string"), rare=rare)
    assert {(r.ref_id, r.source, r.place): (r.ord, round(r.overlap, 9)) for r in got.collect()} == plain_matches(refs, hits)


def test_alike_titles_are_not_paired(spark):
    """1,000 titles on both sides with all words but one in common make 1,000 pairs to look at and not a million."""
    n = 1000
    titles = spark.range(n).select(F.concat(F.lit("red bolt brand 7x y"), "id").alias("title"), "id")
    refs, hits = titles.select(F.col("id").alias("ref_id"), "title"), titles.select(F.lit("eric").alias("source"), F.lpad(F.col("id").cast("string"), 4, "0").alias("ord"), "title")
    counted = M._counted([t.select(M.title_key(F.col("title")).alias("key")).select("key", F.split("key", " ").alias("words")).withColumn("n", F.size("words")) for t in (refs, hits)])
    few = F.col("titles") <= M.RARE
    assert M._probed(counted[0], 0.8).filter(few).join(M._indexed(counted[1]).filter(few), "token").count() == n
    got = {(r.ref_id, r.place): (r.ord, r.overlap) for r in M.title_matches(refs, hits).collect()}
    assert len(got) == 5 * n and got[700, 1] == ("0700", 1.0) and [got[700, p] for p in (2, 3, 4, 5)] == [(f"000{k}", 0.8) for k in range(4)]


def test_title_matches_of_none(spark):
    refs, hits = spark.createDataFrame([], "ref_id int, title string"), spark.createDataFrame([("a", "o", "some title")], "source string, ord string, title string")
    assert M.title_matches(refs, hits).count() == 0
    assert M.title_matches(refs.unionByName(spark.createDataFrame([(1, "some title")], refs.schema)), hits.limit(0)).count() == 0


def test_ranks_do_not_hang_on_exchange_reuse(spark):
    works = spark.range(300_000).select(F.col("id").cast("string").alias("first_ord"), (F.col("id") % 37 + 1980).cast("int").alias("year"), F.lit(1).alias("n_sources"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        seen = W.rank_works(works).agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).first()
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    assert tuple(seen) == (1, 300_000, 300_000)


CACHE = "source string, key string, payload string"


def test_a_lookup_asks_what_the_cache_lacks_once(spark):
    refs = spark.createDataFrame(
        [(1, "10.1/A", "one", ["Lee, A"], 2001), (2, "https://doi.org/10.1/a", "one", None, None), (3, None, "Some title", None, None), (4, "10.9/x", None, None, None), (5, None, None, None, None)],
        "ref_id int, doi string, title string, authors array<string>, year int",
    )
    agencies = spark.createDataFrame([("10.1", "Crossref", None), ("10.9", None, None)], "prefix string, agency string, error string")
    work = '{"title":["One"],"DOI":"10.1/A","author":[{"given":"A","family":"Lee"}],"issued":{"date-parts":[[2001]]}}'
    cache = spark.createDataFrame([("crossref", "doi:10.1/a", f'{{"message":{work}}}'), ("openalex", "match:some title:5", '{"results":[{"display_name":"Some title"},{"display_name":"Other"}]}')], CACHE)
    asked = []

    def ask(requests):
        asked.extend((r.source, r.key, r.url) for r in requests.collect())
        return requests.select("source", "key", F.lit(None).cast("string").alias("payload"), F.when(F.col("source") == "openalex", "TIMEOUT").alias("error"))

    e = L.fetch_batch(refs, agencies, cache, ask, {"crossref": "C", "openalex": "O"})
    said = {(r.ref_id, r.source): (r.query_kind, r.outcome, r.error, r.from_cache) for r in e.queries.collect()}
    assert said[(1, "crossref")] == said[(2, "crossref")] == ("doi", "hit", None, True)
    assert said[(1, "openalex")] == ("doi", "error", "TIMEOUT", False)
    assert said[(3, "crossref")] == ("title_match", "miss", None, False) and said[(3, "openalex")] == ("title_match", "hit", None, True)
    assert said[(5, "crossref")] == (None, "miss", None, False) and (4, "crossref") not in said
    assert Counter(asked) == {("openalex", "doi:10.1/a", "O/works/doi:10.1/a"): 1, ("crossref", "match:some title:5", "C/works?query.bibliographic=Some%20title&rows=5"): 1}
    assert {(r.ref_id, r.source, r.title) for r in e.hits.collect()} == {(1, "crossref", "One"), (2, "crossref", "One"), (3, "openalex", "Some title")}
    verdicts = {r.ref_id: (r.status, r.calls, r.cached, r.errors) for r in L.verify_batch(refs.withColumns({"parse_status": F.lit("ok"), "manual_verified": F.lit(False), "venue": F.lit(None).cast("string")}), agencies, cache, ask).collect()}
    assert verdicts == {1: ("VERIFIED", 2, 1, 1), 2: ("VERIFIED", 2, 1, 1), 3: ("VERIFIED", 2, 1, 0), 4: ("NOT_FOUND", 0, 0, 0), 5: ("PENDING_MANUAL", 2, 0, 0)}
    one = L.lookup(spark, agencies, cache, doi="10.1/A", authors=["Lee"])
    assert [r.outcome for r in one.queries.orderBy("place").collect()] == ["hit", "miss"]
    with pytest.raises(ValueError, match="DOI or a title"):
        L.lookup(spark, agencies, cache)


def test_ids_are_fetched_in_lists_and_go_back_to_their_seeds(spark):
    seeds = [(s, [f"https://openalex.org/W{k}" for k in range(s, s + 120, s)]) for s in (1, 2, 3)] + [(9, [])]
    works = spark.createDataFrame(seeds, "seed_id int, u array<string>").select("seed_id", F.to_json(F.struct(F.col("u").alias("referenced_works"))).alias("payload"))
    lists = []

    def ask(requests):
        lists.extend(r.ids for r in requests.select(F.split(F.substring_index("key", "refs:", -1), ",").alias("ids")).collect())
        one = lambda i: F.concat(F.lit('{"id":"https://openalex.org/'), i, F.lit('","display_name":"T'), i, F.lit('"}'))
        listed = F.transform(F.filter(F.split(F.substring_index("key", "refs:", -1), ","), lambda i: i != "W7"), one)
        return requests.select("source", "key", F.concat(F.lit('{"results":['), F.array_join(listed, ","), F.lit("]}")).alias("payload"), F.lit(None).cast("string").alias("error"))

    got = {(r.seed_id, r.place): (r.work_id, r.title) for r in L.reference_records(works, spark.createDataFrame([], CACHE), ask, most=100).collect()}
    want = {(s, p): (u.rsplit("/", 1)[1], "T" + u.rsplit("/", 1)[1]) for s, us in seeds for p, u in enumerate(us[:100]) if not u.endswith("/W7")}
    assert got == want
    assert max(map(len, lists)) <= 50 and len(lists) < 12 and Counter(i for x in lists for i in x).most_common(1)[0][1] == 1


def test_a_save_that_breaks_off_is_made_again(spark, tmp_path):
    path = str(tmp_path / "state")
    refs = spark.createDataFrame([(k, f"10.1/{k}", f"t{k}") for k in range(20)], "ref_id int, doi string, title string")
    done = lambda df: df.select("ref_id", F.concat(F.lit("v"), F.col("ref_id")).alias("status"))
    assert B.load_state(refs, path) is None
    B.save_state(refs, done(refs.filter("ref_id < 5")), path)
    B.save_state(refs, done(refs.filter("ref_id < 5")), path)  # the same again
    assert B.load_state(refs, path).count() == 5
    fails = F.when(F.col("ref_id") == 12, F.raise_error(F.lit("killed")).cast("string")).otherwise("v")
    with pytest.raises(Exception, match="killed"):
        B.resumed(refs, path, lambda left: left.repartition(4).select("ref_id", fails.alias("status")))
    # rows without a commit: as if the driver had died between the two
    done(refs).write.parquet(f"{path}/attempts/orphan")
    assert B.load_state(refs, path).count() == 5
    worked = []

    def work(left):
        worked.append(left.count())
        return done(left)

    whole = B.resumed(refs, path, work)
    assert worked == [15] and {(r.ref_id, r.status) for r in whole.collect()} == {(k, f"v{k}") for k in range(20)}
    B.resumed(refs, path, work)
    assert worked == [15]
    with pytest.raises(ValueError, match="other references"):
        B.resumed(refs.filter("ref_id < 3"), path, work)


def test_source_changes(spark):
    before = spark.createDataFrame([("r", 1, "a"), ("r", 2, "b"), ("r", 3, None), ("s", 1, "x"), ("s", 2, None)], "run string, item int, text string")
    after = spark.createDataFrame([("r", 1, "a"), ("r", 2, "B"), ("r", 3, None), ("s", 2, ""), ("s", 3, "n")], "run string, item int, text string")
    got = {(r.run, r.item): r.source_changed for r in B.source_changes(before, after).collect()}
    assert got == {("r", 1): False, ("r", 2): True, ("r", 3): False, ("s", 1): True, ("s", 2): True, ("s", 3): True}
    steps = B.source_changes(before, after).withColumn("status", F.lit("ok"))
    assert {r.run: r.exit_code for r in B.exit_states(steps).collect()} == {"r": 3, "s": 3}


def written(path):
    return json.loads("".join(f.read_text() for f in sorted(path.glob("part-*"))))


def test_payloads_are_one_document(spark, tmp_path):
    works = spark.range(5000).select(
        F.concat(F.lit("k"), F.col("id")).alias("key"), F.lit(2).cast("long").alias("n_hits"), F.col("id").cast("string").alias("first_ord"), F.when(F.col("id") % 3 > 0, 1990 + F.col("id") % 30).cast("int").alias("year"),
        F.lit(1).alias("n_sources"), F.lit('a "title"\n').alias("title"), F.lit("v").alias("venue"), F.lit("book").alias("type"), F.lit("crossref").alias("primary_source"),
    ).repartition(7)
    attempts = spark.createDataFrame([("crossref", "hit", None), ("openalex", "error", "TIMEOUT")], "source string, outcome string, error string")
    P.write_document(P.search_payload('a "query"', works, attempts), str(tmp_path / "s"))
    got = written(tmp_path / "s")
    assert (got["query"], got["network_status"], got["stats"]["raw_hits"], got["stats"]["after_dedup"]) == ('a "query"', "degraded", 10_000, 5000)
    assert {c["source"]: c["outcome"] for c in got["coverage"]}["openalex"] == "error" and {a["dim"] for a in got["advisories"]} == {"venue", "type", "source"}
    assert [w["rank"] for w in got["works"]] == list(range(1, 5001)) and got["works"][0]["title"] == 'a "title"\n'
    years = [w["year"] or 0 for w in got["works"]]
    assert years == sorted(years, reverse=True) and got["works"][-1]["year"] is None
    P.write_document(P.search_payload("none", works.limit(0), attempts, 5), str(tmp_path / "e"))
    assert written(tmp_path / "e")["works"] == []


def test_author_and_verify_payloads(spark, tmp_path):
    people = spark.createDataFrame([(1, "openalex", "A B", "E1", "0000-0001-2345-6789", 5, "U", True), (2, "openalex", "A. B", "E2", "0000-0001-2345-6789", 2, "U", False), (3, "openalex", "C", "E3", None, 9, None, False)], "ord int, source string, name string, entity_id string, orcid string, works_count long, affiliation string, exact_name_match boolean")
    P.write_document(P.author_payload("A B", people, reported=10), str(tmp_path / "a"))
    got = written(tmp_path / "a")
    assert [(c["rank"], c["name"], c["n_entities"]) for c in got["candidates"]] == [(1, "C", 1), (2, "A B", 2)] and got["warnings"]["cut"] and got["total_found"] == 10
    judged = spark.createDataFrame([(2, "VERIFIED"), (1, "NOT_FOUND"), (3, "VERIFIED")], "ref_id int, status string")
    queries = spark.createDataFrame([(1, "crossref", "miss", None, True), (2, "crossref", "hit", None, False)], "ref_id int, source string, outcome string, error string, from_cache boolean")
    P.write_document(P.verify_payload(judged, queries), str(tmp_path / "v"))
    got = written(tmp_path / "v")
    assert [i["ref_id"] for i in got["items"]] == [1, 2, 3] and got["stats"]["calls"] == 2 and {s["status"]: s["n"] for s in got["by_status"]} == {"VERIFIED": 2, "NOT_FOUND": 1}
