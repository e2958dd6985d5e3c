"""Queries of manuscript text."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import markdown as M
from citeloom.functions import spans
from citeloom.functions import text as X
from citeloom.functions.jats import clean_jats
from citeloom.functions.markup import html_of
from citeloom.model import dims
from citeloom.operators import manuscripts as O
from citeloom.plans import manuscript_sql as Q
from citeloom.plans.views import duck, view
from citeloom.registry import query
from citeloom.session import ship
from citeloom.sources import notes


def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


def _papers(spark, sf_dir):
    return view(spark, sf_dir, "v_manuscripts", spread=True)


_CHARS = Q.CHARS.format("coalesce(text, '')")


@query("effective_chars", f"SELECT doc_id, {_CHARS} AS chars FROM documents")
def effective_chars(spark, sf_dir):
    """Characters that count."""
    return _docs(spark, sf_dir).select("doc_id", X.effective_chars(F.coalesce("text", F.lit(""))).cast("long").alias("chars"))


_LINES = f"{duck('v_manuscripts')}, {Q.lines('l', 'v_manuscripts', 'doc_id')}"


@query("strip_markdown", f"{_LINES}, {Q.stripped('p', 'l', 'doc_id')}, {Q.stripped('q', 'l', 'doc_id', True)} SELECT doc_id, coalesce(p.plain, '') AS plain, coalesce(q.plain, '') AS with_quotes FROM v_manuscripts LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)")
def strip_markdown(spark, sf_dir):
    """The prose of all manuscripts, without and with quotes."""
    return _papers(spark, sf_dir).select("doc_id", M.strip_markdown(F.col("text")).alias("plain"), M.strip_markdown(F.col("text"), keep_quotes=True).alias("with_quotes"))


@query("paragraphs", f"{_LINES}, {Q.paragraphs('p', 'l')} SELECT doc_id, position::INT AS position, paragraph FROM p")
def paragraphs(spark, sf_dir):
    """The paragraphs of all manuscripts."""
    return O.paragraphs(_papers(spark, sf_dir))


@query("sections", f"{_LINES}, {Q.sections('s', 'l', 'p')} SELECT doc_id, position::INT AS position, section, body FROM s")
def sections(spark, sf_dir):
    """The sections of all manuscripts."""
    return O.sections(_papers(spark, sf_dir))


_GAPS = "|".join(dims.GAP_WORDS)
_SCAN = f"""{_LINES}, {Q.paragraphs('p', 'l')}, g AS (SELECT doc_id, position, paragraph, regexp_replace(paragraph, '(?:{_GAPS})[ \\t\\p{{Z}}\\n]*(?:[(（][^)）]*[)）])?', '', 'g') AS ungapped FROM p),
    {Q.lines('m', 'g', 'doc_id, position', 'ungapped')}, {Q.stripped('c', 'm', 'doc_id, position', True)}, {Q.lines('r', 'p', 'doc_id, position', 'paragraph')},
    qt AS (SELECT doc_id, position, count(*) FILTER (starts_with(s, '>') AND NOT fenced) AS quotes, count(*) FILTER (contains(s, '⚠') AND regexp_matches(s, '{_GAPS}')) AS n_gaps FROM r GROUP BY ALL),
    a AS (SELECT p.doc_id, p.position AS raw_at, {Q.CHARS.format('c.plain')} AS chars, {Q.count('paragraph', r'\[[^\]]*\]\([ \t]*(?:\.\.?/)*literature/[^)]*\)')} AS links, {Q.count('c.plain', Q.BY_YEAR)} AS by_year, {Q.count('c.plain', Q.BY_NUMBER)} AS by_number,
                 coalesce(qt.quotes, 0) AS quotes, coalesce(qt.n_gaps, 0) AS n_gaps, coalesce(nx.quotes, 0) > 0 AS next_is_quote, c.plain
          FROM p JOIN c USING (doc_id, position) LEFT JOIN qt USING (doc_id, position) LEFT JOIN qt nx ON nx.doc_id = p.doc_id AND nx.position = p.position + 1),
    scan AS MATERIALIZED (SELECT *, links + by_year + by_number AS support, row_number() OVER (PARTITION BY doc_id ORDER BY raw_at)::INT AS position FROM a)"""
_KINDS = "support = 0 AND quotes = 0 AS unsupported, support = 0 AND quotes > 0 AS quote_only"


@query("anchor_scan", f"{_SCAN} SELECT doc_id, position, chars, links, by_year, by_number, quotes, n_gaps, next_is_quote, support, {_KINDS} FROM scan")
def anchor_scan(spark, sf_dir):
    """What supports each paragraph of all manuscripts."""
    return O.anchor_scan(_papers(spark, sf_dir)).withColumn("n_gaps", F.size("gaps").cast("long")).drop("gaps")


@query("anchor_density", f"""{_SCAN} SELECT doc_id, count(*) AS n_paragraphs, count(*) FILTER (support = 0 AND quotes = 0) AS n_unsupported, count(*) FILTER (support = 0 AND quotes > 0) AS n_quote_only, sum(n_gaps)::BIGINT AS n_gaps,
        sum(support)::BIGINT AS support, sum(chars)::BIGINT AS chars, concat_ws(',', CASE WHEN max(links) > 0 THEN 'anchor' END, CASE WHEN max(by_year) > 0 THEN 'author_year' END, CASE WHEN max(by_number) > 0 THEN 'numeric' END, CASE WHEN max(quotes) > 0 THEN 'quote' END) AS forms,
        coalesce(round(sum(support) * 1000.0::DOUBLE / nullif(sum(chars), 0), 2), 0.0) AS density FROM scan GROUP BY doc_id""")  # fmt: skip
def anchor_density(spark, sf_dir):
    """Support of whole manuscripts."""
    return O.density(O.anchor_scan(_papers(spark, sf_dir)))


@query("gap_marks", f"{_SCAN} SELECT doc_id, position, s AS line FROM scan JOIN (SELECT doc_id, position AS raw_at, s FROM r WHERE contains(s, '⚠') AND regexp_matches(s, '{_GAPS}')) USING (doc_id, raw_at)")
def gap_marks(spark, sf_dir):
    """Lines in which a lack of support is marked."""
    return O.gap_marks(O.anchor_scan(_papers(spark, sf_dir)))


_PROSE = f"{_LINES}, {Q.stripped('p', 'l', 'doc_id')}"


@query("word_counts", f"""{_PROSE}, f AS ({Q.words('p', 'doc_id', 'plain', 'function_words', dims.FUNCTION_WORDS)}), h AS ({Q.words('p', 'doc_id', 'plain', 'persons', dims.PERSON_WORDS, dims.PERSON_MASK)}),
    q AS ({Q.words('p', 'doc_id', 'plain', 'quads', dims.QUAD_PHRASES)}) SELECT doc_id, function_words, persons, quads FROM f JOIN h USING (doc_id) JOIN q USING (doc_id)""")  # fmt: skip
def word_counts(spark, sf_dir):
    """Function words, persons and set phrases of all manuscripts."""
    p = _papers(spark, sf_dir).select("doc_id", M.strip_markdown(F.col("text")).alias("t")).filter("t <> ''")
    ship(spark)
    p = p.select("doc_id", O.STYLE(F.col("t")).alias("w"))
    return p.select("doc_id", *[spans.total(F.col(f"w.{n}")).alias(n) for n in ("function_words", "persons", "quads")])


@query("function_word_density", f"""WITH f AS ({Q.words('documents', 'doc_id', "coalesce(text, '')", 'hits', dims.FUNCTION_WORDS)}), c AS (SELECT doc_id, {_CHARS} AS chars FROM documents)
    SELECT doc_id, hits, chars, coalesce(round(hits * 1000.0::DOUBLE / nullif(chars, 0), 2), 0.0) AS density FROM f JOIN c USING (doc_id)""")  # fmt: skip
def function_word_density(spark, sf_dir):
    """Connecting words of all documents for each 1000 characters."""
    t = F.coalesce("text", F.lit(""))
    ship(spark)
    d = _docs(spark, sf_dir).select("doc_id", spans.total(O.STYLE(t)["function_words"]).alias("hits"), X.effective_chars(t).cast("long").alias("chars"))
    return d.withColumn("density", O.per(F.col("hits"), F.col("chars"), 1000))


_END, _CLOSE = "。！？；…!?;.", "」』）》〉】〕)）}”’"
_SPLIT = f"list_filter(list_transform(regexp_extract_all(regexp_replace(plain, '「[^」]*」', '', 'g'), '[^{_END}]*[{_END}]+[{_CLOSE}]*|[^{_END}]+'), lambda x: {Q.CHARS.format('x')}), lambda n: n > 0)"


@query("sentence_stats", f"""{_PROSE}, n AS (SELECT doc_id, {_SPLIT} AS n FROM p) SELECT doc_id, len(n) AS n_sentences, list_sum(n)::BIGINT AS sentence_chars, round(list_avg(n), 2) AS len_mean, round(list_median(n), 2) AS len_median, round(list_stddev_pop(n), 2) AS len_std, len(n) >= 5 AS reliable FROM n""")
def sentence_stats(spark, sf_dir):
    """Sentences of all manuscripts' prose; a quote within one is taken out first, so that SQL can follow."""
    ship(spark)
    p = _papers(spark, sf_dir).select("doc_id", F.regexp_replace(M.strip_markdown(F.col("text")), "「[^」]*」", "").alias("text")).filter("text <> ''")
    return O.sentence_stats(p).drop("at_head", "inside", "at_end")


@query("document_sentences")
def document_sentences(spark, sf_dir):
    """Sentences of all documents and the places of their citations; held against cases in tests."""
    ship(spark)
    return O.sentence_stats(_docs(spark, sf_dir))


_MEASURED = f"""{_LINES}, {Q.sections('s', 'l', 'p')}, {Q.lines('m', 's', 'doc_id, position', 'body')}, {Q.stripped('c', 'm', 'doc_id, position')},
    f AS ({Q.words('c', 'doc_id, position', 'plain', 'fw', dims.FUNCTION_WORDS)}), h AS ({Q.words('c', 'doc_id, position', 'plain', 'pw', dims.PERSON_WORDS, dims.PERSON_MASK)}), q AS ({Q.words('c', 'doc_id, position', 'plain', 'qw', dims.QUAD_PHRASES)}),
    d AS MATERIALIZED (SELECT doc_id, position, section, {Q.CHARS.format('plain')} AS chars, fw, pw, qw FROM c JOIN s USING (doc_id, position) JOIN f USING (doc_id, position) JOIN h USING (doc_id, position) JOIN q USING (doc_id, position)),
    v AS (SELECT doc_id, position, section, coalesce(round(fw * 100.0::DOUBLE / nullif(chars, 0), 2), 0.0) AS function_word_per_100, coalesce(round(pw * 1000.0::DOUBLE / nullif(chars, 0), 2), 0.0) AS person_per_1000, coalesce(round(qw * 1000.0::DOUBLE / nullif(chars, 0), 2), 0.0) AS quad_per_1000 FROM d)"""
_SENTENCE = f"list_filter(list_transform(regexp_extract_all(plain, '[^{_END}]*[{_END}]+[{_CLOSE}]*|[^{_END}]+'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"


def _cited(pattern: str) -> str:
    """Places of a pattern in each sentence: what lies before the i-th match, and its length."""
    return f"""SELECT doc_id, position, size, list_sum(list_transform(g[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS len
        FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, position, size, regexp_extract_all(s, '{pattern}') AS m, regexp_split_to_array(s, '{pattern}') AS g FROM st))"""


_TERMS = f"""tr AS (SELECT doc_id, position, unnest(regexp_extract_all(plain, '[一-鿿]{{2,}}')) AS run, unnest(range(len(regexp_extract_all(plain, '[一-鿿]{{2,}}')))) AS run_at FROM c),
    tk AS (SELECT *, unnest(range(2, least(6, length(run)) + 1)) AS k FROM tr), tg AS (SELECT doc_id, position, run_at, place, substring(run, place, k) AS term FROM (SELECT *, unnest(range(1, length(run) - k + 2)) AS place FROM tk)),
    tc AS MATERIALIZED (SELECT doc_id, position, term, count(*) AS n, min((run_at, place)) AS met FROM tg WHERE term NOT IN ({', '.join(f"'{w}'" for w in (*dims.NOISE_WORDS, *dims.FUNCTION_WORDS, *dims.PERSON_WORDS))})
        AND NOT regexp_matches(term, '^[{dims.TRIM_HEAD}]|[{dims.TRIM_TAIL}]$|{'|'.join(dims.PERSON_WORDS)}') GROUP BY ALL HAVING count(*) >= 3),
    tp AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY length(term) DESC, n DESC, met) AS place FROM tc a
        WHERE NOT EXISTS (SELECT 1 FROM tc b WHERE b.doc_id = a.doc_id AND b.position = a.position AND b.term <> a.term AND contains(b.term, a.term) AND a.n <= b.n)),
    tt AS (SELECT doc_id, position, sum(n)::BIGINT AS terms FROM tp WHERE place <= 20 GROUP BY ALL)"""
_STYLE = f"""{_MEASURED}, {_TERMS}, se AS MATERIALIZED (SELECT doc_id, position, {_SENTENCE} AS ss FROM c),
    st AS MATERIALIZED (SELECT doc_id, position, s, length(regexp_replace(s, '[{_END}{_CLOSE}\\]}}]+$', '')) AS size FROM (SELECT doc_id, position, unnest(ss) AS s FROM se)),
    ci AS (SELECT doc_id, position, CASE WHEN size - a - len <= 2 THEN 2 WHEN a <= 8 OR a <= 0.15 * greatest(1, size) THEN 0 ELSE 1 END AS wh FROM ({_cited(Q.BY_YEAR)} UNION ALL {_cited(Q.BY_NUMBER)})),
    cc AS (SELECT doc_id, position, count(*) FILTER (wh = 0) AS at_head, count(*) FILTER (wh = 1) AS inside, count(*) FILTER (wh = 2) AS at_end FROM ci GROUP BY ALL),
    sn AS (SELECT doc_id, position, len(ss) AS n_sentences, list_filter(list_transform(ss, lambda x: {Q.CHARS.format('x')}), lambda n: n > 0) AS n FROM se),
    style AS MATERIALIZED (SELECT doc_id, position::INT AS position, section, chars, n_sentences::INT AS n_sentences, list_sum(n)::BIGINT AS sentence_chars, round(list_avg(n), 2) AS len_mean, round(list_median(n), 2) AS len_median, round(list_stddev_pop(n), 2) AS len_std, n_sentences >= 5 AS reliable,
        coalesce(at_head, 0) AS at_head, coalesce(inside, 0) AS inside, coalesce(at_end, 0) AS at_end, fw AS function_words, pw AS persons, qw AS quads, coalesce(terms, 0) AS terms, function_word_per_100, person_per_1000, quad_per_1000,
        coalesce(round(coalesce(terms, 0) * 100.0::DOUBLE / nullif(chars, 0), 2), 0.0) AS term_density_per_100, coalesce(round(at_end / nullif(at_head + inside + at_end, 0), 4), 0.0)::DOUBLE AS citation_end_ratio
        FROM d JOIN v USING (doc_id, position, section) JOIN sn USING (doc_id, position) LEFT JOIN cc USING (doc_id, position) LEFT JOIN tt USING (doc_id, position))"""
_TOPS = ("function_word_top", "quad_top", "term_top", "person_counts", "term_source")


@query("section_style", f"{_STYLE} SELECT * FROM style")
def section_style(spark, sf_dir):
    """The style of each section of all manuscripts."""
    ship(spark)
    return O.measure_sections(_papers(spark, sf_dir)).drop(*_TOPS)


@query("feature_order", f"""{_STYLE}, x AS ({' UNION ALL '.join(f"SELECT doc_id, position, section, '{n}' AS feature, {k} AS o, {n}::DOUBLE AS v FROM style" for k, n in enumerate(O.FEATURES))}),
    y AS (SELECT doc_id, feature, o, min(v) AS least, max(v) AS most, avg(v) AS mean, stddev_pop(v) AS deviation, coalesce(round(stddev_pop(v) / nullif(avg(v), 0), 4), 0.0) AS cv, arg_min(section, (v, position)) AS least_in, arg_min(section, (-v, position)) AS most_in FROM x GROUP BY doc_id, feature, o HAVING count(*) >= 2)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY cv DESC, o))::INT AS place, feature, round(least, 4) AS least, round(most, 4) AS most, round(most - least, 4) AS range, round(mean, 4) AS mean, round(deviation, 4) AS deviation, cv, least_in, most_in FROM y""")  # fmt: skip
def feature_order(spark, sf_dir):
    """All eight features over the sections of each manuscript, in the order of their variation."""
    ship(spark)
    return O.compare_sections(O.measure_sections(_papers(spark, sf_dir)), ["doc_id"], "section", "position")


_COMPARED = ("function_word_per_100", "person_per_1000", "quad_per_1000")


@query("section_compare", f"""{_MEASURED}, x AS ({' UNION ALL '.join(f"SELECT doc_id, position, section, '{n}' AS feature, {n} AS v FROM v" for n in _COMPARED)})
    SELECT doc_id, feature, round(min(v), 4) AS least, round(max(v), 4) AS most, round(max(v) - min(v), 4) AS range, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation,
           coalesce(round(stddev_pop(v) / nullif(avg(v), 0), 4), 0.0) AS cv, arg_min(section, (v, position)) AS least_in, arg_min(section, (-v, position)) AS most_in FROM x GROUP BY ALL HAVING count(*) >= 2""")  # fmt: skip
def section_compare(spark, sf_dir):
    """Three features of style over the sections of each manuscript."""
    ship(spark)
    return O.compare_sections(O.measure_sections(_papers(spark, sf_dir)), ["doc_id"], "section", "position", _COMPARED).drop("place")


def _top_sql(listed: tuple[str, ...]) -> str:
    """Counts of each listed word by itself, as SQL: the rest of the text is what longer words leave."""
    sql, before = "", "plain"
    parts = []
    for k, w in enumerate(sorted(listed, key=len, reverse=True)):
        parts.append(f"SELECT doc_id, position, '{w}' AS word, {k} AS o, (length({before}) - length(replace({before}, '{w}', ''))) // {len(w)} AS n FROM c")
        before = f"replace({before}, '{w}', repeat(chr(1), {len(w)}))"
    return " UNION ALL ".join(parts)


_TOP5 = "(SELECT doc_id, position, string_agg(word || ':' || n, ',' ORDER BY n DESC, o) AS top FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, position ORDER BY n DESC, o) AS r FROM ({}) WHERE n > 0) WHERE r <= {} GROUP BY ALL)"


@query("section_tops", f"""{_MEASURED}, {_TERMS} SELECT c.doc_id, c.position::INT AS position, coalesce(qt.top, '') AS quad_top, coalesce(tm.top, '') AS term_top, 'repeats' AS term_source FROM c
    LEFT JOIN {_TOP5.format(_top_sql(dims.QUAD_PHRASES), 5)} qt USING (doc_id, position) LEFT JOIN {_TOP5.format("SELECT doc_id, position, term AS word, place AS o, n FROM tp WHERE place <= 20", 8)} tm USING (doc_id, position)""")  # fmt: skip
def section_tops(spark, sf_dir):
    """The most frequent set phrases and likely terms of each section; function words are held against cases in tests."""
    ship(spark)
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["word"], F.lit(":"), x["n"].cast("string"))), ",")
    return O.measure_sections(_papers(spark, sf_dir)).select("doc_id", "position", said("quad_top").alias("quad_top"), said("term_top").alias("term_top"), "term_source")


@query("terms_by_glossary", f"""{_PROSE}, gl AS (SELECT p_partkey AS doc_id, unnest(['深度学习', '模型', p_type, '学习模型']) AS term FROM part WHERE p_size % 2 = 0),
    m1 AS (SELECT p.doc_id, plain, term FROM p JOIN gl USING (doc_id)), long AS (SELECT doc_id, plain, replace(replace(plain, '学习模型', repeat(chr(1), 4)), '深度学习', repeat(chr(1), 4)) AS left_over FROM p)
    SELECT doc_id, term, ((length(x) - length(replace(x, term, ''))) // length(term))::BIGINT AS n
    FROM (SELECT doc_id, term, CASE WHEN term = '模型' THEN left_over WHEN term = '深度学习' THEN replace(plain, '学习模型', repeat(chr(1), 4)) ELSE plain END AS x FROM m1 JOIN long USING (doc_id, plain)) WHERE contains(x, term)""")  # fmt: skip
def terms_by_glossary(spark, sf_dir):
    """Terms of the manuscripts that have a glossary, each with its own words."""
    ship(spark)
    papers = _papers(spark, sf_dir).select("doc_id", M.strip_markdown(F.col("text")).alias("text"))
    words = F.array(F.lit("深度学习"), F.lit("模型"), F.col("p_type"), F.lit("学习模型"))
    glossary = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size % 2 = 0").select(F.col("p_partkey").alias("doc_id"), F.explode(words).alias("term"))
    return O.listed_terms(O.glossary_terms(papers, glossary, ["doc_id"]), ["doc_id"]).select("doc_id", "term", "n")


@query("clean_markup", r"""WITH v AS (SELECT p_partkey AS id, p_name AS n, p_size AS k FROM part)
    SELECT id, CASE k % 8 WHEN 0 THEN 'Background: About ' || n || '. Methods: p < 0.05 & more' WHEN 1 THEN 'About ' || n || ' and after' WHEN 2 THEN 'P < .001 in ' || n WHEN 3 THEN 'p < 0.05 with unclosed ' || n
           WHEN 4 THEN NULL WHEN 5 THEN 'plain text of ' || n WHEN 6 THEN '摘要说 ' || n ELSE 'x“y” ' || n END AS text FROM v""")  # fmt: skip
def clean_markup(spark, sf_dir):
    """Abstracts in eight shapes of markup as plain text."""
    ship(spark)
    p, n = spark.read.parquet(f"{sf_dir}/part.parquet"), F.col("p_name")
    shapes = [
        ("<jats:title>Abstract</jats:title><jats:sec><jats:title>Background</jats:title><jats:p>About ", ".</jats:p></jats:sec><jats:sec><jats:title>Methods</jats:title><jats:p>p &lt; 0.05 &amp;amp; more</jats:p></jats:sec>"),
        ("<ns3:p>About <b>", "</b></ns3:p> and after"), ("<p>Abstract: P &amp;lt; .001 in ", "</p>"), ("p < 0.05 with unclosed <jats:bold>", ""),
        ("<jats:p>.</jats:p><!--", "-->"), ("plain text of ", ""), ("<p>摘要： 摘要说 ", "</p>"), ("&lt;p&gt;x&ldquo;y&rdquo; ", "&lt;/p&gt;"),
    ]
    raw = F.lit(None).cast("string")
    for k, (a, b) in enumerate(shapes):
        raw = F.when(F.col("p_size") % 8 == k, F.concat(F.lit(a), n, F.lit(b))).otherwise(raw)
    return p.select(F.col("p_partkey").alias("id"), clean_jats(raw).alias("text"))


@query("cleaned_pages")
def cleaned_pages(spark, sf_dir):
    """Text of all pages without markup; held against cases in tests."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", clean_jats("html").alias("text"))


_DOC_TERMS = _TERMS.replace("doc_id, position", "doc_id").replace("b.position = a.position AND ", "").replace("FROM c)", "FROM p)")


@query("term_counts", f"{_PROSE}, {_DOC_TERMS} SELECT doc_id, (place - 1)::INT AS place, term, n FROM tp WHERE place <= 20")
def term_counts(spark, sf_dir):
    """Likely terms of all manuscripts."""
    prose = _papers(spark, sf_dir).select("doc_id", M.strip_markdown(F.col("text")).alias("text"))
    return O.listed_terms(O.likely_terms(prose, ["doc_id"]), ["doc_id"])


@query("term_candidates", f"""{_PROSE}, r AS (SELECT doc_id, unnest(regexp_extract_all(plain, '[一-鿿]{{2,}}')) AS run FROM p), k AS (SELECT doc_id, run, unnest(range(2, least(6, length(run)) + 1)) AS k FROM r),
    g AS (SELECT doc_id, substring(run, unnest(range(1, length(run) - k + 2)), k) AS term FROM k)
    SELECT doc_id, term, count(*) AS n FROM g WHERE term = '深度学习模型' GROUP BY ALL HAVING count(*) >= 3""")  # fmt: skip
def term_candidates(spark, sf_dir):
    """The longest likely term of each manuscript."""
    return term_counts(spark, sf_dir).filter("place = 0").select("doc_id", "term", "n")


@query("restore_abstract", r"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents)
    SELECT doc_id, array_to_string(w, ' ') AS abstract FROM w WHERE len(w) > 0""")  # fmt: skip
def restore_abstract(spark, sf_dir):
    """Inverted indexes of all documents, read back as texts."""
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("([a-z]+)"), 1)
    at = _docs(spark, sf_dir).select("doc_id", F.posexplode(words).alias("at", "word"))
    lists = at.groupBy("doc_id", "word").agg(F.collect_list("at").alias("at"))
    index = lists.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "at"))).alias("index"))
    return index.select("doc_id", X.restore_abstract(F.col("index")).alias("abstract"))


def _html_inline(c: str) -> str:
    for sign, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = f"replace({c}, '{sign}', '{to}')"
    for pattern, to in ((r"`([^`]+)`", r"<code>\1</code>"), (r"\*\*([^*]+)\*\*", r"<strong>\1</strong>"), (r"\[([^\]]*)\]\(((?:https?|mailto):[^)\s]*|[#./][^)\s]*)\)", r'<a href="\2">\1</a>'), (r"\[([^\]]*)\]\([^)]*\)", r"\1")):
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


_ROW_CELLS = "list_transform(string_split(regexp_replace(s, '^[|]+|[|]+$', '', 'g'), '|'), lambda x: '<{0}>' || " + _html_inline("trim(x)") + " || '</{0}>')"
_HTML = f"""{duck('v_manuscripts')}, a AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS i FROM v_manuscripts), b AS (SELECT *, trim(raw) AS s FROM a),
    c AS (SELECT *, sum(starts_with(s, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM b),
    k AS (SELECT *, CASE WHEN starts_with(s, '```') THEN CASE WHEN f % 2 = 1 THEN 'open' ELSE 'shut' END WHEN f % 2 = 1 THEN 'code' WHEN starts_with(s, '>') THEN 'quote' WHEN regexp_matches(s, '^[|].*[|]$') THEN 'row' WHEN regexp_matches(s, '^[-*+]\\s') THEN 'item' ELSE 'alone' END AS kind FROM c),
    n AS (SELECT *, coalesce(lag(kind) OVER w, '') AS before, coalesce(lead(kind) OVER w, '') AS after FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    h AS (SELECT doc_id, i, CASE kind WHEN 'open' THEN '<pre><code>' WHEN 'shut' THEN '</code></pre>' WHEN 'code' THEN replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10)
        WHEN 'quote' THEN CASE WHEN before <> 'quote' THEN '<blockquote>' ELSE '' END || '<p>' || {_html_inline("regexp_replace(s, '^> ?', '')")} || '</p>' || CASE WHEN after <> 'quote' THEN '</blockquote>' ELSE '' END
        WHEN 'row' THEN CASE WHEN before <> 'row' THEN '<table><thead><tr>' || array_to_string({_ROW_CELLS.format('th')}, '') || '</tr></thead><tbody>' WHEN regexp_matches(s, '^[-|: ]+$') THEN '' ELSE '<tr>' || array_to_string({_ROW_CELLS.format('td')}, '') || '</tr>' END || CASE WHEN after <> 'row' THEN '</tbody></table>' ELSE '' END
        WHEN 'item' THEN CASE WHEN before <> 'item' THEN '<ul>' ELSE '' END || '<li>' || {_html_inline("regexp_replace(s, '^[-*+]\\s+', '')")} || '</li>' || CASE WHEN after <> 'item' THEN '</ul>' ELSE '' END
        ELSE CASE WHEN regexp_matches(s, '^#{{1,6}}\\s') THEN '<h' || length(regexp_extract(s, '^(#+)', 1)) || '>' || {_html_inline("regexp_replace(s, '^#+\\s+', '')")} || '</h' || length(regexp_extract(s, '^(#+)', 1)) || '>'
            WHEN starts_with(s, '⚠') OR contains(s, '不等于') THEN '<div class="notice">' || {_html_inline('s')} || '</div>' WHEN s = '' OR starts_with(s, '---') THEN '' ELSE '<p>' || {_html_inline('s')} || '</p>' END END AS h FROM n)"""


@query("html_blocks", f"{_HTML} SELECT doc_id, string_agg(h, '' ORDER BY i) AS html FROM h GROUP BY doc_id")
def html_blocks(spark, sf_dir):
    """All manuscripts as HTML."""
    ship(spark)
    return _papers(spark, sf_dir).select("doc_id", html_of("text").alias("html"))


@query("tex_check", f"""{duck('v_manuscripts')}, t AS (SELECT doc_id, regexp_replace(text, '[^一-鿿]', '', 'g') AS a FROM v_manuscripts)
    SELECT doc_id, doc_id % 3 = 0 AS ok, CASE WHEN doc_id % 3 = 0 THEN 'substring' ELSE 'exact' END AS mode, CASE WHEN doc_id % 3 <> 0 THEN (CASE WHEN doc_id % 3 = 1 THEN 4 ELSE length(a) + 1 END)::INT END AS at FROM t""")  # fmt: skip
def tex_check(spark, sf_dir):
    """Whether typeset manuscripts still have their CJK signs: with more behind them, or with one changed or added."""
    a = F.regexp_replace("text", "[^一-鿿]", "")
    made = F.when(F.col("doc_id") % 3 == 1, F.concat(F.substring(a, F.lit(1), F.lit(3)), F.lit("異"), F.substring(a, F.lit(5), F.length(a)))).otherwise(F.concat(F.lit("\\section{"), a, F.lit("} 参")))
    checked = notes.tex_check(F.regexp_replace("text", "<!--[^-]*-->", ""), made, F.col("doc_id") % 3 == 0)
    return _papers(spark, sf_dir).select("doc_id", checked.alias("c")).select("doc_id", "c.ok", "c.mode", "c.at")
