"""Bibliographic inputs derived from the plain tables, in SQL that both engines read.

Real inputs are hits, references, ledgers and the like; these views give the
registered queries such rows from the tables at hand. Row-wise projections and one
equi-join only, so they prune and push down like the tables themselves.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from citeloom.session import dealt

_ORD = (
    "md5(concat_ws('|', cast(l_orderkey as string), cast(l_linenumber as string), cast(l_partkey as string), cast(l_suppkey as string), "
    "cast(cast(round(l_quantity) as bigint) as string), cast(cast(round(l_extendedprice * 100) as bigint) as string), "
    "cast(cast(l_shipdate as date) as string), l_returnflag, l_linestatus))"
)
_SOURCE = "CASE l_suppkey % 7 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' WHEN 2 THEN 'semantic_scholar' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'pubmed' WHEN 5 THEN 'eric' ELSE 'doi_meta' END"

_FIRST = "concat(upper(substring(p_name, 1, 1)), substring(split_part(p_name, ' ', 1), 2, 20))"
_LAST = "concat('M', lower(p_type), 'son')"

_NL = "chr(10)"

VIEWS = {
    "v_hits": f"""
        SELECT {_ORD} AS ord, {_SOURCE} AS source,
               CASE l_linenumber % 4 WHEN 0 THEN NULL WHEN 1 THEN concat('10.5555/P', cast(l_partkey as string))
                    WHEN 2 THEN concat('https://doi.org/10.5555/p', cast(l_partkey as string))
                    ELSE concat(' DOI:10.5555/p', cast(l_partkey as string), ' ') END AS doi,
               concat(p_name, CASE l_linenumber % 3 WHEN 0 THEN '. ' WHEN 1 THEN ' - ' ELSE ' ' END, p_brand, ' ', cast(l_partkey as string)) AS title,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE cast(year(l_shipdate) as int) END AS year,
               CASE WHEN l_suppkey % 7 = 3 THEN cast(l_shipdate as date) END AS date,
               p_type AS venue,
               CASE l_orderkey % 5 WHEN 0 THEN 'Journal-Article' WHEN 1 THEN 'article' WHEN 2 THEN 'proceedings-article' WHEN 3 THEN 'posted-content' ELSE 'dataset' END AS type,
               CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE cast(round(l_quantity) as bigint) END AS cited_by_count,
               CASE l_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE concat(' About ', p_type, ' ', cast(l_orderkey as string), ' ') END AS abstract,
               CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linestatus = 'O' THEN 'gold' ELSE 'green' END AS oa_status,
               CASE WHEN l_returnflag = 'A' THEN concat('https://oa.example/', cast(l_orderkey as string)) END AS oa_url,
               CASE l_linenumber % 3 WHEN 0 THEN 'publishedVersion' WHEN 1 THEN 'acceptedVersion' ELSE 'submittedVersion' END AS oa_version,
               l_partkey AS work_id, l_orderkey AS batch_id, cast(cast(floor(l_quantity) as bigint) % 4 as int) AS n_people, cast(cast(floor(l_extendedprice) as bigint) % 3 as int) AS n_orcids,
               CASE l_linenumber % 5 WHEN 0 THEN 'references' WHEN 1 THEN 'cited_by' ELSE NULL END AS direction
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey""",
    "v_edges": """
        SELECT DISTINCT l_orderkey AS src_id, l_partkey AS dst_id, CASE l_suppkey % 2 WHEN 0 THEN 'openalex' ELSE 'semantic_scholar' END AS source,
               CASE WHEN p_size > 45 THEN NULL WHEN p_size > 43 THEN ' ' ELSE p_name END AS title
        FROM {lineitem} JOIN {part} ON l_partkey = p_partkey""",
    "v_names": f"""
        SELECT p_partkey AS id, CASE p_size % 4 WHEN 0 THEN concat({_FIRST}, ' ', {_LAST}) WHEN 1 THEN concat({_LAST}, ', ', {_FIRST}, ' K.')
               WHEN 2 THEN concat({_LAST}, ' ', upper(substring(p_name, 1, 1)), 'K') ELSE concat(upper(substring(p_name, 1, 1)), '. ', {_LAST}, '-', {_FIRST}) END AS name
        FROM {{part}}""",
    "v_refs": f"""
        SELECT p_partkey AS ref_id,
               CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 5 THEN concat('10.9999/x', cast(p_partkey as string)) ELSE concat('10.5555/p', cast(p_partkey as string)) END AS doi,
               CASE WHEN p_partkey % 13 = 0 THEN 'Unrelated heading entirely' WHEN p_partkey % 17 = 0 AND p_partkey % 6 = 0 THEN '深度学习综述'
                    ELSE concat(p_name, ': ', p_brand, ' ', cast(p_partkey as string)) END AS title,
               cast(1996 + p_partkey % 5 as int) AS year,
               p_type AS venue,
               CASE WHEN p_partkey % 29 = 0 THEN 'unparsed' ELSE 'ok' END AS parse_status,
               CASE p_partkey % 7 WHEN 0 THEN 'Crossref' WHEN 1 THEN 'DataCite' WHEN 2 THEN 'ISTIC' WHEN 3 THEN 'CNKI' WHEN 4 THEN 'not_registered' WHEN 5 THEN 'unknown' ELSE NULL END AS doi_ra,
               p_partkey % 97 = 0 AS manual_verified,
               CASE WHEN p_size % 10 = 0 THEN '' ELSE concat({_LAST}, ', ', {_FIRST}) END AS author
        FROM {{part}}""",
    "v_evidence": f"""
        SELECT l_partkey AS ref_id, CASE WHEN l_tax > 0.06 THEN p_type WHEN l_tax > 0.04 THEN concat(p_name, ' ', p_brand) ELSE concat(p_name, ' ', p_brand, ' ', cast(l_partkey as string)) END AS title,
               concat('10.5555/p', cast(l_partkey as string)) AS doi, cast(year(l_shipdate) as int) AS year, p_type AS venue,
               md5(concat(cast(l_orderkey as string), '|', cast(l_linenumber as string), '|', cast(l_suppkey as string), '|', cast(cast(l_shipdate as date) as string), '|', cast(cast(round(l_extendedprice * 100) as bigint) as string))) AS ord,
               l_orderkey % 200 = 0 AS retracted, l_linenumber % 2 = 0 AS retraction_dated, CASE l_suppkey % 2 WHEN 0 THEN 'crossref' ELSE 'openalex' END AS source,
               CASE l_linenumber % 4 WHEN 0 THEN concat({_FIRST}, ' ', {_LAST}) WHEN 1 THEN concat({_LAST}, ' ', upper(substring(p_name, 1, 1)), 'K') WHEN 2 THEN 'Someone Else' ELSE concat({_LAST}, ', ', upper(substring(p_name, 1, 1)), '.') END AS author
        FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey WHERE l_quantity < 3""",
    "v_prefixes": """
        SELECT DISTINCT concat('10.', cast(5000 + p_size as string)) AS prefix, CASE p_size % 6 WHEN 0 THEN 'Crossref' WHEN 1 THEN 'DataCite' WHEN 2 THEN 'ISTIC' WHEN 3 THEN 'mEDRA' ELSE NULL END AS agency,
               CASE p_size % 6 WHEN 5 THEN 'TIMEOUT' ELSE NULL END AS error
        FROM {part} WHERE p_size % 7 <> 0""",
    "v_cited": "SELECT l_partkey AS key, cast(min(year(l_shipdate)) as int) AS year FROM {lineitem} WHERE l_quantity < 4 GROUP BY l_partkey",
    "v_imported": "SELECT l_partkey AS key, cast(min(year(l_shipdate)) as int) AS year FROM {lineitem} WHERE l_quantity > 46 GROUP BY l_partkey",
    "v_queries": """
        SELECT l_partkey AS ref_id, CASE l_suppkey % 3 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' ELSE 'arxiv' END AS source,
               CASE WHEN l_quantity < 3 THEN 'hit' WHEN l_orderkey % 10 = 0 THEN 'error' ELSE 'miss' END AS outcome,
               CASE WHEN l_orderkey % 10 = 0 AND l_quantity >= 3 THEN CASE l_orderkey % 3 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'CONN_FAILED' ELSE 'SERVER_ERROR' END END AS error,
               l_linenumber % 2 = 0 AS from_cache
        FROM {lineitem}""",
    "v_authors": """
        SELECT c_custkey AS ord, CASE c_custkey % 2 WHEN 0 THEN 'openalex' ELSE 'semantic_scholar' END AS source,
               concat('Author ', cast(c_custkey % 400 as string)) AS name, concat('A', cast(c_custkey as string)) AS entity_id,
               CASE WHEN c_custkey % 3 = 0 THEN concat('https://orcid.org/0000-0001-', lpad(cast(c_custkey % 50 as string), 4, '0'), '-000x') END AS orcid,
               cast(abs(round(c_acctbal)) as bigint) AS works_count, c_mktsegment AS affiliation, concat('topic ', cast(c_nationkey as string)) AS topic, c_custkey % 4 = 0 AS exact_name_match
        FROM {customer}""",
    "v_ledger": """
        SELECT o_orderkey AS seq,
               CASE WHEN o_orderkey % 10 = 0 THEN '重复#1' WHEN o_orderkey % 97 = 0 THEN '保留?' ELSE '保留' END AS dedup,
               CASE o_orderkey % 8 WHEN 0 THEN '排除' WHEN 1 THEN '待定' WHEN 2 THEN '' ELSE '进入全文' END AS ta_screen,
               CASE o_custkey % 6 WHEN 0 THEN '排除' WHEN 1 THEN '全文不可得' WHEN 2 THEN '待定' WHEN 3 THEN '' ELSE '纳入' END AS ft_screen,
               CASE WHEN o_custkey % 6 = 0 AND o_orderkey % 7 <> 0 THEN substring(o_orderpriority, 1, 1) ELSE '' END AS exclude_code
        FROM {orders}""",
    "v_trace": """
        SELECT event_id, cast(ts as date) AS day, CASE event_type WHEN 'click' THEN 'find' WHEN 'view' THEN 'read' WHEN 'purchase' THEN 'check' WHEN 'signup' THEN 'draft' ELSE 'other' END AS command
        FROM {events}""",
    "v_manuscripts": f"""
        SELECT p_partkey AS doc_id, concat(
            CASE WHEN p_size % 5 = 0 THEN concat('---', {_NL}, 'title: ', p_name, {_NL}, '---', {_NL}) ELSE '' END,
            CASE WHEN p_size % 3 = 0 THEN concat('# ', p_name, {_NL}) ELSE '' END,
            CASE WHEN p_size % 4 = 0 THEN concat('Lead words of **', p_brand, '** come first.', {_NL}, {_NL}) ELSE '' END,
            '## 背景', {_NL}, {_NL}, '值得注意的是，本文讨论', p_type, '的深度学习模型。深度学习模型很强（张三，20', lpad(cast(p_size as string), 2, '0'), '）。我们认为深度学习模型有用；其中', cast(p_partkey as string), '项重要意义。', {_NL}, {_NL},
            '> 「深度学习模型。」', {_NL}, '> more of it', {_NL}, {_NL},
            CASE WHEN p_size % 2 = 0 THEN concat('- See [Smith](../literature/n.md#s) for `code` and ~~gone~~ work.', {_NL}, '- Next item_here [1,2]', {_NL}, {_NL}) ELSE concat('因此，没有引用的一段。', {_NL}, ' ', {_NL}) END,
            CASE WHEN p_size % 7 = 0 THEN concat('```text', {_NL}, '# no head', {_NL}, {_NL}, '> no quote', {_NL}, '```', {_NL}, {_NL}) ELSE '' END,
            CASE WHEN p_size % 6 = 0 THEN concat('<!-- hidden', {_NL}, 'for [3] now -->', {_NL}, {_NL}) ELSE '' END,
            '## ', p_brand, {_NL}, '| a | b |', {_NL}, '|---|---|', {_NL}, {_NL}, '⚠️ 未经文献支撑（锚点 Lee 2024）', p_name, '还需核对。', {_NL}, {_NL}, {_NL},
            CASE WHEN p_size % 8 = 1 THEN concat('⚠️ 另一警示 ![p](q.png) 结束', {_NL}) ELSE '' END, '[^1]: a source. 2020.', {_NL}, 'The end of ', p_name, ' (Lee, 20', lpad(cast(p_size as string), 2, '0'), ') is [', cast(p_size as string), '] here.') AS text
        FROM {{part}}""",
    "v_crossref": f"""
        SELECT p_partkey AS id, concat('{{{{"title":["', p_name, '"],"DOI":"10.5555/P', cast(p_partkey as string), '","type":"journal-article","issued":{{{{"date-parts":[[', cast(1990 + p_size % 30 as string), ',3]]}}}},',
            '"container-title":[', CASE WHEN p_size % 3 = 0 THEN '' ELSE concat('"', p_type, '"') END, '],"abstract":"<jats:p>About ', p_name, '</jats:p>",',
            CASE WHEN p_size % 4 = 0 THEN '' ELSE concat('"is-referenced-by-count":', cast(p_size as string), ',') END,
            '"author":[{{{{"given":"', {_FIRST}, '","family":"', {_LAST}, '"', CASE WHEN p_size % 2 = 0 THEN concat(',"ORCID":"http://orcid.org/0000-0001-2345-', lpad(cast(p_size as string), 3, '0'), 'x","authenticated-orcid":true') ELSE '' END,
            ',"affiliation":[', CASE WHEN p_size % 5 = 0 THEN '{{{{"name":"Univ"}}}},{{{{"name":""}}}}' ELSE '' END, ']}}}},{{{{"name":"A Group"}}}}]',
            CASE p_size % 6 WHEN 0 THEN ',"updated-by":[{{{{"type":"correction","label":"Correction"}}}},{{{{"type":"retraction","label":"Retraction","source":"retraction-watch","DOI":"10.1/n","updated":{{{{"date-parts":[[2010,2,6]]}}}}}}}}]'
                            WHEN 1 THEN ',"update-to":[{{{{"type":"retraction","label":"Retraction"}}}}]' ELSE '' END, '}}}}') AS payload
        FROM {{part}}""",
    "v_openalex": f"""
        SELECT p_partkey AS id, concat('{{{{"id":"https://openalex.org/W', cast(p_partkey as string), '","doi":"https://doi.org/10.5555/P', cast(p_partkey as string), '","display_name":"', p_name, '","publication_year":', cast(1990 + p_size % 30 as string), ',"type":"article",',
            '"cited_by_count":', cast(p_size as string), ',"is_retracted":', CASE WHEN p_size % 6 = 0 THEN 'true' ELSE 'false' END, ',"primary_location":{{{{"source":', CASE WHEN p_size % 3 = 0 THEN 'null' ELSE concat('{{{{"display_name":"', p_type, '"}}}}') END, '}}}},',
            '"abstract_inverted_index":{{{{"about":[1],"All":[0],"it":[2,4],"and":[3]}}}},"referenced_works":["https://openalex.org/W1","https://openalex.org/W', cast(p_size as string), '"],',
            '"authorships":[{{{{"author":{{{{"display_name":"', {_FIRST}, ' ', {_LAST}, '","orcid":', CASE WHEN p_size % 2 = 0 THEN concat('"https://orcid.org/0000-0001-2345-', lpad(cast(p_size as string), 3, '0'), 'x"') ELSE 'null' END, '}}}},"institutions":[]}}}},{{{{"author":{{{{"display_name":null}}}},"institutions":[{{{{"display_name":"Univ"}}}}]}}}}]',
            CASE p_size % 5 WHEN 0 THEN '' WHEN 1 THEN ',"open_access":{{{{"oa_status":"closed","oa_url":null}}}}' WHEN 2 THEN ',"open_access":{{{{"oa_status":"gold","oa_url":"http://o"}}}},"best_oa_location":{{{{"pdf_url":"http://p","landing_page_url":"http://l","version":"publishedVersion","license":"cc-by","source":{{{{"type":"journal"}}}}}}}}'
                WHEN 3 THEN ',"open_access":{{{{"oa_status":"green","oa_url":"http://o"}}}},"best_oa_location":{{{{"pdf_url":null,"landing_page_url":"http://l","version":"submittedVersion","source":{{{{"type":"repository"}}}}}}}}' ELSE ',"open_access":{{{{"oa_status":"bronze","oa_url":"http://o"}}}}' END, '}}}}') AS payload
        FROM {{part}}""",
    "v_scholar": f"""
        SELECT p_partkey AS id, concat('{{{{"paperId":"x","title":"', p_name, '","year":', cast(1990 + p_size % 30 as string), ',"venue":"', CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END, '","externalIds":{{{{', CASE WHEN p_size % 2 = 0 THEN concat('"DOI":"10.5555/P', cast(p_partkey as string), '"') ELSE '' END, '}}}},',
            '"authors":[{{{{"name":"', {_FIRST}, ' ', {_LAST}, '"}}}},{{{{"name":""}}}}],"publicationTypes":', CASE WHEN p_size % 4 = 0 THEN 'null' ELSE '["JournalArticle","Review"]' END, ',"citationCount":', CASE WHEN p_size % 5 = 0 THEN 'null' ELSE cast(p_size as string) END, ',"abstract":""}}}}') AS payload
        FROM {{part}}""",
    "v_edges_page": """
        SELECT p_partkey AS id, concat('{{"data":[{{"citedPaper":{{"paperId":null}}}},{{"citedPaper":{{"title":"T', cast(p_size as string), '","year":2001}}}},{{"citedPaper":{{"title":""}}}},{{"citedPaper":{{"title":"U"}}}}]}}') AS payload
        FROM {part}""",
    "v_eric": f"""
        SELECT p_partkey AS id, concat('{{{{"title":"', p_name, '","author":["', {_LAST}, ', ', {_FIRST}, '"],"publicationdateyear":', cast(1990 + p_size % 30 as string), ',"publication":"', p_type, '"', CASE WHEN p_size % 2 = 0 THEN ',"publicationtype":["Journal Articles","Reports"]' ELSE '' END, '}}}}') AS payload
        FROM {{part}}""",
    "v_csl": f"""
        SELECT p_partkey AS id, concat('{{{{"title":', CASE WHEN p_size % 2 = 0 THEN concat('"&#x201C;', p_name, '&#x201D;"') ELSE concat('["', p_name, '"]') END, ',"DOI":"10.5555/P', cast(p_partkey as string), '","type":"article-journal","container-title":"A &amp; B",',
            '"author":[{{{{"given":"宋长青"}}}},{{{{"literal":"A Group"}}}},{{{{"given":"', {_FIRST}, '","family":"', {_LAST}, '"}}}}],"issued":{{{{"date-parts":[[', CASE p_size % 3 WHEN 0 THEN '"2015"' WHEN 1 THEN '2016' ELSE '"n.d."' END, ']]}}}},"abstract":"<p id=C2>x &lt; ', p_name, '</p>"}}}}') AS payload
        FROM {{part}}""",
    "v_atom": f"""
        SELECT p_partkey AS id, concat('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom"><entry><id>http://arxiv.org/abs/1706.0', cast(p_size as string), 'v5</id><title>Size ', cast(p_size as string), '</title><summary>  Two', {_NL}, '   lines </summary>',
            '<published>', CASE WHEN p_size % 4 = 0 THEN '2017' ELSE concat('20', lpad(cast(p_size as string), 2, '0'), '-06-12T17:57:34Z') END, '</published><author><name>Ann Lee</name></author><author><name> Bo </name></author>', CASE WHEN p_size % 2 = 0 THEN '<arxiv:doi>10.5555/ARX</arxiv:doi>' ELSE '' END,
            CASE WHEN p_size % 3 = 0 THEN '<link title="pdf" href="http://arxiv.org/pdf/x" rel="related"/>' ELSE '<link href="http://arxiv.org/abs/x" rel="alternate"/>' END, '<arxiv:primary_category term="cs.CL"/></entry><entry><id>http://arxiv.org/abs/2001.1v1</id><title>Second</title></entry></feed>') AS payload
        FROM {{part}}""",
    "v_pubmed": f"""
        SELECT p_partkey AS id, concat('{{{{"result":{{{{"uids":["', cast(p_partkey as string), '"],"', cast(p_partkey as string), '":{{{{"title":"', p_name, '","authors":[{{{{"name":"', {_LAST}, ' AJ"}}}}],"pubdate":"', CASE WHEN p_size % 4 = 0 THEN 'Spring' ELSE concat(cast(1990 + p_size % 30 as string), ' Jul') END, '","fulljournalname":"', p_type, '",',
            '"articleids":[', CASE WHEN p_size % 2 = 0 THEN concat('{{{{"idtype":"doi","value":"10.5555/P', cast(p_partkey as string), '"}}}},') ELSE '' END, CASE WHEN p_size % 3 = 0 THEN '{{{{"idtype":"pmc","value":"PMC77"}}}},' ELSE '' END, '{{{{"idtype":"pmcid","value":"pmc-id: PMC77;"}}}}],"pubtype":["Clinical Trial"', CASE WHEN p_size % 7 = 0 THEN ',"Retracted Publication"' ELSE '' END, ']}}}}}}}}}}}}') AS payload
        FROM {{part}}""",
    "v_pubmed_xml": """
        SELECT p_partkey AS id, concat('<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID Version="1">', cast(p_partkey as string), '</PMID><Article><Abstract>', CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN concat('<AbstractText>Of <i>', p_name, '</i> &lt; all</AbstractText>') ELSE '<AbstractText Label="METHODS">We did.</AbstractText><AbstractText NlmCategory="RESULTS"> It  was. </AbstractText>' END, '</Abstract></Article>',
            '<CommentsCorrectionsList><CommentsCorrections RefType="RetractionOf"><RefSource>Self</RefSource></CommentsCorrections>', CASE p_size % 5 WHEN 0 THEN '<CommentsCorrections RefType="RetractionIn"><RefSource>Vet. 2026;50(5):485. doi: 10.1007/S112.</RefSource><PMID Version="1">99</PMID></CommentsCorrections>'
            WHEN 1 THEN '<CommentsCorrections RefType="ExpressionOfConcernIn"><RefSource>Doubt.</RefSource></CommentsCorrections>' ELSE '' END, '</CommentsCorrectionsList></MedlineCitation></PubmedArticle></PubmedArticleSet>', CASE WHEN p_size % 11 = 0 THEN '<broken' ELSE '' END) AS payload
        FROM {part}""",
    "v_people": """
        SELECT p_partkey AS id, concat('{{"id":"https://openalex.org/A', cast(p_partkey as string), '","display_name":"', p_name, '","orcid":', CASE WHEN p_size % 2 = 0 THEN '"https://orcid.org/0000-0001-2345-6789"' ELSE 'null' END, ',"works_count":', cast(p_size as string), ',"topics":[{{"display_name":"T1"}},{{"display_name":null}}],"display_name_alternatives":["X","Y"],',
            '"affiliations":[{{"institution":{{"display_name":"Univ"}},"years":[2020,2021]}},{{"institution":{{}},"years":[1]}}]}}') AS payload, CASE WHEN p_size % 3 = 0 THEN upper(p_name) ELSE p_type END AS asked
        FROM {part}""",
    "v_requests": """
        SELECT o_orderkey AS id, concat('Deep "learning": part ', cast(o_custkey as string)) AS query, CASE WHEN o_orderkey % 2 = 0 THEN cast(1990 + o_custkey % 30 as int) END AS year_from, CASE WHEN o_orderkey % 3 = 0 THEN 2020 END AS year_to,
               CASE o_orderkey % 4 WHEN 0 THEN 'journal-article' WHEN 1 THEN 'thesis' WHEN 2 THEN 'review' ELSE NULL END AS type, CASE WHEN o_orderkey % 5 = 0 THEN '2024-01-02' END AS date_from, CASE WHEN o_orderkey % 7 = 0 THEN '2024-02-03' END AS date_to,
               CASE o_orderkey % 6 WHEN 0 THEN 'crossref' WHEN 1 THEN 'openalex' WHEN 2 THEN 'semantic_scholar' WHEN 3 THEN 'arxiv' WHEN 4 THEN 'pubmed' ELSE 'eric' END AS source,
               CASE o_orderkey % 3 WHEN 0 THEN concat('10.48550/arXiv.', cast(o_custkey as string)) WHEN 1 THEN concat('https://doi.org/10.1016/S0140(', cast(o_custkey as string), ')X') ELSE concat('10.48550/', cast(o_custkey as string)) END AS doi
        FROM {orders}""",
    "v_bibtex": f"""
        SELECT p_partkey AS id, concat('@', CASE p_size % 4 WHEN 0 THEN 'article' WHEN 1 THEN 'phdthesis' WHEN 2 THEN 'misc' ELSE 'inproceedings' END, '{{{{k', cast(p_partkey as string), ', title = {{{{A {{{{', p_name, '}}}} Study}}}}, author = "', {_LAST}, ', ', {_FIRST}, ' and Li, Wei", year = ', cast(1990 + p_size as string), ',', {_NL},
            CASE WHEN p_size % 2 = 0 THEN concat('doi = {{{{10.5555/P', cast(p_partkey as string), '}}}}, ') ELSE '' END, 'journal = {{{{J. \\& ', p_type, '}}}}, pages = {{{{1--9}}}}}}}}', {_NL}, '@book{{{{b, note={{{{x}}}}', CASE WHEN p_size % 3 = 0 THEN '' ELSE '}}}}' END) AS text
        FROM {{part}}""",
    "v_ris": f"""
        SELECT p_partkey AS id, concat('TY  - ', CASE WHEN p_size % 2 = 0 THEN 'JOUR' ELSE 'THES' END, {_NL}, 'TI  - ', p_name, {_NL}, '  continued', {_NL}, 'AU  - ', {_LAST}, {_NL}, 'AU  - Li', {_NL}, 'T2  - 深度', {_NL}, '学习', {_NL}, 'PY  - ', cast(1990 + p_size as string), '/06//', {_NL}, 'SP  - 1', {_NL}, CASE WHEN p_size % 3 = 0 THEN concat('EP  - 9', {_NL}) ELSE '' END, 'ER  - ', {_NL}, {_NL},
            'TY  - BOOK', {_NL}, 'PY  - 2000', {_NL}, 'TY  - CHAP', {_NL}, 'T1  - 知网 ', p_brand, CASE WHEN p_size % 5 = 0 THEN '' ELSE concat({_NL}, 'ER  - ') END) AS text
        FROM {{part}}""",
    "v_reflists": f"""
        SELECT p_partkey AS doc_id, CASE p_size % 4
            WHEN 0 THEN concat('[1] ', {_LAST}, ', ', {_FIRST}, '. A study of ', p_name, '[J]. Journal, ', cast(1990 + p_size as string), ', 1(2): 3-9.', {_NL}, '[2] ', {_LAST}, ' A, B, C, D. The ', p_type, ' book. 2019.', {_NL}, '[3] ', {_LAST}, '. On ', p_name, '[J/OL]. Web, 2018.', {_NL}, '[4] ', {_LAST}, '. Of ', p_name, '[J]. Press, 2017.')
            WHEN 1 THEN concat({_LAST}, ', A. J., & Murch, S. (', cast(1950 + p_size as string), 'b). About ', p_name, '. Lancet。 https://doi.org/10.5555/S(', cast(p_partkey as string), ')9-0.', {_NL}, '12')
            WHEN 2 THEN concat('10.5555/p', cast(p_partkey as string), '.')
            ELSE concat('@article{{{{k, title={{{{On ', p_name, '}}}}, author={{{{', {_LAST}, ' and Li Wei}}}}, year="', cast(1990 + p_size as string), '", doi={{{{10.5555/b', cast(p_partkey as string), '}}}}, journal={{{{', p_type, '}}}}}}}} @misc{{{{z, note={{{{n}}}}}}}}') END AS text
        FROM {{part}}""",
    "v_trails": f"""
        SELECT o_orderkey AS id, concat('# trail', {_NL}, '## 2024-01-0', cast(1 + o_custkey % 9 as string), ' 10:00 · paper-topic 选题 ', cast(o_custkey as string), {_NL}, '- 产物：topic/', cast(o_orderkey as string), '.html', {_NL}, 'text', {_NL}, '## no date · paper-x', {_NL}, '## 2024-02-02 · paper-draft', {_NL}, 'more') AS text FROM {{orders}}""",
}


def view(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A view over the Parquet tables of `sf_dir`, whose rows are dealt over all tasks first where
    short rows become long texts (`spread`)."""
    sql = VIEWS[name]
    used = set(re.findall(r"(?<![{])[{](\w+)[}]", sql))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(sql, **{t: dealt(df) if spread else df for t, df in tables.items()})


def duck(*names: str) -> str:
    """The same views as common table expressions for the SQL side."""
    plain = lambda sql: re.sub(r"(?<![{])[{](\w+)[}]", r"\1", sql).replace("{{", "{").replace("}}", "}")
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({plain(VIEWS[n])})" for n in names)
