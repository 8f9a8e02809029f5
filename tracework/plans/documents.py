"""Text, chunking, retrieval and conversation operators on the given tables."""
from pyspark.sql import functions as F

from tracework.functions import text as tx
from tracework.operators import documents as doc
from tracework.operators import retrieval as ret
from tracework.operators import vectors as v
from tracework.plans.registry import outputs, query
from tracework.session import spread

CLEAN = "trim(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^>]+>', ' ', 'g'), '" + tx.SPACE + "+', ' ', 'g'))"


def clean_sql(c):
    return CLEAN.replace("{c}", c)


@query("txt_clean", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", tx.clean("html").alias("text"))


_TITLE_SQL = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


def _title():
    return F.regexp_extract("html", "<title>([^<]*)</title>", 1)


@query("txt_parse_articles_json", f"""
SELECT page_id, {clean_sql(_TITLE_SQL)} AS title, '' AS date, CASE WHEN page_id % 3 = 1 THEN 'crawl' ELSE '' END AS source, trim(url) AS url, {clean_sql('html')} AS content FROM pages
UNION ALL SELECT page_id, 'second', '2024', '', '', '' FROM pages WHERE page_id % 3 = 1""")
def _(t):
    """Three payload shapes built from pages: a list, an object with a list, a single object."""
    item = F.to_json(F.struct(_title().alias("headline"), F.col("url").alias("link"), F.col("html").alias("snippet")))
    item2 = F.to_json(F.struct(F.lit("").alias("title"), _title().alias("name"), "url", F.lit("crawl").alias("domain"), F.col("html").alias("description")))
    single = F.to_json(F.struct(_title().alias("title"), "url", F.col("html").alias("text"), F.lit("").alias("content")))
    second = F.lit('{"title": "second", "published": 2024}')
    payload = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("["), item, F.lit(', 7, {"title": ""}]'))).when(
        F.col("page_id") % 3 == 1, F.concat(F.lit('{"results": [], "articles": ['), item2, F.lit(","), second, F.lit("]}"))).otherwise(single)
    return doc.articles_json(t.pages.select("page_id", payload.alias("payload")), "payload")


@query("txt_parse_articles_blocks", f"""
WITH s AS (SELECT doc_id, lang, source, n_chars, regexp_replace(text, '\\n\\n+', chr(10), 'g') AS text FROM documents)
SELECT doc_id, 0::INTEGER AS block, 'Document ' || doc_id AS title, '' AS date, source, 'http://x/' || doc_id AS url, {clean_sql('text')} AS content FROM s
UNION ALL SELECT doc_id, 1, '', n_chars::VARCHAR, '', '', 'In ' || lang || ' first more words' FROM s
UNION ALL SELECT doc_id, 2, '', '', '', '', 'tail' FROM s""")
def _(t):
    body = F.regexp_replace("text", "\n\n+", "\n")
    payload = F.concat(F.lit("Title: ignored\nHEADLINE : Document "), F.col("doc_id"), F.lit("\nsource:"), F.col("source"), F.lit("\nlink: http://x/"), F.col("doc_id"), F.lit("\n"),
                       body, F.lit("\n ----\nfirst\nSummary: In "), F.col("lang"), F.lit("\nmore  words\nDate: "), F.col("n_chars"), F.lit("\nArticle 12\ntail\n\n\n"))
    return doc.articles_blocks(t.documents.select("doc_id", payload.alias("payload")), "payload")


_IDENT = f"coalesce(nullif(regexp_replace(lower(url), '/+$', ''), ''), nullif(regexp_replace(lower({_TITLE_SQL}), '[^a-z0-9]+', '', 'g'), ''))"


@query("txt_dedup_identity", f"""
WITH p AS (SELECT page_id, html, CASE WHEN page_id % 5 = 0 THEN '' ELSE regexp_replace(url, '[?#].*$', '') || '/' END AS url FROM pages)
SELECT page_id, {_IDENT} AS identity FROM p WHERE {_IDENT} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {_IDENT} ORDER BY page_id) = 1""")
def _(t):
    url = F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("/")))
    p = t.pages.select("page_id", url.alias("url"), _title().alias("title"))
    return doc.dedup_identity(p, "url", "title", ["page_id"]).select("page_id", "identity")


_POINTS = f"list_slice(list_filter(list_transform(string_split(regexp_replace({clean_sql('text')}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 40), 1, 3)"


@query("txt_main_points", f"SELECT doc_id, len({_POINTS})::INTEGER AS n, array_to_string({_POINTS}, ' | ') AS points FROM documents")
def _(t):
    p = tx.main_points(F.col("text"))
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.size(p).alias("n"), F.array_join(p, " | ").alias("points"))


@query("txt_digest", f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i, lang, source, {_POINTS} AS p FROM documents)
SELECT doc_id, concat_ws(chr(10), '### ' || i || '. ' || CASE WHEN lang = 'en' THEN 'Text ' || doc_id ELSE 'Article ' || i END, CASE WHEN lang = 'fr' THEN '**Date:** ' || lang END, '**Source:** ' || source,
 CASE WHEN len(p) > 0 THEN array_to_string(list_transform(p, lambda s: '- ' || s), chr(10)) ELSE '- No usable article description was supplied.' END, CASE WHEN lang <> 'de' THEN '**URL:** u/' || doc_id END) AS digest FROM d""")
def _(t):
    from tracework.operators.ordered import ordered_columns

    d = ordered_columns(t.documents, [], ["doc_id"], index="i")
    title = F.when(F.col("lang") == "en", F.concat(F.lit("Text "), F.col("doc_id"))).otherwise("")
    date = F.when(F.col("lang") == "fr", F.col("lang")).otherwise("")
    url = F.when(F.col("lang") != "de", F.concat(F.lit("u/"), F.col("doc_id"))).otherwise("")
    return d.select("doc_id", tx.digest(F.col("i") + 1, title, date, F.col("source"), url, tx.main_points(F.col("text"))).alias("digest"))


_MD = "'**Turn ' || turn || '**' || chr(10) || '* ' || replace(text, chr(10), chr(10) || ' * ') || chr(10) || chr(10) || '**end****x**'"


def _md():
    return F.concat(F.lit("**Turn "), F.col("turn"), F.lit("**\n* "), F.replace("text", F.lit("\n"), F.lit("\n * ")), F.lit("\n\n**end****x**"))


@query("txt_md_to_html", f"""
WITH a AS (SELECT conv_id, turn, regexp_replace({_MD}, '\\*\\*(.*?)\\*\\*', '<p><strong>\\1</strong></p>', 'g') AS s FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(s, '(?m)^\\s*\\*\\s(.*)', '<li>\\1</li>', 'g') AS s FROM a),
c AS (SELECT conv_id, turn, regexp_replace(s, '(?s)(<li>.*?</li>)+', '<ul>\\0</ul>', 'g') AS s FROM b)
SELECT conv_id, turn, regexp_replace(replace(s, '</p><p>', '</p><br><p>'), '(\\n|\\\\n)+', '<br>', 'g') AS html FROM c""")
def _(t):
    return t.conversations.select("conv_id", "turn", tx.markdown_html(_md()).alias("html"))


_REPLY = """CASE WHEN role = 'system' THEN 'I cannot provide that for $5. ITEM DETAILS:' || chr(10) || '* ' || text WHEN turn % 4 = 1 THEN 'Sorry, this violated our content policy: $1 ' || text
 WHEN role = 'user' THEN 'ITEM DETAILS: $3' || chr(10) || '* ' || text WHEN turn % 4 = 3 THEN '# Done' || chr(10) || '* a' ELSE '' END"""


@query("txt_response_cleanup", f"""
WITH r AS (SELECT conv_id, turn, role, text, {_REPLY} AS s FROM conversations)
SELECT conv_id, turn, CASE WHEN s = '' THEN '# Fashion Analysis' || chr(10) || chr(10) || 'No detailed analysis was generated. Please refer to the item details below.'
 WHEN role = 'system' THEN '# Fashion Analysis' || chr(10) || chr(10) || 'Here are the items detected in your image:' || chr(10) || chr(10) || '## Item Details' || chr(10) || chr(10) || regexp_replace('* ' || trim(text, ' ' || chr(10)), '(?m)^\\* ', '- ', 'g')
 WHEN turn % 4 = 1 THEN replace(s, '$', '\\$')
 WHEN role = 'user' THEN '## Item Details \\$3' || chr(10) || regexp_replace(replace('* ' || text, '$', '\\$'), '(?m)^\\* ', '- ', 'g')
 ELSE '# Done' || chr(10) || '- a' END AS reply FROM r""")
def _(t):
    s = F.when(F.col("role") == "system", F.concat(F.lit("I cannot provide that for $5. ITEM DETAILS:\n* "), F.col("text"))).when(
        F.col("turn") % 4 == 1, F.concat(F.lit("Sorry, this violated our content policy: $1 "), F.col("text"))).when(
        F.col("role") == "user", F.concat(F.lit("ITEM DETAILS: $3\n* "), F.col("text"))).when(
        F.col("turn") % 4 == 3, F.lit("# Done\n* a")).otherwise("")
    return t.conversations.select("conv_id", "turn", tx.response_cleanup(s).alias("reply"))


@query("txt_parse_verification", """
SELECT doc_id, CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS supported, CASE WHEN toxic = 1 THEN 'c' || doc_id || ', d, e' ELSE '' END AS claims, '' AS contradictions,
 CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END AS relevant, CASE WHEN toxic = 0 THEN 'note: ' || doc_id ELSE '' END AS details,
 '**Supported:** ' || CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END || chr(10) || '**Unsupported Claims:** ' || CASE WHEN toxic = 1 THEN 'c' || doc_id || ', d, e' ELSE 'None' END || chr(10) || '**Contradictions:** None' || chr(10)
 || '**Relevant:** ' || CASE WHEN quality = 1 THEN 'YES' ELSE 'NO' END || chr(10) || '**Additional Details:** ' || CASE WHEN toxic = 0 THEN 'note: ' || doc_id ELSE 'None' END || chr(10) AS report FROM labels""")
def _(t):
    yes = F.when(F.col("quality") == 1, "yes").otherwise("no")
    s = F.concat(F.lit("Supported: "), yes, F.when(F.col("toxic") == 1, F.concat(F.lit('\nUNSUPPORTED CLAIMS: ["c'), F.col("doc_id"), F.lit("\", 'd' , e]"))).otherwise("\nunsupported claims: none"),
                 F.lit("\nContradictions: []\nchatter"), F.when(F.col("quality") == 1, "\nRelevant: Yes ").otherwise(""),
                 F.when(F.col("toxic") == 0, F.concat(F.lit("\nAdditional Details: note: "), F.col("doc_id"))).otherwise(""))
    p = t.labels.select("doc_id", tx.verification(s).alias("v"))
    return p.select("doc_id", "v.supported", F.array_join("v.unsupported_claims", ", ").alias("claims"), F.array_join("v.contradictions", ", ").alias("contradictions"),
                    "v.relevant", F.col("v.additional_details").alias("details"), tx.verification_report(F.col("v")).alias("report"))


@query("chk_recursive")
def _(t):
    c = doc.recursive_chunks(t.documents.select("doc_id", "text"), "text", 200, 20)
    return c.select("doc_id", "chunk", F.length("text").alias("chars"), F.md5("text").alias("hash"))


@query("chk_separator", """
WITH RECURSIVE l AS (SELECT doc_id, p, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents) WHERE p <> ''),
w AS (SELECT doc_id, r, p AS cur, 0 AS c FROM l WHERE r = 1
 UNION ALL SELECT l.doc_id, l.r, CASE WHEN length(cur) + 1 + length(l.p) <= 100 THEN cur || chr(10) || l.p ELSE l.p END, c + CASE WHEN length(cur) + 1 + length(l.p) <= 100 THEN 0 ELSE 1 END FROM w JOIN l ON l.doc_id = w.doc_id AND l.r = w.r + 1),
f AS (SELECT doc_id, c, trim(arg_max(cur, r)) AS text FROM w GROUP BY 1, 2)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY c) - 1)::INTEGER AS chunk, text FROM f WHERE text <> ''""")
def _(t):
    return doc.separator_chunks(t.documents.select("doc_id", "text"), "text", "\n", 100)


@query("chk_markdown_headers", """
WITH m AS (SELECT doc_id, 'intro' || chr(10) || '# ' || source || chr(10) || text || chr(10) || '## ' || lang || chr(10) || text || chr(10) || '# Last' || chr(10) || ' end ' AS s, source, lang FROM documents),
l AS (SELECT doc_id, source, lang, trim(unnest(string_split(s, chr(10)))) AS t, unnest(range(len(string_split(s, chr(10))))) AS i FROM m),
h AS (SELECT *, (t LIKE '# %' OR t LIKE '## %') AS head FROM l),
g AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, CASE section WHEN 0 THEN NULL WHEN 3 THEN 'Last' ELSE max(source) END AS header_1, CASE section WHEN 2 THEN max(lang) END AS header_2,
 string_agg(t, chr(10) ORDER BY i) AS text FROM g WHERE NOT head AND t <> '' GROUP BY doc_id, section""")
def _(t):
    s = F.concat(F.lit("intro\n# "), F.col("source"), F.lit("\n"), F.col("text"), F.lit("\n## "), F.col("lang"), F.lit("\n"), F.col("text"), F.lit("\n# Last\n end "))
    return doc.header_sections(t.documents.select("doc_id", s.alias("text")), ["doc_id"], "text")


@query("chk_hash_dedup", """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10)))))::INTEGER AS chunk FROM documents)
SELECT sha256(text) AS chunk_hash, doc_id, chunk FROM l QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id, chunk) = 1""")
def _(t):
    c = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "text"))
    return doc.chunk_dedup(c, "text", ["doc_id", "chunk"]).select("chunk_hash", "doc_id", "chunk")


@query("doc_fingerprint_set", """
WITH m AS (SELECT CASE WHEN quality = 1 THEN sha256(text) ELSE 'stale' END AS fingerprint, TIMESTAMP '2024-01-01' + to_hours((doc_id % 400)::INTEGER) AS cached_at FROM labels JOIN documents USING (doc_id))
SELECT doc_id, sha256(text) AS fingerprint FROM documents WHERE sha256(text) NOT IN (SELECT fingerprint FROM m WHERE cached_at > TIMESTAMP '2024-01-14' - INTERVAL 7 DAYS)""")
def _(t):
    d = t.documents.select("doc_id", "text")
    cached = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 400 * 3600)
    m = t.labels.join(d, "doc_id").select(F.when(F.col("quality") == 1, F.sha2("text", 256)).otherwise("stale").alias("fingerprint"), cached.alias("cached_at"))
    return doc.stale_documents(d, m, "doc_id", "text", F.lit("2024-01-14").cast("timestamp"))


BM = """tok AS (SELECT doc_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS avgdl),
rw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM rw) ELSE raw END AS idf FROM rw),
qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT qt.item_id AS query_id, tf.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qt JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY 1, 2),
bm AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM sc QUALIFY rank <= 10)"""


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _questions(t):
    return t.benchmark.select(F.col("item_id").alias("id"), "text")


@query("ret_bm25", f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM bm")
def _(t):
    return outputs(ret.bm25(_docs(t), _questions(t), 10))


@query("ret_vector_topk", """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_cosine_similarity(q.x, i.x), 12) AS c FROM e q JOIN e i ON q.label = 9 AND i.label <> 9)
SELECT query_id, item_id, round(c, 6) AS value, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, item_id)::INTEGER AS rank FROM s QUALIFY rank <= 10""")
def _(t):
    e = t.embeddings.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda c: c.cast("double")).alias("x"), "label")
    return outputs(v.nearest(e.where("label = 9"), e.where("label <> 9"), 10, "cosine"))


_PROF = "[" + ", ".join(f"(length(lower(text)) - length(replace(lower(text), '{chr(97 + i)}', '')))::DOUBLE" for i in range(26)) + "]"
VEC = f"""pd AS (SELECT doc_id, {_PROF} AS x FROM documents), pq AS (SELECT item_id, {_PROF} AS x FROM benchmark),
cs AS (SELECT item_id AS query_id, doc_id, round(list_cosine_similarity(pq.x, pd.x), 12) AS c FROM pq, pd),
vt AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, doc_id)::INTEGER AS rank FROM cs QUALIFY rank <= 10)"""
RRF = """fu AS (SELECT query_id, doc_id, round(sum(s), 12) AS score FROM (SELECT query_id, doc_id, 0.4::DOUBLE / (rank + 60) AS s FROM bm UNION ALL SELECT query_id, doc_id, 0.6::DOUBLE / (rank + 60) FROM vt) GROUP BY 1, 2),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM fu QUALIFY rank <= 10)"""


def _hybrid(t):
    prof = lambda d: d.select("id", ret.letter_profile(F.col("text")).alias("x"))
    near = v.nearest(prof(_questions(t)), prof(_docs(t)), 10, "cosine").withColumnRenamed("item_id", "doc_id")
    return ret.hybrid([ret.bm25(_docs(t), _questions(t), 10), near], k=10)


@query("ret_hybrid_rrf", f"WITH {BM}, {VEC}, {RRF} SELECT query_id, doc_id, round(score, 9) AS score, rank FROM rr")
def _(t):
    return outputs(_hybrid(t), 9)


@query("ret_context_join", f"""WITH {BM}, {VEC}, {RRF} SELECT query_id, md5(c) AS context_hash, length(c)::INTEGER AS chars
FROM (SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS c FROM rr JOIN documents USING (doc_id) WHERE rank <= 3 GROUP BY 1)""")
def _(t):
    c = ret.context(_hybrid(t), _docs(t), 3)
    return c.select("query_id", F.md5("context").alias("context_hash"), F.length("context").alias("chars"))


@query("cnv_history", """
SELECT conv_id, turn, role, row_number() OVER w - 1 AS position, (coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS chars_before,
 last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS question,
 CASE WHEN role = 'user' AND lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(t):
    return doc.conversation_history(t.conversations, "conv_id", "turn", "role", "text")
