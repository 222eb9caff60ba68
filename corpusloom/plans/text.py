"""Queries over scalar functions and the cleaner's predicates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import clean as C
from corpusloom.operators.chunk import line_chunks
from corpusloom.plans.base import collapse_sql, lines_sql, query, strip_sql, table, tokens_sql

def T():
    return F.col("text")


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
LINES_SQL = """lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content,
         CAST(unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS INTEGER) AS chunk_index
  FROM documents)"""
_CITED = "concat('See MGL c.', {k}, ', s.', {s}, 'B; G.L. c. ', {s}, ' § 1; Chapter ', {s}, ', Section 9 and 940 CMR ', {s}, '.17')"


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.content_hash(T()).alias("content_hash"))


@query("""
SELECT doc_id, substring(concat(source, '_', regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')), 1, 120) AS slug
FROM documents""")
def slug_id(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.slug_id(F.col("source"), F.col("text")).alias("slug"))


@query(f"SELECT doc_id, md5({collapse_sql('lower(text)')}) AS k FROM documents")
def near_dup_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.dedup_key(T()).alias("k"))


@query(f"SELECT min(doc_id) AS doc_id, md5({collapse_sql('lower(text)')}) AS k FROM documents GROUP BY 2")
def exact_dedup_first(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", T().alias("content"))
    return C.dedup_by_content(rows, "doc_id").select("doc_id", X.dedup_key(F.col("content")).alias("k"))


@query(f"""
WITH t AS (SELECT p_partkey, {_CITED.format(k='p_partkey', s='p_size')} AS c FROM part),
m AS (SELECT p_partkey, unnest({' || '.join(f"regexp_extract_all(c, '(?i){p}')" for p in X.CITATIONS)}) AS cited FROM t)
SELECT p_partkey, string_agg(cited, '|' ORDER BY cited) AS citations FROM (SELECT DISTINCT p_partkey, {strip_sql('cited')} AS cited FROM m) GROUP BY p_partkey""")
def citation_extract(spark, sf_dir):
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("See MGL c."), F.col("p_partkey").cast("string"), F.lit(", s."), size, F.lit("B; G.L. c. "), size, F.lit(" § 1; Chapter "), size, F.lit(", Section 9 and 940 CMR "), size, F.lit(".17"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.citations(text), "|").alias("citations"))


@query(f"""
WITH p AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT conv_id, turn, list_filter(list_distinct({tokens_sql('q')}), lambda x: x NOT IN ({_STOP})) AS q,
      list_filter(list_distinct({tokens_sql('a')}), lambda x: x NOT IN ({_STOP})) AS a FROM p WHERE a IS NOT NULL)
SELECT conv_id, turn, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_intersect(q, a)) / len(q) END, 6) AS ratio FROM s""")
def token_containment(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").withColumn("a", F.lead("text").over(w)).where("a is not null")
    return rows.select("conv_id", "turn", F.round(X.containment(T(), F.col("a")), 6).alias("ratio"))


@query("SELECT doc_id, round(length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text), 6) AS share FROM documents WHERE NOT (length(text) > 50 AND length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / length(text) > 0.15)")
def nonascii_filter(spark, sf_dir):
    share = F.round(X.non_ascii_share(T()) * 1e6) / 1e6  # as SQL rounds: 41 of 640, 0.0640625, comes to 0.064062
    return table(spark, sf_dir, "documents").where(~C.is_non_english(T())).select("doc_id", share.alias("share"))


@query(f"""
SELECT doc_id, len(regexp_extract_all(text, '(?i){C.BUYER}')) AS buyer, len(regexp_extract_all(text, '(?i){C.RENTER}')) AS renter FROM documents
WHERE NOT (len(regexp_extract_all(text, '(?i){C.BUYER}')) >= 2 AND len(regexp_extract_all(text, '(?i){C.RENTER}')) = 0)""")
def home_buying_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(~C.is_home_buying(T()))
    return docs.select("doc_id", X.hits(T(), C.BUYER).cast("long").alias("buyer"), X.hits(T(), C.RENTER).cast("long").alias("renter"))


@query(rf"""
WITH {LINES_SQL}
SELECT doc_id, chunk_index FROM lines
WHERE len(list_filter(regexp_split_to_array({strip_sql('content')}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) < 5
AND length(regexp_replace(regexp_replace({strip_sql('content')}, '[0-9 \t\n\r\f\x0B.,;:()\-–—/]', '', 'g'), 'https?://[^ \t\n\r\f\x0B]+', '', 'g')) < 10""")
def endnote_chunks(spark, sf_dir):
    return line_chunks(table(spark, sf_dir, "documents")).where(C.is_endnote(F.col("content"))).select("doc_id", "chunk_index")


@query(f"""
WITH t AS (SELECT doc_id, {strip_sql('text')} AS c, {lines_sql('text')} AS ls FROM documents),
b AS (SELECT *, list_filter(ls, lambda x: NOT starts_with(x, '#')) AS body FROM t),
n AS (SELECT *, len(body) AS n, len(list_filter(body, lambda x: right(x, 1) <> '.')) AS open_ends, len(list_filter(body, lambda x: length(x) < 60)) AS narrow,
      len(list_filter(body, lambda x: length(x) < 80 AND right(x, 1) NOT IN ('.', '!', '?', ':', ';'))) AS linked, coalesce(list_sum(list_transform(body, lambda x: length(x))), 0) AS total FROM b)
SELECT doc_id FROM n WHERE NOT (len(ls) = 0 OR (n >= 3 AND narrow = n AND length(c) < 600 AND open_ends > 0.7 * n)
  OR (n >= 8 AND linked > 0.65 * n AND total < 45 * n) OR contains(c, '<time datetime=')
  OR (contains(lower(c), 'sign up') AND contains(lower(c), 'newsletter') AND length(c) < 300) OR (length(c) < 600 AND contains(c, '...')))""")
def line_stats_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~C.is_link_list(T(), F.col("doc_id").cast("string"))).select("doc_id")


@query(f"""
WITH t AS (SELECT doc_id, {lines_sql("replace(text, '.' || chr(10), chr(10) || '# ')")} AS ls FROM documents),
b AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT starts_with(x, '#')) AS body FROM t)
SELECT doc_id FROM b WHERE len(ls) = 0 OR (len(ls) >= 2 AND len(ls) - len(body) > 0.75 * len(ls) AND length(coalesce(array_to_string(body, ' '), '')) < 50)""")
def header_only_filter(spark, sf_dir):
    marked = F.replace(T(), F.lit(".\n"), F.lit("\n# "))
    return table(spark, sf_dir, "documents").where(C.is_header_only(marked)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE length({strip_sql('text')}) >= 100")
def short_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~C.is_short(T())).select("doc_id")


@query(f"""
WITH t AS (SELECT doc_id, text, length({strip_sql('text')}) AS n, {lines_sql('text')} AS ls FROM documents)
SELECT doc_id FROM t WHERE NOT (len(ls) = 0 OR (len(list_filter(ls, lambda x: length(x) < 40)) = len(ls) AND n < 150)
  OR (n < 200 AND ({' OR '.join(f"contains(lower(text), '{p}')" for p in C.BOILERPLATE)})))""")
def boilerplate_filter(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~C.is_boilerplate(T())).select("doc_id")


@query(f"""
WITH d AS (SELECT doc_id, concat(source, '_', CASE lang WHEN 'es' THEN 'spanish' WHEN 'fr' THEN 'French' ELSE lang END) AS slug FROM documents)
SELECT doc_id, slug FROM d WHERE NOT ({' OR '.join(f"contains(lower(slug), '{w}')" for w in C.LANGUAGES)}) AND NOT contains(slug, 'src11_') AND slug NOT IN (SELECT concat('src', n_nationkey, '_de') FROM nation)""")
def document_filters(spark, sf_dir):
    lang = F.when(F.col("lang") == "es", "spanish").when(F.col("lang") == "fr", "French").otherwise(F.col("lang"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("_"), lang).alias("doc_id"))
    blocked = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string"), F.lit("_de")).alias("doc_id"))
    kept = C.without_documents(docs.where(~C.is_translation(F.col("doc_id")) & ~C.is_oversized(F.col("doc_id"), ["src11_"])), blocked)
    return kept.select(F.col("id").alias("doc_id"), F.col("doc_id").alias("slug"))


@query(rf"""
WITH {LINES_SQL},
h AS (SELECT *, length({strip_sql('content')}) < 100 AND (starts_with({strip_sql('content')}, '#') OR regexp_full_match({strip_sql('content')}, '[A-Z \t\n\r\f\x0B0-9.:§()]+')) AS heading FROM lines),
t AS (SELECT *, coalesce(min(CASE WHEN NOT heading THEN chunk_index END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      max(CASE WHEN NOT heading THEN chunk_index END) OVER (PARTITION BY doc_id), max(chunk_index) OVER (PARTITION BY doc_id)) AS target FROM h)
SELECT doc_id, target AS chunk_index, string_agg(CASE WHEN heading THEN {strip_sql('content')} ELSE content END, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM t GROUP BY doc_id, target""")
def heading_merge(spark, sf_dir):
    return C.merge_headings(line_chunks(table(spark, sf_dir, "documents")))


@query(f"""
WITH {LINES_SQL}, kept AS (SELECT * FROM lines WHERE length({strip_sql('content')}) >= 100)
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks,
       printf('%d_chunk_%03d', doc_id, row_number() OVER w - 1) AS chunk_id, content FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def reindex(spark, sf_dir):
    kept = line_chunks(table(spark, sf_dir, "documents")).where(~C.is_short(F.col("content")))
    return C.reindex(kept).select("doc_id", "chunk_index", "total_chunks", "chunk_id", "content")


_BODY = f"list_filter({lines_sql('content')}, lambda x: NOT starts_with(x, '#'))"
_NARROW = f"""(len({lines_sql('content')}) = 0 OR (len({_BODY}) >= 3 AND len(list_filter({_BODY}, lambda x: length(x) < 60)) = len({_BODY}) AND length({strip_sql('content')}) < 600 AND len(list_filter({_BODY}, lambda x: right(x, 1) <> '.')) > 0.7 * len({_BODY}))
  OR (len({_BODY}) >= 8 AND len(list_filter({_BODY}, lambda x: length(x) < 80 AND right(x, 1) NOT IN ('.', '!', '?', ':', ';'))) > 0.65 * len({_BODY}) AND coalesce(list_sum(list_transform({_BODY}, lambda x: length(x))), 0) < 45 * len({_BODY}))
  OR contains({strip_sql('content')}, '<time datetime=') OR (contains(lower(content), 'sign up') AND contains(lower(content), 'newsletter') AND length({strip_sql('content')}) < 300) OR (length({strip_sql('content')}) < 600 AND contains({strip_sql('content')}, '...')))"""
_STEPS = {
    "non_english": "length(content) > 50 AND length(regexp_replace(content, '[\\x00-\\x7F]', '', 'g')) / length(content) > 0.15",
    "home_buying": f"len(regexp_extract_all(content, '(?i){C.BUYER}')) >= 2 AND len(regexp_extract_all(content, '(?i){C.RENTER}')) = 0",
    "endnote": rf"len(list_filter(regexp_split_to_array({strip_sql('content')}, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) < 5 AND length(regexp_replace(regexp_replace({strip_sql('content')}, '[0-9 \t\n\r\f\x0B.,;:()\-–—/]', '', 'g'), 'https?://[^ \t\n\r\f\x0B]+', '', 'g')) < 10",
    "link_list": _NARROW,
    "header_only": f"len({lines_sql('content')}) = 0 OR (len({lines_sql('content')}) >= 2 AND len({lines_sql('content')}) - len({_BODY}) > 0.75 * len({lines_sql('content')}) AND length(coalesce(array_to_string({_BODY}, ' '), '')) < 50)",
    "short": f"length({strip_sql('content')}) < 100",
    "boilerplate": f"len({lines_sql('content')}) = 0 OR (len(list_filter({lines_sql('content')}, lambda x: length(x) < 40)) = len({lines_sql('content')}) AND length({strip_sql('content')}) < 150) OR (length({strip_sql('content')}) < 200 AND ({' OR '.join(f"contains(lower(content), '{p}')" for p in C.BOILERPLATE)}))",
}
_CLEANED = rf"""{LINES_SQL},
b0 AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, chunk_index, content, CASE WHEN contains(CAST(doc_id AS VARCHAR), '77') THEN 'oversized' WHEN doc_id IN (SELECT n_nationkey FROM nation) THEN 'blocked' END AS step FROM lines),
h AS (SELECT *, length({strip_sql('content')}) < 100 AND (starts_with({strip_sql('content')}, '#') OR regexp_full_match({strip_sql('content')}, '[A-Z 	

0-9.:§()]+')) AS heading FROM b0 WHERE step IS NULL),
t AS (SELECT *, coalesce(min(CASE WHEN NOT heading THEN chunk_index END) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
      max(CASE WHEN NOT heading THEN chunk_index END) OVER (PARTITION BY doc_id), max(chunk_index) OVER (PARTITION BY doc_id)) AS target FROM h),
m AS (SELECT doc_id, target AS chunk_index, string_agg(CASE WHEN heading THEN {strip_sql('content')} ELSE content END, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM t GROUP BY doc_id, target),
st AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in _STEPS.items())} END AS step FROM m),
dd AS (SELECT *, row_number() OVER (PARTITION BY md5({collapse_sql('lower(content)')}) ORDER BY doc_id, chunk_index) AS n FROM st WHERE step IS NULL)"""


def _cleaned(spark, sf_dir):
    """Lines as chunks, the documents of a marker and of a list blocked."""
    lines = line_chunks(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("string"))
    return lines, table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("doc_id")), ["77"]


@query(f"""
WITH {_CLEANED}
SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS chunk_index, md5(content) AS content, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS total_chunks, printf('%s_chunk_%03d', doc_id, row_number() OVER w - 1) AS chunk_id
FROM dd WHERE n = 1 WINDOW w AS (PARTITION BY doc_id ORDER BY chunk_index)""")
def corpus_clean(spark, sf_dir):
    """All steps in their order."""
    return C.clean(*_cleaned(spark, sf_dir)).select("doc_id", "chunk_index", F.md5("content").alias("content"), "total_chunks", "chunk_id")


@query(f"""
WITH {_CLEANED}, u AS (SELECT step, count(*) AS removed FROM b0 WHERE step IS NOT NULL GROUP BY 1 UNION ALL SELECT step, count(*) FROM st WHERE step IS NOT NULL GROUP BY 1
UNION ALL SELECT 'merge', (SELECT count(*) FROM h) - (SELECT count(*) FROM m) UNION ALL SELECT 'duplicate', count(*) FROM dd WHERE n > 1)
SELECT step, removed FROM u WHERE removed > 0""")
def cleaning_counts(spark, sf_dir):
    """What each step takes away after the steps before it."""
    return C.removed_counts(*_cleaned(spark, sf_dir))


@query(f"""
WITH t AS (SELECT text AS content FROM documents)
{' UNION ALL '.join(f"SELECT '{n}' AS step, count(*) FILTER (WHERE {c}) AS removed FROM t" for n, c in _STEPS.items())}""")
def step_counts(spark, sf_dir):
    """What each chunk step would take away alone, over whole documents, in one pass."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), T().alias("content"))
    return C.step_counts(docs)


@query("""
WITH t AS (SELECT doc_id, concat('FACT 1: ', CASE quality WHEN 1 THEN 'YES' ELSE 'NO' END, ' — yes', chr(10), ' fact 2 : ', CASE toxic WHEN 1 THEN 'yes' ELSE 'no' END, ' - stated', chr(10), 'Fact 12: YES') AS j, quality, toxic FROM labels)
SELECT doc_id, quality = 1 AS fact1, toxic = 1 AS fact2, false AS fact3, doc_id % 2 = 0 AS verdict FROM t""")
def verdict_parse(spark, sf_dir):
    j = F.concat(F.lit("FACT 1: "), F.when(F.col("quality") == 1, "YES").otherwise("NO"), F.lit(" — yes\n fact 2 : "), F.when(F.col("toxic") == 1, "yes").otherwise("no"), F.lit(" - stated\nFact 12: YES"))
    return table(spark, sf_dir, "labels").select("doc_id", *[X.fact_verdict(j, F.lit(i)).alias(f"fact{i}") for i in (1, 2, 3)], X.yes_verdict(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" \n yes: "), j)).otherwise(j)).alias("verdict"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def fenced_json(spark, sf_dir):
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(X.unfenced(fenced), "k long").getField("k").alias("k"))


@query(rf"""
WITH t AS (SELECT doc_id, text AS c, substring(text, 1, 800) AS w FROM documents),
p AS (SELECT *, CASE WHEN contains(w, chr(10) || chr(10)) THEN length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 ELSE -1 END AS para,
  greatest({', '.join(f"CASE WHEN contains(w, {s}) THEN length(w) - strpos(reverse(w), reverse({s})) - 1 ELSE -1 END" for s in ("'. '", "'.' || chr(10)", "'! '", "'? '"))}) AS sent FROM t)
SELECT doc_id, CASE WHEN length(c) <= 800 THEN c WHEN para > 400 THEN {strip_sql('substring(c, 1, para)')} WHEN sent > 400 THEN {strip_sql('substring(c, 1, sent + 1)')} ELSE {strip_sql('w')} END AS answer FROM p""")
def boundary_truncation(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.truncate_answer(T()).alias("answer"))


@query(f"SELECT conv_id, turn, list_slice(list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> ''), 1, 3) AS v FROM conversations".replace("SELECT conv_id", "SELECT conv_id, turn, array_to_string(v, '|') AS variants FROM (SELECT conv_id", 1) + ")")
def query_variants(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(X.variants(T(), 3), "|").alias("variants"))


@query(rf"""
WITH t AS (SELECT o_orderkey, o_orderkey % 13 AS n, concat('Answer ', o_orderkey, chr(10), '**Confidence:** ', o_orderkey % 13, '/10') AS c FROM orders)
SELECT o_orderkey, CASE WHEN n BETWEEN 1 AND 10 THEN CAST(n AS INTEGER) END AS confidence, CASE WHEN n BETWEEN 8 AND 10 THEN 'High' WHEN n BETWEEN 5 AND 7 THEN 'Medium' WHEN n BETWEEN 1 AND 4 THEN 'Low' END AS band,
       concat('Answer ', o_orderkey) AS rest FROM t""")
def confidence_bands(spark, sf_dir):
    k = F.col("o_orderkey")
    c = F.concat(F.lit("Answer "), k.cast("string"), F.lit("\n**Confidence:** "), (k % 13).cast("string"), F.lit("/10"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.confidence(c).alias("confidence"), X.confidence_band(X.confidence(c)).alias("band"), X.without_confidence(c).alias("rest"))


@query("""
SELECT event_id, CASE WHEN event_id % 5 = 3 THEN printf('%.0f%% relevance', value / 7 * 100) WHEN event_id % 5 = 4 THEN printf('%.2f relevance', value / 7) WHEN event_type = 'click' THEN printf('%.2f sim', greatest(0.0, 1 - value / 7)) WHEN event_type = 'view' THEN printf('%.1f BM25', value / 7)
       WHEN event_type = 'error' THEN printf('%.3f RRF', value / 7) ELSE CASE WHEN value / 7 < 1 THEN printf('%.2f sim', 1 - value / 7) ELSE printf('%.1f score', value / 7) END END AS label
FROM (SELECT event_id, event_type, round(value) + 0.3 AS value FROM events)""")
def score_labels(spark, sf_dir):
    kind = F.when(F.col("event_id") % 5 == 3, "fusion").when(F.col("event_id") % 5 == 4, "cross_encoder").when(F.col("event_type") == "click", "cosine_distance").when(F.col("event_type") == "view", "bm25").when(F.col("event_type") == "error", "rrf").otherwise("other")
    return table(spark, sf_dir, "events").select("event_id", X.score_label((F.round("value") + 0.3) / 7, kind).alias("label"))


@query(r"""
SELECT page_id, CASE WHEN contains(u, 'malegislature.gov') OR contains(u, 'general-laws') THEN 'statute' WHEN contains(u, 'regulation') OR contains(u, 'cmr') THEN 'regulation' WHEN contains(u, 'faq') THEN 'faq'
       WHEN contains(u, 'policy') OR contains(u, 'executive-order') THEN 'policy' ELSE 'guide' END AS kind
FROM (SELECT page_id, lower(concat(url, CASE page_id % 5 WHEN 0 THEN '/FAQ' WHEN 1 THEN '/940-cmr' WHEN 2 THEN '/Policy' WHEN 3 THEN '/general-laws' ELSE '' END)) AS u FROM pages)""")
def url_content_type(spark, sf_dir):
    k = F.col("page_id") % 5
    url = F.concat("url", F.when(k == 0, "/FAQ").when(k == 1, "/940-cmr").when(k == 2, "/Policy").when(k == 3, "/general-laws").otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", X.content_type(url).alias("kind"))


@query(rf"""
WITH t AS (SELECT doc_id, concat('940 CMR: OFFICE OF THE ATTORNEY GENERAL', chr(10), '3.01: Terms', chr(10), 'land-', chr(10), 'lord', chr(10), chr(10), chr(10), chr(10), '3.02: continued', chr(10), lang, '  x ') AS c, source FROM documents)
SELECT doc_id, concat('# ', source, chr(10), chr(10), '## 3.01: Terms', chr(10), 'landlord', chr(10), chr(10), '## 3.02 (continued)', chr(10), substring(c, length(c) - 5, 2), ' x') AS content FROM t""")
def regulation_markdown(spark, sf_dir):
    c = F.concat(F.lit("940 CMR: OFFICE OF THE ATTORNEY GENERAL\n3.01: Terms\nland-\nlord\n\n\n\n3.02: continued\n"), F.col("lang"), F.lit("  x "))
    return table(spark, sf_dir, "documents").select("doc_id", X.section_headings(X.regulation_text(c), F.col("source")).alias("content"))


@query(f"""
SELECT source, count(*) AS n_chunks, CAST(min(t) AS INTEGER) AS min_tokens, CAST(max(t) AS INTEGER) AS max_tokens, CAST(floor(avg(t)) AS BIGINT) AS avg_tokens
FROM (SELECT source, ceil(length(text) / 4) AS t FROM documents) GROUP BY source""")
def token_statistics(spark, sf_dir):
    from corpusloom.operators.chunk import token_stats

    return token_stats(table(spark, sf_dir, "documents"), X.token_estimate(T()), "source").select("source", "n_chunks", "min_tokens", "max_tokens", "avg_tokens")


@query("""SELECT o_orderkey, concat('Read ', chr(92), '[Source 1: a', o_orderkey, chr(92), ']', chr(10), chr(10), '**Summary:** x', chr(10), chr(10), '**Details:** y') AS answer FROM orders""")
def spaced_answers(spark, sf_dir):
    """A missing bracket closed and escaped, and sections set apart."""
    c = F.concat(F.lit("Read [Source 1: a"), F.col("o_orderkey").cast("string"), F.lit("\n**Summary:** x\n\n\n\n**Details:**: y"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.spaced_sections(c, ["Summary", "Details"]).alias("answer"))
