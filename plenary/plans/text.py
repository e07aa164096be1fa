"""Scalar library at work, full-text search, and page parsing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.civic import agenda_items, meetings, table, with_views


def parse_query(query: str) -> list[tuple[bool, list[str]]]:
    """Search terms: (excluded, words); words in double quotes are a phrase, a hyphen excludes, all terms must hold.

    A quote that isn't closed runs to the end.
    """
    terms, at = [], 0
    while at < len(query):
        if query[at].isspace():
            at += 1
            continue
        excluded = query[at] == "-" and at + 1 < len(query) and not query[at + 1].isspace()
        at += excluded
        if query[at] == '"':
            end = query.find('"', at + 1)
            end = len(query) if end < 0 else end
            words, at = query[at + 1 : end].split(), end + 1
        else:
            end = at
            while end < len(query) and not query[end].isspace():
                end += 1
            words, at = [query[at:end]], end
        words = ["".join(c for c in w.lower() if c.isalnum()) for w in words]
        if words := [w for w in words if w]:
            terms.append((excluded, words))
    return terms


def term_pattern(words: list[str]) -> str:
    """A pattern for words in a row, each of which may go on: prefixes, as in the index."""
    return r"(?i)\b" + r"\w*\W+".join(words)


def matches(text: Column, query: str) -> Column:
    """Whether a text satisfies a query; one without terms matches nothing."""
    terms = parse_query(query)
    tests = [~text.rlike(term_pattern(w)) if out else text.rlike(term_pattern(w)) for out, w in terms]
    return reduce(lambda a, b: a & b, tests) if tests else F.lit(False)


def ranked(df: DataFrame, fields: dict[str, float], query: str) -> DataFrame:
    """Rows that satisfy the query in any field, with rank r / (r + 1), r the weighted number of its words' occurrences."""
    whole = F.concat_ws(" \n ", *fields)
    counts = [weight * F.regexp_count(F.col(field), F.lit(term_pattern(words))) for field, weight in fields.items() for out, words in parse_query(query) if not out]
    r = reduce(lambda a, b: a + b, counts, F.lit(0.0))
    return df.where(matches(whole, query)).withColumn("rank", F.round(r / (r + 1), 6))


#: Words that the invented prose has, so that searches find something.
QUERY, QUERY_LIKE = 'the "of the" -tion', ("ing", "with")


def documents(spark, d):
    return table(spark, d, "documents")


def search_documents(spark, d):
    found = ranked(documents(spark, d).select("doc_id", "source", "lang", "text"), {"source": 1.0, "text": 0.4}, 'the "of the" -les')
    return found.select("doc_id", "source", "lang", "rank").orderBy(F.desc("rank"), "doc_id").limit(50)


def search_agenda(spark, d):
    items = agenda_items(spark, d).join(meetings(spark, d).select("meeting_id", "body", "jurisdiction_id", "meeting_date"), "meeting_id").where("jurisdiction_id = 1")
    found = ranked(items.select("meeting_id", "item_number", "title", "body", "meeting_date", "part_id"), {"title": 1.0, "body": 0.4}, "blu wid promo")
    return found.orderBy(F.desc("meeting_date"), F.desc("rank"), "meeting_id", "item_number", "part_id").limit(40).select("meeting_id", "item_number", "title", "body", "meeting_date", "rank")


def search_fallback(spark, d):
    """Any of the terms, by case-blind containment."""
    text = F.col("text")
    return documents(spark, d).where(reduce(lambda a, b: a | b, (text.ilike(f"%{t}%") for t in ("oning", "queer")))).select("doc_id", "lang", "source")


def federated_search(spark, d):
    """Hits of several scopes as one typed list."""
    part = table(spark, d, "part").where(F.col("p_name").ilike("%blue%")).select(F.lit("entity").alias("scope"), F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    docs = documents(spark, d).where(F.col("text").ilike("%blend%")).select(F.lit("document").alias("scope"), F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang").alias("title"))
    pages = table(spark, d, "pages").where(F.col("url").contains("/en/")).select(F.lit("page").alias("scope"), F.col("page_id").alias("id"), F.col("url").alias("title"))
    return part.unionByName(docs).unionByName(pages)


def token_index(spark, d):
    """The materialised index: documents and occurrences of each term."""
    words = documents(spark, d).select("doc_id", F.explode(F.split(F.lower("text"), "[^a-z0-9]+")).alias("term")).where("term <> ''")
    return words.groupBy("term").agg(F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("occurrences"))


def _phrases(df: DataFrame) -> DataFrame:
    """A sentence for each meeting, made of its status, votes and kind, for the classifiers to read."""
    verb = F.when(F.col("status") == "complete", "approved").when(F.col("status") == "failed", "denied").otherwise("continued")
    kind = F.element_at(F.array(*map(F.lit, ("Executive", "Informal", "Formal", "Special", "Town"))), F.left("meeting_type", F.lit(1)).cast("int"))
    note = F.when((F.col("meeting_id") % 11 == 0) & (F.col("status") == "complete"), " as amended").when(F.col("meeting_id") % 13 == 0, ", presentation only").otherwise("")
    return df.withColumn("title", F.concat(kind, F.lit(" session of "), F.col("body"))).withColumn("action", F.concat(F.lit("Motion was "), verb, note))


def classified_meetings(spark, d):
    m = _phrases(meetings(spark, d))
    return m.groupBy(T.meeting_kind(F.lit(""), F.col("title")).alias("kind"), T.lifecycle(F.col("action")).alias("lifecycle")).agg(F.count(F.lit(1)).alias("meetings"), F.min("meeting_date").alias("first_date"))


def classified_errors(spark, d):
    e = table(spark, d, "events").withColumn("message", F.concat(F.lit("["), F.upper("event_type"), F.lit("] "), F.element_at(F.array(*map(F.lit, ("request timed out", "KeyError: k", "duplicate key violation", "odd"))), (F.col("event_id") % 4 + 1).cast("int"))))
    return e.groupBy(T.tagged_error(F.col("message")).alias("tag"), T.error_category(F.col("message")).alias("category")).agg(F.count(F.lit(1)).alias("events"))


def names_normalised(spark, d):
    s = table(spark, d, "supplier").withColumn("raw", F.concat(F.element_at(F.array(*map(F.lit, ("Mayor ", "Dr. ", "the ", ""))), (F.col("s_suppkey") % 4 + 1).cast("int")), "s_name", F.lit(", Treasurer")))
    return s.select("s_suppkey", T.person_name(F.col("raw")).alias("person"), T.org_name(F.concat("s_name", F.lit(" & Sons-West, LLC"))).alias("org"), T.slug(F.concat("s_name", F.lit(" (acting)"))).alias("slug"))


def item_numbers(spark, d):
    n = agenda_items(spark, d).withColumn("raw", F.concat(F.lit("0"), "item_number", F.lit(".a"), (F.col("part_id") % 20).cast("string"), F.lit(".")))
    norm = T.item_number(F.col("raw"))
    return n.select(norm.alias("number")).distinct().select("number", T.item_parent(F.col("number")).alias("parent"), T.item_depth(F.col("number")).alias("depth"))


def case_numbers(spark, d):
    o = table(spark, d, "orders").select(F.concat_ws("-", F.lit("Z"), F.lpad((F.col("o_custkey") % 500).cast("string"), 4, "0"), (F.col("o_orderkey") % 3).cast("string")).alias("number"))
    return o.groupBy(T.case_base(F.col("number")).alias("base")).agg(F.count(F.lit(1)).alias("items"), F.count_distinct("number").alias("revisions"))


def dates_normalised(spark, d):
    day = F.to_date("meeting_date")
    form = F.when(F.col("meeting_id") % 4 == 0, F.date_format(day, "M/d/yyyy")).when(F.col("meeting_id") % 4 == 1, F.date_format(day, "MMMM d, yyyy")).when(F.col("meeting_id") % 4 == 2, F.lit("to be announced")).otherwise(F.col("meeting_date"))
    return meetings(spark, d).select("meeting_id", T.iso_date(form).alias("day"))


def vocabulary_scores(spark, d):
    """Overlap of each benchmark passage's words with the documents of the same number."""
    b, docs = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("passage")), documents(spark, d).select("doc_id", "text")
    return b.join(docs, "doc_id").select("doc_id", T.vocabulary_overlap(T.tokens(F.col("passage"), 3), T.tokens(F.col("text"), 3)).alias("overlap"))


def content_hashes(spark, d):
    docs = documents(spark, d)
    return docs.groupBy(T.content_hash(F.col("text")).alias("hash")).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("keeper")).where("copies > 1")


def identity_keys(spark, d):
    return meetings(spark, d).select("meeting_id", T.identity_key("event", body=F.col("body"), day=F.col("meeting_date"), status=F.col("status")).alias("identity"))


def url_hosts(spark, d):
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, d, "pages").groupBy(F.regexp_replace(host, r"^(www|m)\.", "").alias("family")).agg(F.count(F.lit(1)).alias("pages"))


def page_titles(spark, d):
    """Title, links and paragraphs of raw pages."""
    html = F.col("html")
    return table(spark, d, "pages").select(
        "page_id", F.regexp_extract(html, r"<title>([^<]*)</title>", 1).alias("title"), F.regexp_count(html, F.lit(r"<a href=")).cast("long").alias("links"), F.regexp_count(html, F.lit(r"<p[ >]")).cast("long").alias("paragraphs")
    )


def page_links(spark, d):
    """Each link of each page, one row."""
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))).alias("href")).groupBy("href").agg(F.count_distinct("page_id").alias("pages"), F.count(F.lit(1)).alias("links"))


def highlighted_titles(spark, d):
    return table(spark, d, "part").select("p_partkey", T.highlighted(F.concat(F.lit("<"), "p_name", F.lit(">")), "ring").alias("marked"))


_LIKE = "regexp_matches(text, '(?i)oning') OR regexp_matches(text, '(?i)queer')"
PLANS = {
    # word boundaries differ between the engines where letters have accents, so prose is compared on ASCII texts only in tests
    "search_documents": (search_documents, None),
    "search_agenda": (search_agenda, with_views("agenda_items", "meetings", more=r"""hits AS (SELECT meeting_id, item_number, title, body, meeting_date, part_id,
    len(regexp_extract_all(title, '(?i)\bblu')) + len(regexp_extract_all(title, '(?i)\bwid')) + len(regexp_extract_all(title, '(?i)\bpromo'))
    + 0.4 * (len(regexp_extract_all(body, '(?i)\bblu')) + len(regexp_extract_all(body, '(?i)\bwid')) + len(regexp_extract_all(body, '(?i)\bpromo'))) AS r
    FROM agenda_items JOIN meetings USING (meeting_id) WHERE jurisdiction_id = 1 AND regexp_matches(title, '(?i)\bblu') AND regexp_matches(title, '(?i)\bwid') AND regexp_matches(title, '(?i)\bpromo'))""")
  + "SELECT meeting_id, item_number, title, body, meeting_date, round((r / (r + 1))::DOUBLE, 6) AS rank FROM hits ORDER BY meeting_date DESC, rank DESC, meeting_id, item_number, part_id LIMIT 40"),
    "search_fallback": (search_fallback, "SELECT doc_id, lang, source FROM documents WHERE text ILIKE '%oning%' OR text ILIKE '%queer%'"),
    "federated_search": (federated_search, """SELECT 'entity' AS scope, p_partkey AS id, p_name AS title FROM part WHERE p_name ILIKE '%blue%'
  UNION ALL SELECT 'document', doc_id, source || '/' || lang FROM documents WHERE text ILIKE '%blend%'
  UNION ALL SELECT 'page', page_id, url FROM pages WHERE contains(url, '/en/')"""),
    "token_index": (token_index, """SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS occurrences
  FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1"""),
    "classified_meetings": (classified_meetings, with_views("meetings", more="""p AS (SELECT meeting_date, CASE left(meeting_type, 1) WHEN '1' THEN 'Executive' WHEN '2' THEN 'Informal' WHEN '3' THEN 'Formal' WHEN '4' THEN 'Special' ELSE 'Unknown' END AS kind,
  CASE WHEN NOT coalesce(meeting_id % 11 = 0 AND status = 'complete', false) AND meeting_id % 13 = 0 THEN 'informational' WHEN status IS NULL THEN 'unknown'
       WHEN status = 'failed' THEN 'denied' WHEN meeting_id % 11 = 0 THEN 'approved_as_amended' ELSE 'approved' END AS lifecycle FROM meetings)""")
  + "SELECT kind, lifecycle, count(*) AS meetings, min(meeting_date) AS first_date FROM p GROUP BY 1, 2"),
    "classified_errors": (classified_errors, """SELECT upper(event_type) AS tag, CASE event_id % 4 WHEN 0 THEN 'TRANSIENT' WHEN 1 THEN 'CODE' WHEN 2 THEN 'DATA' ELSE 'UNKNOWN' END AS category, count(*) AS events FROM events GROUP BY 1, 2"""),
    "names_normalised": (names_normalised, "SELECT s_suppkey, lower(replace(s_name, '#', '')) || ' treasurer' AS person, lower(replace(s_name, '#', '')) || ' and sonswest' AS org, regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g') || '-acting' AS slug FROM supplier"),
    "item_numbers": (item_numbers, """SELECT DISTINCT l_linenumber || '.A' || (l_partkey % 20) AS number, l_linenumber::VARCHAR AS parent, 1::BIGINT AS depth FROM lineitem JOIN part ON l_partkey = p_partkey"""),
    "case_numbers": (case_numbers, """SELECT 'Z-' || lpad((o_custkey % 500)::VARCHAR, 4, '0') AS base, count(*) AS items, count(DISTINCT o_orderkey % 3) AS revisions FROM orders GROUP BY 1"""),
    "dates_normalised": (dates_normalised, with_views("meetings") + "SELECT meeting_id, CASE WHEN meeting_id % 4 <> 2 THEN meeting_date END AS day FROM meetings"),
    "vocabulary_scores": (vocabulary_scores, """WITH t AS (SELECT b.item_id AS doc_id,
    list_distinct(list_filter(string_split_regex(lower(b.text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS a,
    list_distinct(list_filter(string_split_regex(lower(d.text), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS b
    FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
  s AS (SELECT doc_id, len(list_intersect(a, b)) AS i, len(list_distinct(a || b)) AS u, least(len(a), len(b)) AS l FROM t)
  SELECT doc_id, round(0.7 * coalesce(i / nullif(l, 0), 0) + 0.3 * coalesce(i / nullif(u, 0), 0), 4) AS overlap FROM s"""),
    "content_hashes": (content_hashes, "SELECT sha256(coalesce(text, '')) AS hash, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY 1 HAVING count(*) > 1"),
    "identity_keys": (identity_keys, with_views("meetings") + "SELECT meeting_id, sha256('event:body=' || body || '|day=' || meeting_date || '|status=' || coalesce(status, '∅')) AS identity FROM meetings"),
    "url_hosts": (url_hosts, r"SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '^(www|m)\.', '') AS family, count(*) AS pages FROM pages GROUP BY 1"),
    "page_titles": (page_titles, """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links,
  len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages"""),
    "page_links": (page_links, """SELECT href, count(DISTINCT page_id) AS pages, count(*) AS links FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1"""),
    "highlighted_titles": (highlighted_titles, "SELECT p_partkey, '&lt;' || replace(p_name, 'ring', '<mark>ring</mark>') || '&gt;' AS marked FROM part"),
}
