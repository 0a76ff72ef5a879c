"""Queries: reviewed text (E, and its transform D9) and text redaction (K)."""

from __future__ import annotations

from secrets import token_hex

from pyspark.sql import functions as F

from ..errors import Refused
from ..functions import spans as Z
from ..functions import text as X
from ..operators import binding as B
from ..operators import redact as D
from ..operators import textreview as E
from ..operators.phrases import with_hits
from ..operators.protect import protect
from ..policy import REVIEW_TABLE, PolicyBuilder
from ..sinks import texts as T
from ..sources.rows import ROW
from . import sql as S
from .registry import query
from .shaping import union

# --- E ---
@query("e1_digest", "SELECT CAST(doc_id AS VARCHAR) doc_id, sha256(text) AS digest FROM documents")
def digests(c):
    return c.text("documents", ["doc_id", "text"]).select("doc_id", X.digest(F.col("text")).alias("digest"))


_BODIES = "SELECT 'documents' src, text v FROM documents UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'pages', html FROM pages"
_CODES = {
    "too_long": "length(v) > 4096", "whitespace_only": f"v <> '' AND {S.blank('v')}", "formula_prefix": S.formula("v"),
    "control_character": S.unsafe_control("v"), "email": S.matches("v", S.EMAIL), "date": S.matches("v", S.DATE),
    "time": S.matches("v", S.TIME), "long_digits": S.matches("v", S.DIGITS),
}


def bodies(c):
    return union(
        [
            c.text(t, [col]).select(F.lit(t).alias("src"), F.col(col).alias("v"))
            for t, col in (("documents", "text"), ("conversations", "text"), ("pages", "html"))
        ]
    )


@query(
    "e2_issue_codes",
    f"SELECT src, issue, count(*) n FROM (" + " UNION ALL ".join(f"SELECT src, '{k}' issue FROM ({_BODIES}) WHERE {cond}" for k, cond in _CODES.items()) + ") GROUP BY src, issue",
)
def issue_codes(c):
    found = bodies(c).select("src", F.explode(X.text_issues(F.col("v"))).alias("issue"))
    return found.groupBy("src", "issue").agg(F.count(F.lit(1)).alias("n"))


def span_sql(pattern: str, reason: str) -> str:
    """Positions from the pieces between matches, as running lengths."""
    return (
        f"SELECT id, '{reason}' reason, s, s + length(m) e, m FROM (SELECT id, m, sum(length(g)) OVER w + coalesce(sum(length(m)) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) s"
        f" FROM (SELECT id, unnest(string_split_regex(v, {S.q(pattern)})[:-2]) g, unnest(regexp_extract_all(v, {S.q(pattern)})) m, unnest(range(len(regexp_extract_all(v, {S.q(pattern)})))) i FROM texts WHERE {S.matches('v', pattern)})"
        " WINDOW w AS (PARTITION BY id ORDER BY i))"
    )


_TEXTS = "texts AS (SELECT doc_id id, text v FROM documents)"
_TRIM_MAIL = (
    "SELECT id, reason, s + length(m) - length(regexp_replace(m, '^[(<\\[{]+', '')) s,"
    " e - (length(m) - length(regexp_replace(m, '[,.;:!?)\\]}>]+$', ''))) e FROM mail"
)
_SPANS = (
    f"WITH {_TEXTS}, mail AS ({span_sql(S.EMAIL, 'email')}), digits AS ({span_sql(S.DIGITS, 'long_digits')}),"
    f" ctl AS ({span_sql('[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]', 'control_character')}),"
    f" spans AS ({_TRIM_MAIL} UNION ALL SELECT id, reason, s, e - (length(m) - length(regexp_replace(m, '[^\\p{{Nd}}]+$', ''))) FROM digits"
    " UNION ALL SELECT id, reason, s, e FROM ctl UNION ALL SELECT id, 'too_long', 4096, length(v) FROM texts WHERE length(v) > 4096"
    f" UNION ALL SELECT id, 'whitespace_only', 0, length(v) FROM texts WHERE v <> '' AND {S.blank('v')}"
    f" UNION ALL SELECT id, 'formula_prefix', lead, lead + 1 FROM (SELECT id, length(v) - length(regexp_replace(v, {S.q(f'^[{S.SP}]+')}, '')) lead FROM texts WHERE {S.formula('v')}))"
)


@query(
    "e3_issue_spans",
    f"{_SPANS} SELECT reason, count(*) n, CAST(sum(s) AS BIGINT) starts, CAST(sum(e) AS BIGINT) ends FROM spans GROUP BY reason",
)
def issue_spans(c):
    found = c.text("documents", ["text"]).select(F.explode(Z.issue_spans(F.col("text"))).alias("s"))
    return found.groupBy("s.reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends")
    )


def utf16(at: str) -> str:
    return f"({at} + length(regexp_replace(substr(v, 1, {at}), '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


_UTF16 = (
    f"{_SPANS}, ranked AS (SELECT id, reason, {utf16('CAST(s AS BIGINT)')} s, {utf16('CAST(e AS BIGINT)')} e,"
    " row_number() OVER (PARTITION BY id ORDER BY s, e, reason) k FROM (SELECT DISTINCT * FROM spans) JOIN texts USING (id))"
)


@query(
    "e4_utf16_spans",
    f"{_UTF16} SELECT reason, count(*) n, CAST(sum(s) AS BIGINT) starts, CAST(sum(e) AS BIGINT) ends FROM ranked GROUP BY reason",
)
def utf16_spans(c):
    v = F.col("text")
    found = c.text("documents", ["text"]).select(F.explode(Z.utf16_spans(v, Z.issue_spans(v))).alias("s"))
    return found.groupBy("s.reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("s.start").alias("starts"), F.sum("s.end").alias("ends")
    )


@query(
    "e4_first_spans",
    f"{_UTF16} SELECT CAST(id AS VARCHAR) doc_id, count(*) n, CAST(sum(s) AS BIGINT) starts FROM ranked GROUP BY id",
)
def first_spans(c):
    """Spans shown over all texts."""
    v = F.col("text")
    found = c.text("documents", ["doc_id", "text"]).select("doc_id", ROW, Z.utf16_spans(v, Z.issue_spans(v)).alias("spans"))
    top = E.first_spans(found, ROW).select("doc_id", F.explode("spans").alias("s"))
    return top.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("s.start").alias("starts"))


@query("e5_known_identifiers", "SELECT DISTINCT lower(v) AS identifier FROM (SELECT c_name v FROM customer UNION ALL SELECT s_name FROM supplier)")
def known_identifiers(c):
    parts = []
    for t in ("customer", "supplier"):
        df = c.text(t)
        parts.append(E.source_identifiers(df, E.identifier_columns([n for n in df.columns if n != ROW])))
    return union(parts).distinct()


# Full case folding writes a sharp s as two letters, which lower() leaves alone.
_PHRASES = (
    f"ids AS (SELECT DISTINCT replace(lower(p), 'ß', 'ss') AS identifier FROM (SELECT regexp_replace(unnest(regexp_split_to_array(text, '[.,]')), {S.q(f'^[{S.SP}]+|[{S.SP}]+$')}, '', 'g') p FROM benchmark) WHERE p <> '')"
)


def distinct_texts(c):
    """``(digest, text)`` of the documents."""
    return c.text("documents", ["text"]).select(X.digest(F.col("text")).alias("digest"), "text").dropDuplicates(["digest"])


def phrases(c):
    """Clauses of the benchmark items stand in for known identifying phrases."""
    parts = c.text("benchmark", ["text"]).select(F.explode(F.split("text", "[.,]")).alias("phrase"))
    return E.source_identifiers(parts.withColumn(ROW, F.lit(0)), ["phrase"])


# Occurrences from the pieces between them; a folded sharp s has two places that both lead back to one character.
_HITS = (
    f"WITH {_PHRASES}, t AS (SELECT DISTINCT text, lower(text) low, replace(lower(text), 'ß', 'ss') folded FROM documents),"
    " pieces AS (SELECT text, low, folded, identifier, string_split(folded, identifier) g FROM t, ids WHERE contains(folded, identifier)),"
    " places AS (SELECT *, unnest(list_transform(range(1, len(g)), lambda i: CAST(list_sum(list_transform(g[:i], lambda x: length(x))) AS BIGINT) + (i - 1) * length(identifier))) s FROM pieces),"
    f" hits AS (SELECT text, low, identifier, s, s + length(identifier) e FROM places WHERE (s = 0 OR NOT regexp_matches(substr(folded, s, 1), {S.q(f'[{S.W}]')}))"
    f" AND NOT regexp_matches(substr(folded, s + length(identifier) + 1, 1), {S.q(f'[{S.W}]')}))"
)


@query("e6_identifier_hits", f"{_HITS} SELECT DISTINCT sha256(text) AS digest, identifier FROM hits")
def identifier_hits(c):
    return E.known_identifier_pairs(distinct_texts(c), phrases(c))


@query(
    "e6_identifier_spans",
    f"{_HITS}, origins AS (SELECT text, flatten(list_transform(string_split(low, ''), lambda x, i: CASE WHEN x = 'ß' THEN [i - 1, i - 1] ELSE [i - 1] END)) o"
    " FROM (SELECT DISTINCT text, low FROM hits))"
    " SELECT sha256(text) AS digest, identifier, CAST(o[s + 1] AS INT) start_at, CAST(o[e] + 1 AS INT) end_at FROM hits JOIN origins USING (text)",
)
def identifier_spans(c):
    """Where each identifier stands, in code points of the text as it is."""
    found = with_hits(distinct_texts(c), "digest", "text", phrases(c)).select("digest", F.explode("known").alias("k"))
    return found.select("digest", "k.identifier", F.col("k.start").alias("start_at"), F.col("k.end").alias("end_at"))


@query(
    "e7_review_binding",
    "WITH s AS (SELECT DISTINCT text FROM documents), r AS (SELECT DISTINCT text FROM documents JOIN labels USING (doc_id))"
    f" SELECT (SELECT count(*) FROM s WHERE text NOT IN (SELECT text FROM r)) AS unreviewed, 0 AS unknown_reviews,"
    f" (SELECT count(*) FROM s WHERE {S.unsafe_control('text')}) AS source_controls",
)
def review_binding(c):
    """Only labelled documents were reviewed: the other texts are unreviewed."""
    docs = c.text("documents", ["doc_id", "text"])
    labelled = docs.join(c.text("labels", ["doc_id"]).drop(ROW).distinct(), "doc_id", "left_semi")
    reviews = labelled.select(X.digest(F.col("text")).alias("digest")).distinct()
    return E.binding_counts(docs, "text", reviews)


@query(
    "e8_review_map",
    f"SELECT count(*) entries, 0 bad_digests, 0 repeated, count_if({S.text_issue('text')}) unclean, CAST(sum(strlen(text)) AS BIGINT) bytes FROM (SELECT DISTINCT text FROM documents)",
)
def review_map(c):
    texts = c.text("documents", ["text"]).select(X.digest(F.col("text")).alias("digest"), F.col("text").alias("approved"))
    return E.review_map_counts(texts.dropDuplicates(["digest"]))


def document_reviews(c, docs):
    """An approved text per distinct document text: its language is all that stays."""
    return docs.groupBy(X.digest(F.col("text")).alias("digest")).agg(
        F.concat(F.lit("Reviewed text in "), F.min("lang")).alias("approved")
    )


def protected_documents(c):
    docs = c.text("documents", ["doc_id", "text", "lang"])
    reviews = c.ws.keep(document_reviews(c, docs), "reviews")
    policy = PolicyBuilder(2).key("doc_id").review("text", REVIEW_TABLE).keep("lang", ["de", "en", "es", "fr", "it", "nl", "pt", "zh"]).build()
    return docs, reviews, protect(docs, policy, c.ws, reviews={"text": reviews})


@query(
    "d9_reviewed_text",
    "WITH r AS (SELECT text, 'Reviewed text in ' || min(lang) AS approved FROM documents GROUP BY text) SELECT CAST(doc_id AS VARCHAR) source_key, approved AS text FROM documents JOIN r USING (text)",
)
def reviewed_text(c):
    _, _, p = protected_documents(c)
    return p.stages["table"].select("source_key", "text")


@query("e9_candidate_check", "SELECT count(*) n_rows, 0 mismatches FROM documents")
def candidate_check(c):
    docs, reviews, p = protected_documents(c)
    return E.candidate_mismatches(docs, p.stages["table"], "text", reviews)


@query(
    "e9_candidate_violations",
    "SELECT count(*) n_rows, count_if(doc_id % 6 = 0) mismatches FROM documents",
)
def candidate_violations(c):
    """Protected texts of which some were changed after their approval."""
    docs, reviews, p = protected_documents(c)
    stage = p.stages["table"]
    touched = F.when(F.col("source_key").cast("long") % 6 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    return E.candidate_mismatches(docs, stage.withColumn("text", touched), "text", reviews)


@query(
    "e9_review_findings",
    f"{_HITS} SELECT sha256(text) AS digest, concat_ws(',', {', '.join(f'CASE WHEN {cond} THEN {S.q(k)} END' for k, cond in _CODES.items())}, CASE WHEN known THEN 'known_identifier' END) AS issues"
    f" FROM (SELECT DISTINCT text, text AS v, text IN (SELECT text FROM hits) AS known FROM documents) WHERE known OR {' OR '.join(f'({cond})' for cond in _CODES.values())}",
)
def review_findings(c):
    """Documents taken as approved texts, the benchmark's clauses as known identifiers: every issue of every text."""
    found = E.review_findings(distinct_texts(c).withColumnRenamed("text", "approved"), phrases(c))
    return found.select("digest", F.concat_ws(",", "issues").alias("issues"))


# --- K ---
_SOURCES = (("documents", "doc_id", "text"), ("pages", "page_id", "html"), ("conversations", "conv_id", "text"))
# Separators are doubled, so that neighbouring addresses do not share one.
_WIDE = f"regexp_replace(t, {S.q(f'([^{S.W}.+@-])')}, '\\1\\1', 'g')"
_MAILS = f"unnest(regexp_extract_all({_WIDE}, {S.q(S.MAILBOX)}, 1))"
_BODY = " UNION ALL ".join(f"SELECT '{t}' src, {i} id, {x} t FROM {t}" for t, i, x in _SOURCES)


@query(
    "k1_inventory",
    f"SELECT src, CAST(id AS VARCHAR) doc_id, count(DISTINCT m) emails, 0 orcids FROM (SELECT src, id, {_MAILS} m FROM ({_BODY})) GROUP BY src, id",
)
def inventory(c):
    return union(
        [
            D.inventory(D.whole_texts(c.text(t, [i, x]), i, x)).withColumn("src", F.lit(t))
            for t, i, x in _SOURCES
        ]
    )


@query(
    "k2_term_check",
    "SELECT count(*) terms, count_if(length(p_name) < 3 OR length(p_name) > 256 OR p_name <> trim(p_name) OR kind = 'size') bad_terms"
    " FROM (SELECT DISTINCT p_name, CASE WHEN p_size > 25 THEN 'other' ELSE 'size' END AS kind FROM part)",
)
def term_check(c):
    terms = c.text("part", ["p_name", "p_size"]).select(
        F.col("p_name").alias("value"), F.when(F.col("p_size").cast("int") > 25, "other").otherwise("size").alias("kind")
    ).distinct()
    return terms.agg(F.count(F.lit(1)).alias("terms"), F.count_if(D.bad_term(F.col("value"), F.col("kind"))).alias("bad_terms"))


@query(
    "k2_first_term_wins",
    "SELECT o_custkey AS doc_id, o_orderpriority AS value, arg_min(o_orderstatus, o_orderkey) AS kind FROM orders GROUP BY 1, 2",
)
def first_term_wins(c):
    """Repeated terms of a document: the first one's kind stays."""
    terms = c.raw("orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("kind"), F.col("o_orderpriority").alias("value")
    )
    return D.unique_terms(D.supplied_terms(terms)).select("doc_id", "value", "kind")


def discovered(c):
    return D.unique_terms(D.found_identifiers(D.whole_texts(c.text("documents", ["doc_id", "text"]), "doc_id", "text")))


@query("k3_discovered_terms", f"SELECT DISTINCT CAST(doc_id AS VARCHAR) doc_id, 'email' AS kind, m AS value FROM (SELECT doc_id, {_MAILS} m FROM (SELECT doc_id, text t FROM documents))")
def discovered_terms(c):
    return discovered(c).select("doc_id", "kind", "value")


@query("k4_tokens", f"SELECT count(DISTINCT (doc_id, m)) tokens, count(DISTINCT (doc_id, m)) distinct_tokens, count(DISTINCT (doc_id, m)) well_formed FROM (SELECT doc_id, {_MAILS} m FROM (SELECT doc_id, text t FROM documents))")
def tokens(c):
    drawn = D.draw_tokens(c.ws.keep(discovered(c), "terms"), c.ws)
    return drawn.agg(
        F.count(F.lit(1)).alias("tokens"), F.count_distinct("doc_id", "token").alias("distinct_tokens"),
        F.count_if(F.col("token").rlike(rf"^{D.TOKEN}\z")).alias("well_formed"),
    )


def redacted_documents(c, terms=None):
    docs = c.text("documents", ["doc_id", "text"])
    return docs, D.redact(D.whole_texts(docs, "doc_id", "text"), c.ws, terms)


def masked(text):
    """Tokens differ on every run: only their kind is compared."""
    return F.regexp_replace(text, rf"\[{D.PREFIX}-([A-Z]+)-[0-9A-F]{{8}}\]", "<$1>")


_FOUND = f"found AS (SELECT doc_id, list(DISTINCT m) ms FROM (SELECT doc_id, {_MAILS} m FROM (SELECT doc_id, text t FROM documents)) GROUP BY doc_id)"
_REPLACED = "list_reduce(list_prepend(text, list_sort(coalesce(ms, []), 'DESC')), lambda a, b: replace(a, b, '<EMAIL>'))"


@query("k5_redacted", f"WITH {_FOUND} SELECT CAST(doc_id AS VARCHAR) doc_id, sha256({_REPLACED}) AS digest, length({_REPLACED}) AS n_chars FROM documents LEFT JOIN found USING (doc_id)")
def redacted(c):
    _, out = redacted_documents(c)
    text = masked(F.col("text"))
    return out.runs.select("doc_id", X.digest(text).alias("digest"), F.length(text).alias("n_chars"))


@query(
    "k5_supplied_terms",
    "SELECT CAST(doc_id AS VARCHAR) doc_id, length(replace(replace(text, 'ther', '<PERSON>'), 'ention', '<TEXT>')) AS n_chars,"
    " sha256(replace(replace(text, 'ther', '<PERSON>'), 'ention', '<TEXT>')) AS digest FROM documents",
)
def supplied_terms(c):
    """Two terms given for every document, longest first."""
    docs = c.text("documents", ["doc_id", "text"])
    terms = docs.select("doc_id", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("person").alias("kind"), F.lit("ther").alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("other").alias("kind"), F.lit("ention").alias("value")),
    )).alias("t")).select("doc_id", "t.*")
    out = D.redact(D.whole_texts(docs, "doc_id", "text"), c.ws, terms)
    only = out.replacements.filter("kind = 'email'").select("doc_id", "at", "token", "original")
    # Addresses go back, so that the statement needs to know the two terms only.
    back = D.restore_texts(out.runs.select("doc_id", "text"), only.withColumn("count", F.lit(1)), check=False)
    text = masked(F.col("text"))
    return back.select("doc_id", F.length(text).alias("n_chars"), X.digest(text).alias("digest"))


@query(
    "k5_split_runs",
    "WITH r AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) t FROM conversations GROUP BY conv_id)"
    " SELECT CAST(conv_id AS VARCHAR) doc_id, sha256(replace(t, 'ther', '<PERSON>')) AS digest FROM r",
)
def split_runs(c):
    """Turns of a conversation as runs of one paragraph: matches may cross them."""
    runs = c.text("conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit("body").alias("part"), F.lit(1).alias("para"),
        F.col("turn").cast("int").alias("run"), "text",
    )
    terms = runs.select("doc_id").distinct().select("doc_id", F.lit(0).alias("ord"), F.lit("person").alias("kind"), F.lit("ther").alias("value"))
    out = D.redact(D.paragraphs(runs), c.ws, terms)
    joined = D.paragraphs(out.runs)
    return joined.select("doc_id", X.digest(masked(F.col("joined"))).alias("digest"))


_HOST = "regexp_extract(url, '//([^/?]+)', 1)"
_LINK = f"replace(replace(url, {_HOST}, '<ID>'), 'page', '<TEXT>')"


@query("k6_links", f"SELECT CAST(page_id AS VARCHAR) doc_id, {_LINK} AS text FROM pages")
def links(c):
    """Link targets: the host, then the word ``page``, replaced in that order."""
    pages = c.text("pages")
    host = F.regexp_extract("url", "//([^/?]+)", 1)
    terms = pages.select("page_id", F.explode(F.array(
        F.struct(F.lit(0).alias("ord"), F.lit("identifier").alias("kind"), host.alias("value")),
        F.struct(F.lit(1).alias("ord"), F.lit("other").alias("kind"), F.lit("page").alias("value")),
    )).alias("t")).select(F.col("page_id").alias("doc_id"), "t.*")
    none = D.whole_texts(pages.withColumn("t", F.lit("")), "page_id", "t")
    urls = pages.select(F.col("page_id").alias("doc_id"), F.lit("rels").alias("part"), F.lit(0).alias("ord"), F.col("url").alias("text"))
    out = D.redact(none, c.ws, terms, links=urls)
    return out.links.select("doc_id", masked(F.col("text")).alias("text"))


@query(
    "k7_replacement_counts",
    f"WITH {_FOUND}, e AS (SELECT doc_id, unnest(ms) m FROM found) SELECT CAST(doc_id AS VARCHAR) doc_id, m AS original, 'email' AS kind,"
    " CAST((length(text) - length(replace(text, m, ''))) / length(m) AS BIGINT) AS count FROM e JOIN documents USING (doc_id)",
)
def replacement_record(c):
    _, out = redacted_documents(c)
    return out.replacements.select("doc_id", "original", "kind", "count")


@query("k8_leaks", f"WITH {_FOUND} SELECT CAST(sum(len(ms)) AS BIGINT) originals, 0 still_present FROM found")
def leaks(c):
    _, out = redacted_documents(c)
    pairs = out.replacements.select("doc_id", "original").join(out.runs.select("doc_id", "text"), "doc_id")
    return pairs.agg(F.count(F.lit(1)).alias("originals"), F.count_if(F.contains("text", F.col("original"))).alias("still_present"))


@query("k9_round_trip", "SELECT CAST(doc_id AS VARCHAR) doc_id, sha256(text) AS digest FROM documents")
def round_trip(c):
    _, out = redacted_documents(c)
    back = D.restore_texts(out.runs.select("doc_id", "text"), out.replacements)
    return back.select("doc_id", X.digest(F.col("text")).alias("digest"))


@query("k9_token_check", f"WITH {_FOUND} SELECT CAST(sum(len(ms)) AS BIGINT) AS wrong_tokens, 0 originals_present FROM found")
def token_check(c):
    """Every token doubled on return: each is a wrong count."""
    _, out = redacted_documents(c)
    doubled = out.runs.select("doc_id", F.concat("text", "text").alias("text"))
    return D.restore_counts(doubled, out.replacements)


_HINTS = {"BUILDING": "Department of Building, ", "MACHINERY": "by Prof. Ada Example and ", "FURNITURE": "Acknowledgements to "}


def notes(c):
    """A note per nation: one paragraph per customer, some hinting at people or places."""
    hint = F.create_map(*[F.lit(x) for pair in _HINTS.items() for x in pair])
    return c.text("customer").select(
        F.col("c_nationkey").alias("doc_id"), F.lit("body").alias("part"), (F.col(ROW) + 1).alias("para"),
        F.concat(F.coalesce(hint[F.col("c_mktsegment")], F.lit("  ")), F.col("c_name"), F.lit(" ")).alias("text"),
    )


_NOTES = (
    "notes AS (SELECT CAST(c_nationkey AS VARCHAR) doc_id, 'body' part, c_custkey + 1 para, CASE c_mktsegment "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _HINTS.items())
    + " ELSE '  ' END || c_name || ' ' AS text, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') hit FROM customer),"
    " ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY para) k FROM notes WHERE hit)"
)


@query("k10_suggestions", f"WITH {_NOTES} SELECT doc_id, substr(sha256(part || ':' || para), 1, 16) AS id, part, para, trim(text) AS excerpt FROM ranked")
def suggested(c):
    return D.suggestions(notes(c))


@query(
    "k10_document_lines",
    "SELECT count(*) paragraphs, count_if(regexp_matches(t, '(?i)\\b(author|affiliation|acknowledge?ments?|university|institute|department)\\b')"
    " OR regexp_matches(t, '\\b(Dr|Prof|Professor|By)\\.?\\s+[A-Z][a-z]+(\\s+[A-Z][a-z]+){1,3}\\b')) hints FROM (SELECT unnest(string_split(text, chr(10))) t FROM documents)",
)
def document_lines(c):
    paras = D.numbered_paragraphs(c.text("documents", ["doc_id", "text"]), "doc_id", "text")
    text = F.col("text")
    return paras.agg(
        F.count(F.lit(1)).alias("paragraphs"), F.count_if(text.rlike(D.AFFILIATION) | text.rlike(D.TITLED_NAME)).alias("hints")
    )


@query(
    "k11_removed_paragraphs",
    f"WITH {_NOTES} SELECT n.doc_id, n.para FROM notes n WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.doc_id = n.doc_id AND r.para = n.para AND r.text LIKE 'Department%')",
)
def removed_paragraphs(c):
    paras = notes(c)
    offered = c.ws.keep(D.suggestions(paras), "offered")
    chosen = offered.filter(F.startswith("excerpt", F.lit("Department")))
    return D.remove_paragraphs(paras, chosen, offered).select("doc_id", "para")


@query(
    "k12_stripped_metadata",
    "SELECT CAST(doc_id AS VARCHAR) doc_id, CASE WHEN trim(source) <> '' THEN 2 ELSE 1 END AS filled, 'language=' || lang AS kept FROM documents",
)
def stripped_metadata(c):
    m = F.create_map(
        F.lit("creator"), F.col("source"), F.lit("revision"), F.col("n_chars"), F.lit("Manager"), F.lit(" "),
        F.lit("language"), F.col("lang"), F.lit("custom:source"), F.col("source"),
    )
    kept = F.transform(F.map_entries(D.strip_metadata(F.col("m"))), lambda e: F.concat_ws("=", e["key"], e["value"]))
    df = c.text("documents", ["doc_id", "lang", "source", "n_chars"]).withColumn("m", m)
    return df.select("doc_id", D.metadata_fields(F.col("m")).alias("filled"), F.array_join(kept, ",").alias("kept"))


@query(
    "k13_split_occurrences",
    "WITH r AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) t, sum((length(text) - length(replace(text, 'en', ''))) / 2) d FROM conversations GROUP BY conv_id)"
    " SELECT CAST(conv_id AS VARCHAR) doc_id, (length(t) - length(replace(t, 'en', ''))) / 2 > d AS split FROM r",
)
def split_occurrences(c):
    """Does ``en`` occur across two turns? Turns cut in halves at every character pair."""
    runs = c.text("conversations").select(
        F.col("conv_id").alias("doc_id"), F.lit("body").alias("part"), F.lit(1).alias("para"), F.col("turn").cast("int").alias("run"), "text"
    )
    return D.split_occurrences(D.paragraphs(runs), ["en"])


@query(
    "k14_record_check",
    "SELECT 0 malformed, 0 repeated_token, 0 repeated_original, (SELECT count(*) FROM documents) n_rows",
)
def record_check(c):
    docs, out = redacted_documents(c)
    return D.replacement_counts(out.replacements).withColumn("n_rows", F.lit(docs.count()))


@query(
    "k15_prepared_totals",
    f"WITH {_FOUND}, e AS (SELECT doc_id, unnest(ms) m FROM found), n AS (SELECT CAST((length(text) - length(replace(text, m, ''))) / length(m) AS BIGINT) k FROM e JOIN documents USING (doc_id))"
    " SELECT count(*) replacements, CAST(sum(k) AS BIGINT) occurrences, true AS unchanged, false AS changed FROM n",
)
def prepared_totals(c):
    """Totals shown before approval; the review digest notices a changed corpus."""
    docs, out = redacted_documents(c)
    before = B.table_digest(docs)

    def same(df):
        try:
            D.check_review_digest(before, B.table_digest(df))
            return True
        except Refused:
            return False

    other = docs.withColumn("text", F.concat("text", F.lit(" ")))
    return D.replacement_totals(out.replacements).withColumns({"unchanged": F.lit(same(docs)), "changed": F.lit(same(other))})


@query("k15_published_texts", "SELECT CAST(doc_id AS VARCHAR) doc_id, sha256(text) AS digest, length(text) AS n_chars FROM documents")
def published_texts(c):
    """Redacted, published with a sealed record, read back and restored."""
    docs, out = redacted_documents(c)
    at, record, secret = f"{c.ws.root}/texts/data", f"{c.ws.root}/record/map", token_hex(16)
    T.publish_texts(c.spark, out, docs, B.table_digest(docs), at, record, approved=True, secret=secret)
    restored = T.restore_published(c.spark, at, record, secret)
    return restored.select("doc_id", X.digest(F.col("text")).alias("digest"), F.length("text").alias("n_chars"))
