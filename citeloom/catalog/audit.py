"""Registered claim-audit and conversation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.catalog import fixtures as X
from citeloom.catalog.registry import Tables, query
from citeloom.functions import text as TX
from citeloom.operators import audit as A, conversation as V, retrieval as R
from citeloom.operators.backfill import embed_texts
from citeloom.plans import claim_audit as CA, keyword_index as K
from citeloom.session import materialize, scratch_path
from citeloom.sources import readers as S

# Documents with citation marks, table rows, headings and a bibliography, made from the given texts.
_MARKS = (
    (r" (of|und|de|la) ", r" {1} [\[3\]](#src-3) "),
    (r"([a-z])\. ", r"{1} [[7]](#src-7) [\[1\]](#src-1). "),
    (r"(?m)^([ADE][^\n]*)$", r"| {1} | [[2]](#src-2) [[2]](#src-2) |"),
    (r"(?m)^(S[^\n]*)$", r"# {1}"),
)


def cited_docs(t: Tables):
    text = F.col("text")
    for pattern, form in _MARKS:
        text = F.regexp_replace(text, pattern, form.replace("\\", "\\\\").replace("{1}", "$1"))
    doc = F.col("doc_id")
    entries = []
    for n in (1, 2, 3, 4, 5, 5, 6, 8):
        hint = F.lit("") if n % 3 == 0 else F.concat(
            F.lit(" `sources/src"), ((doc + n) % 20).cast("string"), F.lit("/"), (doc + n).cast("string"), F.lit(".pdf`"))
        entries.append(F.concat(F.lit(f'{n}. <a id="src-{n}"></a>Report {len(entries)} of '), doc.cast("string"), hint))
    return t.documents.select(
        doc.cast("string").alias("doc"), F.concat(text, F.lit("\n## Sources\n\n"), F.concat_ws("\n", *entries)).alias("text")
    )


def _marks_sql() -> str:
    out = "text"
    for pattern, form in _MARKS:
        replacement = form.replace("\\", "\\\\").replace("{1}", "\\1")
        out = f"regexp_replace({out}, '{pattern}', '{replacement}', 'g')"
    return out


_BIB_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, {n} AS n, {i} AS pos, 'Report {i} of ' || doc_id || "
    + ("''" if n % 3 == 0 else f"' `sources/src' || ((doc_id + {n}) % 20) || '/' || (doc_id + {n}) || '.pdf`'")
    + " AS body FROM documents"
    for i, n in enumerate((1, 2, 3, 4, 5, 5, 6, 8))
)
CITE_SQL = r"\\?\[\\?\[(\d+)\\?\]\\?\]\(#src-(\d+)\)"

CLAIMS_SQL = rf"""
bib_all AS ({_BIB_ROWS}),
bib AS (
  SELECT CAST(doc_id AS VARCHAR) AS doc, n, nullif(regexp_extract(body, '`(sources/[^`]+)`', 1), '') AS file, body AS descr
  FROM bib_all QUALIFY row_number() OVER (PARTITION BY doc_id, n ORDER BY pos DESC) = 1),
marked AS (SELECT CAST(doc_id AS VARCHAR) AS doc, {_marks_sql()} AS body FROM documents),
lines AS (
  SELECT doc, unnest(generate_series(1, len(ls))) AS ln, unnest(ls) AS line
  FROM (SELECT doc, string_split(body, chr(10)) AS ls FROM marked)),
pieces AS (
  SELECT doc, ln, true AS is_table, 1 AS pos, line AS s FROM lines WHERE starts_with(line, '|')
  UNION ALL
  SELECT doc, ln, false, unnest(generate_series(1, len(ss))), unnest(ss) FROM (
    SELECT doc, ln, string_split(regexp_replace(line, '([.;:])\s+([A-Z0-9"(])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS ss
    FROM lines WHERE NOT starts_with(line, '|') AND NOT starts_with(line, '#') AND NOT starts_with(line, '---'))),
cited AS (
  SELECT doc, ln, pos, is_table, CAST(regexp_extract_all(s, '{CITE_SQL}', 2) AS INTEGER[]) AS cs,
         regexp_replace(s, '{CITE_SQL}', '', 'g') AS bare
  FROM pieces WHERE regexp_matches(s, '{CITE_SQL}')),
clean AS (
  SELECT doc, ln, pos, is_table,
         CASE WHEN is_table THEN cs ELSE list_sort(list_distinct(cs)) END AS cites,
         CASE WHEN is_table THEN replace(trim(bare, '| '), '|', ' / ') ELSE regexp_replace(trim(bare, E' \n\t\r\f'), '\s+', ' ', 'g') END AS c
  FROM cited),
claim_rows AS (
  SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY ln, pos) - 1 AS INTEGER) AS i,
         c AS claim, cites
  FROM clean WHERE length(c) > 0)"""


@query("extract_claims", f"""
WITH {CLAIMS_SQL}
SELECT substring(sha1(doc || ':' || i || ':' || claim), 1, 16) AS cid, doc, i, claim,
       array_to_string(cites, ',') AS cites FROM claim_rows""")
def extract_claims(t: Tables):
    return A.claims(cited_docs(t)).select(
        "cid", "doc", "i", "claim", F.array_join(F.col("cites").cast("array<string>"), ",").alias("cites"))


@query("parse_bibliography", f"""
WITH {CLAIMS_SQL} SELECT doc, n, file, descr AS "desc" FROM bib""")
def parse_bibliography(t: Tables):
    return A.parse_bibliography(cited_docs(t))


@query("claim_source_join", f"""
WITH {CLAIMS_SQL},
x AS (SELECT doc, i, unnest(generate_series(1, len(cites))) AS pos, unnest(cites) AS n FROM claim_rows)
SELECT doc, i, coalesce(string_agg(file, '|' ORDER BY pos), '') AS cited_files
FROM x LEFT JOIN bib USING (doc, n) GROUP BY doc, i""")
def claim_source_join(t: Tables):
    return A.claims(cited_docs(t)).select("doc", "i", F.array_join("cited_files", "|").alias("cited_files"))


@query("citation_integrity", f"""
WITH {CLAIMS_SQL}
SELECT DISTINCT doc, n, 'no entry' AS problem FROM (SELECT doc, unnest(cites) AS n FROM claim_rows) ANTI JOIN bib USING (doc, n)
UNION ALL
SELECT doc, n, 'no file' FROM bib WHERE file IS NOT NULL AND file NOT IN (SELECT {X.FILE_SQL} FROM documents)""")
def citation_integrity(t: Tables):
    docs = cited_docs(t)
    manifest = t.documents.select(X.file_of().alias("file"))
    return A.citation_integrity(A.claims(docs), A.parse_bibliography(docs), manifest)


@query("reverify_changed", f"""
WITH {CLAIMS_SQL},
old AS (SELECT substring(sha1(doc || ':' || i || ':' || CASE WHEN CAST(doc AS BIGINT) % 4 = 0 THEN claim || ' 1' ELSE claim END), 1, 16) AS cid FROM claim_rows)
SELECT substring(sha1(doc || ':' || i || ':' || claim), 1, 16) AS cid, doc, i
FROM claim_rows WHERE substring(sha1(doc || ':' || i || ':' || claim), 1, 16) NOT IN (SELECT cid FROM old)""")
def reverify_changed(t: Tables):
    """The claims of every fourth document ended differently when they were judged."""
    from citeloom.functions.ids import claim_id

    # written once: both sides of the comparison come from it
    now = materialize(A.claims(cited_docs(t)).select("cid", "doc", "i", "claim"), "claims-now")
    was = F.when(F.col("doc").cast("bigint") % 4 == 0, F.concat("claim", F.lit(" 1"))).otherwise(F.col("claim"))
    judged = now.select(claim_id(F.col("doc"), F.col("i"), was).alias("cid"))
    return A.reverify_changed(now, judged).select("cid", "doc", "i")


# ---------------------------------------------------------------- evidence


def _claims_with_vectors(t: Tables):
    """A benchmark text is a claim; it cites one source folder, a text of it may come from there."""
    folder = F.concat(F.lit("sources/src"), (F.col("qid") % 20).cast("string"), F.lit("/"))
    return X.benchmark_vectors(t).withColumn("cited_files", F.array(folder))


_EVIDENCE_SQL = f"""
WITH {X.vector_sql(X.QUERY_VECTORS, X.ITEM_VECTORS, 12)}, {X.bm25_sql(X.QUERY_TEXTS, X.DOC_TEXTS, 12, 4)}, {X.CHUNKS_SQL},
cand AS (
  SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY min(o)) - 1 AS INTEGER) AS ordinal FROM (
    SELECT qid, id, rank0 AS o FROM vector_hits UNION ALL SELECT qid, id, rank0 + 1000 FROM text_hits) GROUP BY qid, id),
ev AS (
  SELECT * FROM (
    SELECT qid, id, file, page_start, text, ordinal,
      CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN contains(file, 'sources/src' || (qid % 20) || '/') THEN 0 ELSE 1 END, ordinal) - 1 AS INTEGER) AS rank0
    FROM cand JOIN chunk_rows USING (id)) WHERE rank0 < 8)"""


@query("union_candidates", _EVIDENCE_SQL + " SELECT qid, id, ordinal FROM cand")
def union_candidates(t: Tables):
    queries = X.benchmark_vectors(t)
    v = R.vector_topk(queries.filter(F.col("vector").isNotNull()).select("qid", "vector"), X.vectors(t), 12)
    x = K.topk(X.keyword_index(t), queries.select("qid", "text"), 12, 4)
    return A.union_candidates(v, x)


@query("cited_source_priority", f"""
SELECT qid, id, rank0 FROM (
  SELECT item_id AS qid, doc_id AS id, CAST(row_number() OVER (PARTITION BY item_id
    ORDER BY CASE WHEN contains({X.FILE_SQL}, 'sources/src' || (item_id % 20) || '/') THEN 0 ELSE 1 END, doc_id) - 1 AS INTEGER) AS rank0
  FROM documents JOIN benchmark ON doc_id % (SELECT count(*) FROM benchmark) = item_id) WHERE rank0 < 8""")
def cited_source_priority(t: Tables):
    claims = _claims_with_vectors(t).select("qid", "cited_files")
    docs = t.documents.select((F.col("doc_id") % t.benchmark.count()).alias("qid"), F.col("doc_id").alias("id"), X.file_of().alias("file"),
                              F.col("doc_id").alias("ordinal"))
    return A.prioritise(docs.join(claims, "qid")).select("qid", "id", "rank0")


@query("retrieve_evidence", _EVIDENCE_SQL + """
SELECT qid, string_agg(file || ' p.' || page_start || ' ' || text, chr(30) ORDER BY rank0) AS passages
FROM ev GROUP BY qid""")
def retrieve_evidence(t: Tables):
    found = A.passages(A.retrieve_evidence(_claims_with_vectors(t), X.documents_as_chunks(t), X.vectors(t), K.searcher(X.keyword_index(t), 4)))
    line = F.transform("passages", lambda p: F.concat(p["file"], F.lit(" p."), p["p"].cast("string"), F.lit(" "), p["text"]))
    return found.select("qid", F.array_join(line, "\x1e").alias("passages"))


def length_judge(prompts: list[str]) -> list[str]:
    """A stand-in for a judge that SQL can state: the claim's length decides, the first passage's file is the evidence."""
    replies = []
    for prompt in prompts:
        claim, _, rest = prompt.partition(A.FOUND)
        n = len(claim) - len(A.STATEMENT)
        verdict = ("SUPPORTED", "PARTIAL", "NOT_FOUND")[n % 3]
        file = rest.removeprefix("1) ").split(", page ", 1)[0]
        replies.append(f'{{"verdict": "{verdict}", "confidence": {n % 100 / 100}, "evidence": "{file}", "issue": "{n}"}}')
    return replies


@query("batch_verdicts", _EVIDENCE_SQL + """
SELECT CAST(item_id AS VARCHAR) AS cid, CASE length(b.text) % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS verdict,
  CAST(length(b.text) % 100 AS DOUBLE) / 100 AS confidence, file AS evidence, CAST(length(b.text) AS VARCHAR) AS issue
FROM benchmark b JOIN ev ON qid = item_id AND rank0 = 0 WHERE item_id NOT IN (SELECT doc_id FROM labels WHERE doc_id % 10 = 0)""")
def batch_verdicts(t: Tables):
    """An injected judge over every claim that has no verdict yet."""
    claims = _claims_with_vectors(t)
    work = A.passages(A.retrieve_evidence(claims, X.documents_as_chunks(t), X.vectors(t), K.searcher(X.keyword_index(t), 4))).join(
        claims.select("qid", F.col("text").alias("claim")), "qid"
    ).select(F.col("qid").cast("string").alias("cid"), "claim", "passages")
    judged = t.labels.filter(F.col("doc_id") % 10 == 0).select(F.col("doc_id").cast("string").alias("cid"))
    return A.batch_verdicts(work, judged, length_judge)


@query("claim_audit", f"""
WITH {CLAIMS_SQL}
SELECT substring(sha1(doc || ':' || i || ':' || claim), 1, 16) AS cid, doc, claim, array_to_string(cites, ',') AS cites,
  CASE length(claim) % 3 WHEN 0 THEN 'SUPPORTED' WHEN 1 THEN 'PARTIAL' ELSE 'NOT_FOUND' END AS verdict, CAST(length(claim) AS VARCHAR) AS issue
FROM claim_rows""")
def claim_audit(t: Tables):
    """Both steps of the audit, run over a third of the documents and then over all, with the logs between: what was done
    is not done again, and the log ends as if it had been written in one go."""
    docs, embed = cited_docs(t), X.letter_embedder("etaoin")
    items, chunks = X.documents_as_items(t), X.documents_as_chunks(t)
    vectors = embed_texts(items, embed, 6).select("id", F.col("embedding").alias("vector"))
    vectors = materialize(vectors, "audit-vectors")
    retrieved = judged = None
    for some in (docs.filter(F.col("doc").cast("bigint") % 3 == 0), docs):
        known = retrieved if retrieved is not None else t.spark.createDataFrame([], "cid string")
        new = CA.retrieve_step(some, known, chunks, vectors, embed, 6, K.searcher(X.keyword_index(t), 4))
        new = materialize(new, "audit-retrieved")
        retrieved = new if retrieved is None else retrieved.unionByName(new)
        done = judged if judged is not None else t.spark.createDataFrame([], "cid string")
        new = materialize(CA.judge_step(retrieved, done, chunks, length_judge), "audit-judged")
        judged = new if judged is None else judged.unionByName(new)
    return judged.select("cid", "doc", "claim", F.array_join(F.col("cites").cast("array<string>"), ",").alias("cites"), "verdict", "issue")


_REPLIES_SQL = """
replies AS (
  SELECT event_id, event_id % 6 AS kind, CASE event_type WHEN 'error' THEN 'CONTRADICTED' WHEN 'view' THEN 'NOT_FOUND' WHEN 'click' THEN 'PARTIAL' ELSE 'SUPPORTED' END AS v,
         CAST(event_id % 100 AS DOUBLE) / 100 AS conf, event_type FROM events)"""


@query("parse_verdict", f"""
WITH {_REPLIES_SQL}
SELECT event_id, CASE WHEN kind = 4 THEN NULL ELSE v END AS verdict,
       CASE WHEN kind = 4 THEN NULL WHEN kind IN (3, 5) THEN CAST(0.5 AS DOUBLE) ELSE conf END AS confidence,
       CASE WHEN kind = 4 THEN NULL WHEN kind IN (3, 5) THEN '' ELSE event_type END AS evidence,
       CASE WHEN kind = 4 THEN NULL WHEN kind IN (3, 5) THEN 'salvaged from non-JSON reply' ELSE 'i' || event_id END AS issue
FROM replies""")
def parse_verdict(t: Tables):
    """Six shapes of reply: JSON, after thinking, inside prose, keyword only, garbage, broken JSON."""
    verdict = F.when(F.col("event_type") == "error", "CONTRADICTED").when(F.col("event_type") == "view", "NOT_FOUND") \
        .when(F.col("event_type") == "click", "PARTIAL").otherwise("SUPPORTED")
    body = F.to_json(F.struct(
        verdict.alias("verdict"), ((F.col("event_id") % 100) / 100).alias("confidence"), F.col("event_type").alias("evidence"),
        F.concat(F.lit("i"), F.col("event_id").cast("string")).alias("issue")))
    kind = F.col("event_id") % 6
    reply = (
        F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("<think>is it {so}?\n</think>\n"), body))
        .when(kind == 2, F.concat(F.lit("Here you are:\n"), body, F.lit("\nDone.")))
        .when(kind == 3, F.concat(F.lit("I would say "), verdict, F.lit(".")))
        .when(kind == 4, F.lit("no idea")).otherwise(F.concat(F.lit('{"verdict": "'), verdict))
    )
    return t.events.select("event_id", A.parse_verdict(reply).alias("v")).select("event_id", "v.*")


@query("verdict_distribution", """
WITH v AS (SELECT CASE event_type WHEN 'error' THEN 'CONTRADICTED' WHEN 'view' THEN 'NOT_FOUND' WHEN 'click' THEN 'PARTIAL' ELSE 'SUPPORTED' END AS verdict FROM events)
SELECT verdict, count(*) AS claims, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM v), 5) AS share FROM v GROUP BY verdict""")
def verdict_distribution(t: Tables):
    verdict = F.when(F.col("event_type") == "error", "CONTRADICTED").when(F.col("event_type") == "view", "NOT_FOUND") \
        .when(F.col("event_type") == "click", "PARTIAL").otherwise("SUPPORTED")
    out = A.verdict_distribution(t.events.select(verdict.alias("verdict")))
    return out.withColumn("share", F.round("share", 5))


@query("adjudication_precision", """
WITH r AS (SELECT source AS doc, CASE WHEN toxic = 1 THEN 'real' WHEN doc_id % 7 = 0 THEN 'uncertain' ELSE 'false' END AS ruling
  FROM labels JOIN documents USING (doc_id) WHERE quality = 1)
SELECT doc, count(*) AS flagged, count(*) FILTER (WHERE ruling = 'real') AS real, count(*) FILTER (WHERE ruling = 'false') AS false_flags,
  count(*) FILTER (WHERE ruling = 'uncertain') AS uncertain,
  round(CAST(count(*) FILTER (WHERE ruling = 'real') AS DOUBLE) / count(*), 5) AS real_rate,
  round(CAST(count(*) FILTER (WHERE ruling = 'false') AS DOUBLE) / count(*), 5) AS false_rate FROM r GROUP BY doc""")
def adjudication_precision(t: Tables):
    flagged = t.labels.filter(F.col("quality") == 1).join(t.documents.select("doc_id", "source"), "doc_id")
    ruling = F.when(F.col("toxic") == 1, "real").when(F.col("doc_id") % 7 == 0, "uncertain").otherwise("false")
    out = A.adjudication_precision(flagged.select(F.col("source").alias("doc"), ruling.alias("ruling")))
    return out.withColumn("real_rate", F.round("real_rate", 5)).withColumn("false_rate", F.round("false_rate", 5))


_RULINGS_SQL = """
WITH r AS (SELECT CASE WHEN quality = 1 THEN 'CONTRADICTED' ELSE 'PARTIAL' END AS verdict,
    CASE WHEN toxic = 1 THEN 'real' WHEN doc_id % 7 = 0 THEN 'uncertain' ELSE 'false' END AS ruling, quality = 0 AND doc_id % 5 > 0 AS benign FROM labels)"""


def _rulings(t: Tables):
    verdict = F.when(F.col("quality") == 1, "CONTRADICTED").otherwise("PARTIAL")
    ruling = F.when(F.col("toxic") == 1, "real").when(F.col("doc_id") % 7 == 0, "uncertain").otherwise("false")
    return t.labels.select(verdict.alias("verdict"), ruling.alias("ruling"), ((F.col("quality") == 0) & (F.col("doc_id") % 5 > 0)).alias("benign"))


@query("adjudication_by_verdict", _RULINGS_SQL + """
SELECT verdict, count(*) AS flagged, count(*) FILTER (WHERE ruling = 'real') AS real, count(*) FILTER (WHERE ruling = 'false') AS false_flags,
  count(*) FILTER (WHERE ruling = 'uncertain') AS uncertain,
  round(CAST(count(*) FILTER (WHERE ruling = 'real') AS DOUBLE) / count(*), 5) AS real_rate,
  round(CAST(count(*) FILTER (WHERE ruling = 'false') AS DOUBLE) / count(*), 5) AS false_rate FROM r WHERE NOT benign GROUP BY verdict""")
def adjudication_by_verdict(t: Tables):
    """Rulings per verdict class; screened partial verdicts that are benign were not adjudicated."""
    out = A.adjudication_precision(_rulings(t).filter(~F.col("benign")), ("verdict",))
    return out.withColumn("real_rate", F.round("real_rate", 5)).withColumn("false_rate", F.round("false_rate", 5))


@query("partial_triage", _RULINGS_SQL + """
SELECT verdict, count(*) AS screened, count(*) FILTER (WHERE benign) AS benign, count(*) FILTER (WHERE NOT benign) AS adjudicated,
  count(*) FILTER (WHERE NOT benign AND ruling = 'real') AS real FROM r WHERE verdict = 'PARTIAL' GROUP BY verdict""")
def partial_triage(t: Tables):
    return A.triage(_rulings(t).filter(F.col("verdict") == "PARTIAL"), ("verdict",))


@query("share_of_total", """
SELECT user_id, event_type, round(sum(value), 4) AS total, round(sum(value) / sum(sum(value)) OVER (PARTITION BY user_id), 5) AS share
FROM events GROUP BY user_id, event_type""")
def share_of_total(t: Tables):
    out = A.share_of_total(t.events, "user_id", "event_type", "value")
    return out.select("user_id", "event_type", F.round("total", 4).alias("total"), F.round("share", 5).alias("share"))


@query("scan_claim_logs", f"""
WITH {CLAIMS_SQL}
SELECT substring(sha1(doc || ':' || i || ':' || claim), 1, 16) AS cid, 'claim' AS log FROM claim_rows
UNION ALL SELECT CAST(doc_id AS VARCHAR), 'verdict' FROM labels WHERE doc_id % 9 <> 0""")
def scan_claim_logs(t: Tables):
    """Claim and verdict logs written from the tables and read in both modes; cut-off verdict lines are left out."""
    claims_path, verdicts_path = scratch_path(t.spark, "claims"), scratch_path(t.spark, "verdicts")
    A.claims(cited_docs(t)).drop("i").withColumn(
        "passages", F.array().cast("array<struct<file:string,p:int,text:string>>")).write.json(claims_path)
    t.labels.select(F.when(F.col("doc_id") % 9 == 0, "{cut").otherwise(F.to_json(F.struct(
        F.col("doc_id").cast("string").alias("cid"), F.lit("PARTIAL").alias("verdict"), F.lit(0.5).alias("confidence")
    ))).alias("value")).write.text(verdicts_path)
    claims, verdicts = S.scan_claim_logs(t.spark, claims_path, verdicts_path)
    return claims.select("cid", F.lit("claim").alias("log")).unionByName(verdicts.select("cid", F.lit("verdict").alias("log")))


# ---------------------------------------------------------------- conversations


@query("last_user_turn", r"""
SELECT conv_id, turn, trim(concat_ws(' ', prior, text), E' \n\t\r') AS query FROM (
  SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations) WHERE role = 'user'""")
def last_user_turn(t: Tables):
    return V.retrieval_queries(t.conversations)


@query("history_window", """
WITH h AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations)
SELECT a.conv_id, a.turn, coalesce(string_agg(b.role || ': ' || b.text, chr(30) ORDER BY b.n)
   FILTER (WHERE b.role IN ('user', 'assistant') AND b.text <> ''), '') AS history
FROM h a LEFT JOIN h b ON a.conv_id = b.conv_id AND b.n BETWEEN a.n - 6 AND a.n - 1 GROUP BY a.conv_id, a.turn""")
def history_window(t: Tables):
    line = F.transform("history", lambda h: F.concat(h["role"], F.lit(": "), h["content"]))
    return V.history(t.conversations).select("conv_id", "turn", F.array_join(line, "\x1e").alias("history"))


@query("answer_citation_join", r"""
WITH a AS (SELECT conv_id, turn, regexp_replace(text, '\. ', ' [' || (turn * 3 + conv_id % 7) || ']. ', 'g') AS text FROM conversations WHERE role = 'assistant'),
m AS (SELECT conv_id, turn, CAST(unnest(generate_series(1, len(ns))) - 1 AS INTEGER) AS pos, CAST(unnest(ns) AS INTEGER) AS ordinal
      FROM (SELECT conv_id, turn, regexp_extract_all(text, '\[(\d+)\]', 1) AS ns FROM a)),
c AS (SELECT max(conv_id) + 1 AS n FROM conversations),
s AS (SELECT doc_id % n AS qid, CAST(doc_id // n + 1 AS INTEGER) AS ordinal, source AS file FROM documents, c)
SELECT conv_id AS qid, turn, pos, m.ordinal, file FROM m LEFT JOIN s ON s.qid = conv_id AND s.ordinal = m.ordinal""")
def answer_citation_join(t: Tables):
    mark = F.concat(F.lit(" ["), (F.col("turn") * 3 + F.col("conv_id") % 7).cast("string"), F.lit("]. "))
    answers = t.conversations.filter(F.col("role") == "assistant").select(
        F.col("conv_id").alias("qid"), "turn", F.regexp_replace(F.col("text"), F.lit(r"\. "), mark).alias("text"))
    n = t.conversations.agg(F.max("conv_id") + 1).first()[0]
    sources = t.documents.select((F.col("doc_id") % n).alias("qid"), (F.floor(F.col("doc_id") / n) + 1).cast("int").alias("ordinal"),
                                 F.col("source").alias("file"))
    return V.answer_citations(answers, sources)


_CONV_QUERIES = """(SELECT conv_id * 1048576 + turn AS qid, trim(concat_ws(' ', prior, text), E' \\n\\t\\r') AS text FROM (
  SELECT *, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (
    PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM conversations) WHERE role = 'user')"""
_CONV_VECTORS = "(SELECT conv_id * 1048576 + turn AS qid, embedding AS vector FROM conversations JOIN embeddings ON vec_id = conv_id WHERE role = 'user')"


@query("conversational_query", f"""
WITH {X.vector_sql(_CONV_VECTORS, X.ITEM_VECTORS, 36)}, {X.bm25_sql(_CONV_QUERIES, X.DOC_TEXTS, 36)}, {X.rrf_sql(12)}
SELECT qid, id, rank0, round(score, 5) AS score FROM fused""")
def conversational_query(t: Tables):
    """Every user turn, folded with the user turn before it, through hybrid search."""
    qid = (F.col("conv_id") * 1_048_576 + F.col("turn")).alias("qid")
    texts = V.retrieval_queries(t.conversations).select(qid, "conv_id", F.col("query").alias("text"))
    vectors = t.embeddings.select(F.col("vec_id").alias("conv_id"), F.col("embedding").alias("vector"))
    # Questions are read several times by the search; written once, they are not derived again each time.
    queries = materialize(texts.join(vectors, "conv_id", "left").select("qid", "text", "vector"), "questions")
    hits = R.hybrid_search(queries, None, X.vectors(t), 12, K.searcher(X.keyword_index(t)))
    return hits.select("qid", "id", "rank0", F.round("score", 5).alias("score"))


@query("context_assembly", rf"""
WITH {X.vector_sql(X.QUERY_VECTORS, X.ITEM_VECTORS, 36)}, {X.bm25_sql(X.QUERY_TEXTS, X.DOC_TEXTS, 36)}, {X.rrf_sql(12)}, {X.CHUNKS_SQL}
SELECT qid, string_agg('[' || place || '] (' || file || ' p.' || page_start || ') ' || regexp_replace(text, '\s+', ' ', 'g'),
  chr(10) || chr(10) ORDER BY rank0) AS context
FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank0) AS place FROM fused JOIN chunk_rows USING (id)) GROUP BY qid""")
def context_assembly(t: Tables):
    hits = R.hybrid_search(X.benchmark_vectors(t), None, X.vectors(t), 12, K.searcher(X.keyword_index(t)))
    return R.context_block(R.hydrate(hits, X.documents_as_chunks(t)))
