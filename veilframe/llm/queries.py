"""The registered queries of this subpackage and, where SQL can say it, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import audit, chat, decontam, fim, langid, packing, quality, secrets, tokenbin, topk, toxicity, warc
from veilframe.llm.common import fold
from veilframe.llm.near_dedup import near_duplicates


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


#: The tools that calls derived from ``conversations`` may name.
TOOLS = {
    "search": {"properties": {"after": "object", "limit": "integer", "query": "string"}, "required": ["query"]},
    "calculate": {"properties": {"expression": "string"}, "required": ["expression"]},
}


def derived_calls(conversations: DataFrame) -> DataFrame:
    """``conversations``, which hold no tool traffic, with traffic derived from all their rows.

    With i = turn div 2, an assistant message of turn t keeps its text as content and calls ``search`` under
    the id s<t> (``lookup``, which no schema names, where t mod 6 = 5). Its query is the text; it refers to s<t + 2>
    if i mod 4 = 1, to s<t - 4> if i mod 4 = 2, to s<t - 2> otherwise, which may or may not exist. The limit is a
    word if t mod 3 = 2; t mod 5 = 4 adds a field that no schema names. Where i mod 3 = 0 a call of
    ``calculate``, k<t>, comes before it, whose arguments are a string with JSON that refers to s<t>: an object in
    place of a string. A user message of turn t > 0 answers s<t - 1> unless t mod 7 = 6. All else stays.
    """
    t, text = F.col("turn"), F.col("text")
    i = F.floor(t / 2)
    back = F.when(i % 4 == 1, t + 2).when(i % 4 == 2, t - 4).otherwise(t - 2)
    s = lambda turn, head="s": F.concat(F.lit(head), turn.cast("string"))
    limit = F.when(t % 3 == 2, F.lit('"many"')).otherwise(t.cast("string"))
    page = F.when(t % 5 == 4, F.lit(', "page": 1')).otherwise(F.lit(""))
    json = lambda c: F.substring(j := F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}), F.lit(6), F.length(j) - 6)
    search = F.concat(F.lit('{"name": "'), F.when(t % 6 == 5, "lookup").otherwise("search"), F.lit('", "id": "'), s(t), F.lit('", "arguments": {"query": '), json(text), F.lit(', "limit": '), limit, page, F.lit(', "after": {"$ref": "'), s(back), F.lit('"}}}'))
    calculate = F.when(i % 3 == 0, F.concat(F.lit('{"id": "'), s(t, "k"), F.lit('", "name": "calculate", "arguments": "{\\"expression\\": {\\"$ref\\": \\"'), s(t), F.lit('\\"}}"}, '))).otherwise(F.lit(""))
    asks = F.concat(F.lit('{"tool_calls": ['), calculate, search, F.lit('], "content": '), json(text), F.lit("}"))
    tells = F.concat(F.lit('{"tool_call_id": "'), s(t - 1), F.lit('", "content": '), json(text), F.lit("}"))
    calls = (F.col("role") == "assistant") & t.isNotNull()
    answers = (F.col("role") == "user") & (t > 0) & (t % 7 != 6)
    return conversations.select("conv_id", "turn", F.when(answers, "tool").otherwise(F.col("role")).alias("role"), F.when(calls, asks).when(answers, tells).otherwise(text).alias("text"))


def op3_chat_tool_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = derived_calls(table(spark, sf_dir, "conversations"))
    return chat.format_chat(messages, TOOLS).select("conv_id", "turn", "role", "ord_turn", "ord_level", "message", "n_calls", F.array_join("problems", "; ").alias("problems"))


def op4_pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, quality.learnable(labels, "toxic", 4, 2), docs.filter(fold("doc_id", 4) != 2))
    return toxicity.score(docs, model).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op5_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = langid.train(docs.filter(fold("doc_id", 4) != 2))
    return langid.classify(docs, learned).select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op7_elias_fano_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.with_digest(tokenbin.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op9_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranker = quality.train(docs, quality.learnable(labels, "quality", 5, 0))
    return quality.score(docs, ranker).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "n_item", "n_shared", F.round("containment", 6).alias("containment"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(table(spark, sf_dir, "documents")))


def op12_warc_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return warc.page_rows(warc.resolved(warc.round_trip(pages)), pages.schema["page_id"].dataType.simpleString())


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_chat_tool_linking": op3_chat_tool_linking,
        "op4_pu_toxicity": op4_pu_toxicity,
        "op5_compression_langid": op5_compression_langid,
        "op6_maxscore_top_k": op6_maxscore_top_k,
        "op7_elias_fano_tokens": op7_elias_fano_tokens,
        "op8_secret_scan": op8_secret_scan,
        "op9_bradley_terry_quality": op9_bradley_terry_quality,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_warc_reassembly": op12_warc_reassembly,
        "op13_filter_audit": op13_filter_audit,
    }


#: Containment on whole tables: words and 5-word shingles of every document and item.
_SHINGLES = """
  {name}_words AS (
    SELECT {id} AS id, row_number() OVER () AS part, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM {source} WHERE text IS NOT NULL
  ),
  {name} AS (
    SELECT DISTINCT id, part, s FROM (
      SELECT id, part, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
      FROM {name}_words)
  )"""

_DECONTAMINATION = (
    "WITH" + _SHINGLES.format(name="d", id="doc_id", source="documents") + "," + _SHINGLES.format(name="b", id="item_id", source="(SELECT DISTINCT item_id, text FROM benchmark)") + """,
  size AS (SELECT part, count(*) AS n FROM b GROUP BY part),
  met AS (SELECT d.id AS doc_id, d.part AS dp, b.id AS item_id, b.part AS bp, count(*) AS shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_item, shared AS n_shared, round(shared::DOUBLE / n, 6) AS containment
FROM met JOIN size ON bp = part WHERE 100 * shared >= 80 * n"""
)

_TOP_K = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT DISTINCT * FROM scored)
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5"""

#: The traffic of ``derived_calls`` in SQL: who answers and needs whom, places by recursion along the needs,
#: and the serialised messages with what is wrong with them.
_CHAT = """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, conv_id, turn AS t, turn // 2 AS i, role, text, role = 'assistant' AS asks, role = 'user' AND turn > 0 AND turn % 7 <> 6 AS tells FROM conversations),
calls AS (SELECT r, conv_id, t, i, CASE i % 4 WHEN 1 THEN t + 2 WHEN 2 THEN t - 4 ELSE t - 2 END AS ref FROM d WHERE asks AND t IS NOT NULL),
first_call AS (SELECT conv_id, t, min(r) AS r FROM calls WHERE conv_id IS NOT NULL GROUP BY ALL),
first_told AS (SELECT conv_id, t - 1 AS t, min(r) AS r FROM d WHERE tells AND conv_id IS NOT NULL GROUP BY ALL),
needs AS (
  SELECT c.r, c.t, coalesce(b.r, a.r) AS needs FROM calls c LEFT JOIN first_call a ON a.conv_id = c.conv_id AND a.t = c.ref LEFT JOIN first_told b ON b.conv_id = a.conv_id AND b.t = a.t
  UNION ALL SELECT d.r, d.t, a.r FROM d LEFT JOIN first_call a ON a.conv_id = d.conv_id AND a.t = d.t - 1 WHERE tells
), place(r, ord_turn, ord_level) AS (
  SELECT r, t, 0 FROM needs WHERE needs IS NULL
  UNION ALL SELECT n.r, greatest(n.t, p.ord_turn), CASE WHEN p.ord_turn >= n.t THEN p.ord_level + 1 ELSE 0 END FROM needs n JOIN place p ON n.needs = p.r
), asked AS (
  SELECT c.r, CASE WHEN c.i % 3 = 0 THEN 2 ELSE 1 END AS n_calls,
    '{"arguments":{"after":{"$ref":"s' || ref || '"},"limit":' || CASE WHEN c.t % 3 = 2 THEN '"many"' ELSE c.t::VARCHAR END || CASE WHEN c.t % 5 = 4 THEN ',"page":1' ELSE '' END || ',"query":' || coalesce(to_json(text)::VARCHAR, 'null') || '},"id":"s' || c.t || '","name":"' || CASE WHEN c.t % 6 = 5 THEN 'lookup' ELSE 'search' END || '"}'
      || CASE WHEN c.i % 3 = 0 THEN ',{"arguments":{"expression":{"$ref":"s' || c.t || '"}},"id":"k' || c.t || '","name":"calculate"}' ELSE '' END AS json,
    list_transform(list_filter([
        CASE WHEN c.t % 6 = 5 THEN 'tool: unknown' END, CASE WHEN c.t % 6 <> 5 AND c.t % 3 = 2 THEN 'limit: not integer' END, CASE WHEN c.t % 6 <> 5 AND text IS NULL THEN 'query: not string' END,
        CASE WHEN c.t % 6 <> 5 AND c.t % 5 = 4 THEN 'page: unknown' END, CASE WHEN b.r IS NULL THEN 'no result' END], lambda x: x IS NOT NULL), lambda x: 's' || c.t || ' ' || x)
      || CASE WHEN c.i % 3 = 0 THEN ['k' || c.t || ' expression: not string', 'k' || c.t || ' no result'] ELSE [] END AS wrong
  FROM calls c JOIN d USING (r) LEFT JOIN first_told b ON b.conv_id = c.conv_id AND b.t = c.t
)
SELECT d.conv_id, d.t AS turn, CASE WHEN tells THEN 'tool' ELSE role END AS role, coalesce(ord_turn, d.t) AS ord_turn, CAST(coalesce(ord_level, 0) AS INTEGER) AS ord_level,
  CASE WHEN n_calls IS NOT NULL THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"assistant","tool_calls":[' || json || ']}'
    WHEN tells THEN '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":"tool","tool_call_id":"s' || (d.t - 1) || '"}'
    ELSE CAST(to_json({'content': text, 'role': role}) AS VARCHAR) END AS message,
  CAST(coalesce(n_calls, 0) AS BIGINT) AS n_calls,
  CASE WHEN n_calls IS NOT NULL THEN array_to_string(wrong, '; ') WHEN tells AND a.r IS NULL THEN 's' || (d.t - 1) || ' no call' ELSE '' END AS problems
FROM d LEFT JOIN place USING (r) LEFT JOIN asked USING (r) LEFT JOIN first_call a ON a.conv_id = d.conv_id AND a.t = d.t - 1"""

#: Links by an inverted index over all shingles, components by repeated minima. Sets of the same text are
#: counted once.
_NEAR = """
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS s FROM words
), reps AS (SELECT min(doc_id) AS id, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS (SELECT id, n, hash(g) AS g FROM (SELECT id, n, unnest(s) AS g FROM reps)),
links AS (
  SELECT a.id AS x, b.id AS y FROM items a JOIN items b ON a.g = b.g AND a.id < b.id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT id, id FROM reps UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x),
label AS (SELECT x AS id, min(y) AS component_id FROM reach GROUP BY x)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, CASE WHEN len(t.s) = 0 THEN t.doc_id ELSE component_id END AS component_id,
  t.doc_id = CASE WHEN len(t.s) = 0 THEN t.doc_id ELSE component_id END AS kept
FROM sets t LEFT JOIN reps USING (s) LEFT JOIN label USING (id)"""

_ASSIGN = """(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?"""
_VALUE = "[A-Za-z0-9+/_.=-]+"


def _spans(kind: str, at: int, pattern: str, keep: str) -> str:
    """Matches of a pattern with their places: what precedes a match is what the split leaves and the
    matches before it."""
    return f"""SELECT r, '{kind}' AS kind, {at} AS k, s, s + length(m) AS e FROM (
    SELECT r, m, sum(length(p) + length(m)) OVER (PARTITION BY r ORDER BY i) - length(m) AS s FROM (
      SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p
      FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS ps FROM d))) WHERE {keep}"""


#: The base spans. No text of the supplied tables holds a structure that confirms, so they are all spans.
_SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  {_spans("assign", 0, _ASSIGN + _VALUE, f"length(regexp_extract(m, '{_ASSIGN}({_VALUE})', 1)) >= 6")}
  UNION ALL {_spans("access", 1, "AKIA[A-Z0-9]+", "length(m) >= 20")}
  UNION ALL {_spans("hex", 2, "[0-9a-f]+", "length(m) >= 24")}
), told AS (
  SELECT r, count(*) FILTER (WHERE k = 0) AS a, count(*) FILTER (WHERE k = 1) AS b, count(*) FILTER (WHERE k = 2) AS c,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM found GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN told USING (r)"""


#: Tokens as a list, cut by counting.
_MIDDLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
u AS (
  SELECT *, regexp_extract_all(t, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') AS w, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
    ('0x' || h[17:24])::BIGINT % 100 AS h3, ('0x' || h[25:32])::BIGINT % 100 AS h4 FROM d
), c AS (
  SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS a, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 50 THEN 'plain' WHEN h4 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u
), s AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS f FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM s"""

_ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN strlen(t) >= 1000 AND page_id < top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(t) >= 1000 AND page_id < top THEN top END AS refers_to
FROM p"""

#: Every order is walked over the counts of documents by what they fail.
_AUDIT = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS low FROM d),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > low THEN 'E' ELSE '' END AS fails,
    count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS bad
  FROM w LEFT JOIN l ON w.doc_id = l.doc_id GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (SELECT a.x || b.x || c.x || d.x || e.x AS o FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT o, s, o[s] AS own, o[:s - 1] AS before FROM orders, unnest([1, 2, 3, 4, 5]) AS u(s)),
r AS (
  SELECT part, o, s, own, coalesce(sum(n) FILTER (translate(fails, before || own, '') = fails), 0) AS kept, coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, own) AND translate(fails, before, '') <> fails), 0) AS redundant, coalesce(sum(n) FILTER (fails = own), 0) AS unique_fails,
    coalesce(sum(good) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS good_lost, coalesce(sum(bad) FILTER (contains(fails, own) AND translate(fails, before, '') = fails), 0) AS toxic_lost
  FROM f, steps GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM r"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": _NEAR,
        "op3_chat_tool_linking": _CHAT,
        "op6_maxscore_top_k": _TOP_K,
        "op8_secret_scan": _SECRETS,
        "op10_benchmark_decontamination": _DECONTAMINATION,
        "op11_fill_in_middle": _MIDDLE,
        "op12_warc_reassembly": _ARCHIVES,
        "op13_filter_audit": _AUDIT,
    }
