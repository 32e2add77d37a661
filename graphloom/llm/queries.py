"""One thin query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import chat, fingerprints, langid, licences, neardup, neighbours, packing, pieces, prefixes, quality, repair, substrings, urlfilter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op2_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(langid.training_part(docs)))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op3_sentence_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("n_sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"), "licence")


def op4_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_tool_call_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = {"reply": {"turn": ("integer", True), "prompt": ("string", True)}}
    found = chat.link_calls(chat.from_turns(_table(spark, sf_dir, "conversations")), schema)
    return found.select("conv_id", "call_id", "name", "call_turn", "result_turn", "level", "status", "error", F.sha2("json", 256).alias("json_sha256"))


def op6_link_graph_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = urlfilter.judge(_table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, urlfilter.QUERY_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(_table(spark, sf_dir, "documents")), "strict-1")
    failed = F.col("failed_bits").bitwiseAND(F.lit(quality.BASE)) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failed_bits")


def op8_chunk_table_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digest_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_gear_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op11_grammar_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair.audits(repair.damaged(conversations), conversations)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens, members = prefixes.rebuilt(prefixes.turn_tokens(_table(spark, sf_dir, "conversations")))
    return prefixes.prefix_trie(tokens, members).drop("key")


def op13_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_block_matrix_neighbours,
        op2_language_spans,
        op3_sentence_licences,
        op4_sum_of_squares_packing,
        op5_tool_call_links,
        op6_link_graph_urls,
        op7_quality_ledger,
        op8_chunk_table_pieces,
        op9_gear_substrings,
        op10_minhash_neardup,
        op11_grammar_repair,
        op12_prefix_trie,
        op13_order_minhash,
        pipeline,
    )
}

_WS = r"[\x20\x09-\x0D]"

_OP7 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
g AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS g FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY g IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY doc_id),
m AS (
  SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '{_WS}+', '', 'g')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…){_WS}*$'))) AS n_ellipsis_lines, length(regexp_replace(t, '\P{{L}}+', '', 'g')) AS n_letters,
         length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, len(list_filter(ws, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, {" + ".join(f"CASE WHEN {condition} THEN {quality.BIT[name]} ELSE 0 END" for name, condition in quality.RULES)} AS failed_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, failed_bits & {quality.BASE} <> 0 AS base_failed, failed_bits & {quality.POLICIES["strict-1"]} = 0 AS kept, CAST(failed_bits AS BIGINT) AS failed_bits
FROM f
"""

_OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WS}+'), lambda x: x <> '') AS ws FROM documents),
u AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM d),
l AS (SELECT doc_id, n, i, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT DISTINCT doc_id, concat_ws(' ', x, y, z) AS g FROM l WHERE z IS NOT NULL OR (n < 3 AND i = 1)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
      GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
c AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.y, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(c.y, d.doc_id)) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id
"""

_OP1 = """
WITH v AS (SELECT vec_id, list_transform(min(embedding), lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda x: x[1] * x[2])) AS score
      FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""



def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _op3() -> str:
    known = "MAP {" + ", ".join(f"{_quote(sentence)}: {_quote(name)}" for name, sentence in licences.SENTENCES.items()) + "}"
    every, several, single = licences.numbered(licences.RULES)
    form = rf"regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), '{licences._OWN}', '{licences._ANY}'), '{licences._BEGIN}', 'under '), '{licences._END}', '\1')"
    names = rf"list_transform(regexp_split_to_array(substr(f, 7), ' or | and '), lambda x: {known}['under ' || regexp_replace(x, '{licences._NAME}', '\1')])"
    own = f"list_transform(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(t, '{licences._MARKS}', '', 'g'), '{licences._INSIDE}', '\\1\\2\\3', 'g'), '@breaks@'), lambda s: {form}), lambda f: CASE WHEN {known}[f] IS NOT NULL OR NOT starts_with(f, 'under ') THEN [{known}[f]] ELSE {names} END)"
    ids = lambda breaks: f"list_filter(flatten({own.replace('@breaks@', breaks)}), lambda x: x IS NOT NULL)"  # noqa: E731

    def hits(c: str) -> str:
        marked = f"',' || array_to_string({c}, ',,') || ','"
        for pattern, n in several:
            marked = f"regexp_replace({marked}, '{pattern}', ',<{n}>,{''.join(f'\\{i + 1}' for i in range(pattern.count('(')))}', 'g')"
        left = f"string_split(regexp_replace(trim({marked}, ','), ',+', ',', 'g'), ',')"
        by_one = "MAP {" + ", ".join(f"{_quote(x)}: {n}" for x, n in single.items()) + "}"
        return f"list_transform({left}, lambda x: CASE WHEN starts_with(x, '<') THEN CAST(trim(x, '<>') AS INTEGER) ELSE {by_one}[x] END)"

    allowed = "[" + ", ".join(_quote(x) for x in licences.SPDX) + "]"
    spdx = rf"list_filter(flatten(list_transform(regexp_extract_all(t, '{licences._SPDX}', 1), lambda x: regexp_extract_all(x, '[A-Za-z0-9.+-]+'))), lambda x: list_contains({allowed}, x))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
i AS (SELECT doc_id, {ids(licences.BY_LINE)} AS a, {ids(licences.BY_TEXT)} AS b, {spdx} AS c FROM d),
h AS (SELECT doc_id, list_concat(CASE WHEN len(b) > len(a) THEN b ELSE a END, list_transform(c, lambda x: 'spdx-' || x)) AS best, list_concat({hits("a")}, {hits("b")}, list_transform(c, lambda x: list_position({allowed}, x) - 1 + {len(licences.RULES)})) AS l FROM i),
o AS (SELECT doc_id, best, list_transform(list_sort(list_distinct(list_filter(l, lambda x: x IS NOT NULL))), lambda n: [{", ".join(_quote(x) for x in every)}][n + 1]) AS m FROM h),
p AS (SELECT doc_id, best, list_filter(m, lambda x, i: list_position(m, x) = i) AS l FROM o)
SELECT doc_id, CAST(len(best) AS BIGINT) AS n_sentences, array_to_string(best, ',') AS sentences, array_to_string(l, ',') AS licences, l[1] AS licence FROM p
"""


def _op6(rounds: int = 12, damping: float = 0.85) -> str:
    rules = ", ".join(f"({_quote(h)}, {_quote(p)}, {_quote(v)}, {_quote(h + p)})" for h, p, v in urlfilter.QUERY_RULES)
    host = lambda u: f"translate(regexp_extract({u}, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"  # noqa: E731
    ranks = ",\n".join(
        f"r{i + 1} AS (SELECT kind, host, sum(rank) AS rank FROM (SELECT kind, host, {1 - damping} * seed AS rank FROM start UNION ALL"
        f" SELECT r.kind, e.dst, r.rank * e.share * {damping} FROM r{i} r JOIN e ON e.kind = r.kind AND e.src = r.host) GROUP BY kind, host)"
        for i in range(rounds)
    )
    return rf"""
WITH p AS (SELECT page_id, html, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, html, {host("rest")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(h, s, verdict, rule) AS (VALUES {rules}),
fit AS (SELECT u.page_id, u.host, u.path, u.html, (SELECT {{'rule': rule, 'verdict': verdict}} FROM rules WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, s) ORDER BY length(rule) DESC, rule LIMIT 1) AS hit FROM u),
c AS (SELECT host, count(*) AS n, count(*) FILTER (hit.verdict = 'allow') AS good, count(*) FILTER (hit.verdict = 'block') AS bad FROM fit WHERE host <> '' GROUP BY host),
seeds AS (SELECT 'trust' AS kind, host FROM c WHERE 2 * good > n UNION ALL SELECT 'distrust', host FROM c WHERE 2 * bad > n),
start AS (SELECT kind, host, 1.0::DOUBLE / count(*) OVER (PARTITION BY kind) AS seed FROM seeds),
l AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''<>]*)', 1)) AS t FROM fit),
g AS (SELECT src, {host("substr(t, instr(t, '//') + 2)")} AS dst, count(*)::DOUBLE AS w FROM l GROUP BY ALL HAVING src <> '' AND dst <> '' AND src <> dst),
k AS (SELECT 'trust' AS kind, src, dst, w FROM g UNION ALL SELECT 'distrust', dst, src, w FROM g),
e AS (SELECT kind, src, dst, w / sum(w) OVER (PARTITION BY kind, src) AS share FROM k),
r0 AS (SELECT kind, host, seed AS rank FROM start),
{ranks},
v AS (SELECT host, sum(rank) FILTER (kind = 'distrust') AS bad, sum(rank) FILTER (kind = 'trust') AS good FROM r{rounds} GROUP BY host)
SELECT page_id, host, path, hit.rule AS rule, coalesce(hit.verdict, CASE WHEN coalesce(bad, 0) > coalesce(good, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM fit LEFT JOIN v USING (host)
"""


#: A call is a user's turn, its result the assistant's next turn; calls after turn 0 need call c0.
_OP5 = """
WITH u AS (SELECT conv_id, turn, min(CASE WHEN text IS NULL THEN {'k': 0, 't': ''} ELSE {'k': 1, 't': text} END) AS p FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
c AS (SELECT conv_id, turn, 'c' || turn AS id, CASE WHEN p.k = 1 THEN p.t END AS prompt FROM u),
r AS (SELECT conv_id, turn AS result_turn, 'c' || (turn - 1) AS id, min(text) AS content FROM conversations WHERE role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.id, r.id) AS call_id, c.turn AS call_turn, result_turn, prompt, content,
             EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.turn = 0) AS has_first
      FROM c FULL JOIN r ON r.conv_id = c.conv_id AND r.id = c.id)
SELECT conv_id, call_id, CASE WHEN call_turn IS NOT NULL THEN 'reply' END AS name, call_turn, result_turn,
       CASE WHEN call_turn IS NULL THEN NULL WHEN call_turn = 0 OR NOT has_first THEN 0 ELSE 1 END::INTEGER AS level,
       CASE WHEN call_turn IS NULL THEN 'no call' WHEN result_turn IS NULL THEN 'no result' ELSE 'linked' END AS status,
       CASE WHEN call_turn IS NULL THEN NULL WHEN prompt IS NULL THEN 'prompt is missing' WHEN call_turn > 0 AND NOT has_first THEN 'needs unknown call c0' END AS error,
       sha256('{"after":' || CASE WHEN call_turn > 0 THEN '["c0"]' ELSE '[]' END || ',"arguments":'
              || CASE WHEN call_turn IS NULL THEN 'null' ELSE '{' || coalesce('"prompt":' || to_json(prompt)::VARCHAR || ',', '') || '"turn":' || call_turn || '}' END
              || ',"id":"' || call_id || '","name":' || CASE WHEN call_turn IS NULL THEN 'null' ELSE '"reply"' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}') AS json_sha256
FROM j
"""


def _crc32(x: str) -> str:
    """CRC-32 of an ASCII string, bit by bit: each byte is followed by eight shifts."""
    steps = f"flatten(list_transform(string_split({x}, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::BIGINT ELSE 0 END) END), 4294967295::BIGINT)"


_AFTER, _SAYS = "CASE WHEN {0} = 2 THEN 3 ELSE 2 END", "CASE WHEN {0} = 2 THEN 'assistant:' ELSE 'user:' END"

#: States 0 to 3: nothing yet, after s, after u, after a. A step puts up to two turns in, then keeps, changes or deletes the next.
_OP11 = rf"""
WITH RECURSIVE n AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role, CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy FROM n WHERE fate <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_replace(text, '[ 	-]+$', '') AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
             left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
ids AS (SELECT DISTINCT conv_id FROM conversations),
r(conv_id, i, s, cost, audit, made) AS (
  SELECT conv_id, 0::BIGINT, 0, 0, '', []::VARCHAR[] FROM ids
  UNION ALL
  SELECT conv_id, i, s, cost, audit, made FROM (
    SELECT conv_id, i, s, cost, audit, made, row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) AS best FROM (
      SELECT conv_id, i, CASE e WHEN 'D' THEN s WHEN 'K' THEN CASE WHEN initial = 's' THEN 1 ELSE {_AFTER.format("s")} END ELSE {_AFTER.format("s")} END AS s,
             cost + CASE e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END + CASE WHEN e <> 'D' AND fault = 'truncated' THEN 5 ELSE 0 END AS cost, audit || e AS audit,
             CASE e WHEN 'D' THEN made WHEN 'K' THEN list_append(made, role || ':' || text) ELSE list_append(made, {_SAYS.format("s")} || text) END AS made
      FROM (SELECT r.conv_id, f.i, f.role, f.text, f.fault, f.initial, r.cost + 5 * k AS cost, r.audit || repeat('I', k) AS audit,
                   CASE k WHEN 0 THEN r.s WHEN 1 THEN {_AFTER.format("r.s")} ELSE {_AFTER.format(f"({_AFTER.format('r.s')})")} END AS s,
                   list_concat(r.made, [{_SAYS.format("r.s")}, {_SAYS.format(f"({_AFTER.format('r.s')})")}][1:k]) AS made
            FROM r JOIN f ON f.conv_id IS NOT DISTINCT FROM r.conv_id AND f.i = r.i + 1, (SELECT unnest([0, 1, 2]) AS k)), (SELECT unnest(['D', 'K', 'R']) AS e)
      WHERE e = 'D' OR fault NOT IN ('blank', 'duplicate') AND (e = 'R' OR initial = 's' AND s = 0 OR initial = 'u' AND s <> 2 OR initial = 'a' AND s = 2)))
  WHERE best = 1),
z AS (SELECT conv_id, max(i) AS i FROM r GROUP BY conv_id),
w AS (SELECT r.conv_id, cost + CASE s WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost, audit || CASE s WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
             list_concat(made, CASE s WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS made FROM r JOIN z ON z.conv_id IS NOT DISTINCT FROM r.conv_id AND z.i = r.i),
b AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (before IS NOT NULL AND before || '-' || initial NOT IN ('s-u', 'u-a', 'a-u')) AS illegal FROM f GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
       cost::BIGINT AS cost, audit, sha256(array_to_string(made, chr(10))) AS repaired_sha256 FROM b LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM b.conv_id
"""

_OP12 = f"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT c, c - c % 5 AS base, {_crc32("c::VARCHAR")} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
s AS (SELECT i.c, 0 AS k, t.p, t.r, t.x FROM i JOIN t ON t.c = i.base AND t.p < i.h UNION ALL SELECT i.c, 1, t.p, t.r, t.x FROM i JOIN t ON t.c = i.c AND t.p >= i.h),
q AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d, md5(length(r) || ':' || r || x) AS v, strlen(x) AS n FROM s),
w AS (SELECT c, d, n, md5(string_agg(v, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM q),
m AS (SELECT c, 0 AS d, 0 AS n, '' AS key, NULL AS parent FROM i UNION ALL SELECT c, d, n, key, coalesce(lag(key) OVER (PARTITION BY c ORDER BY d), '') FROM w),
l AS (SELECT c, max(d) AS len FROM m GROUP BY c),
o AS (SELECT key, d AS depth, min(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, min(n) AS bytes, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends_sha256 FROM m JOIN l USING (c) GROUP BY key, d),
k AS (SELECT parent AS key, count(*) AS n_children FROM o WHERE depth > 0 GROUP BY parent),
u AS (SELECT DISTINCT a.key AS top, b.key AS key FROM m a JOIN m b ON a.c = b.c AND a.d <= b.d),
z AS (SELECT top AS key, sum((n_convs - 1) * bytes) AS saved, count(*) FILTER (n_children IS NULL) AS leaves FROM u JOIN o USING (key) LEFT JOIN k USING (key) GROUP BY top)
SELECT o.conv_id, o.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, o.n_convs::BIGINT AS n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children, z.leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM o JOIN z USING (key) LEFT JOIN k USING (key) LEFT JOIN o p ON p.key = o.parent
"""


ORACLES = {
    "op1_block_matrix_neighbours": _OP1,
    "op3_sentence_licences": _op3(),
    "op5_tool_call_links": _OP5,
    "op6_link_graph_urls": _op6(),
    "op7_quality_ledger": _OP7,
    "op10_minhash_neardup": _OP10,
    "op11_grammar_repair": _OP11,
    "op12_prefix_trie": _OP12,
}
