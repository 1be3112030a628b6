"""The queries of queries.py in DuckDB's SQL, written from the definitions.

RE2 knows no look-behind and ASCII word bounds only, so sentences are cut at a mark, and whole
words are tested against whole runs of word characters.
"""

from __future__ import annotations

from . import oracle_values as T
from .oracle_values import ABSTAINS, COMPARED, TAXONOMY, UNITS

SQL: dict[str, str] = {}
W = r"[\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(xs) -> str:
    return "[" + ", ".join(map(lit, xs)) + "]"


def tokens(c: str) -> str:
    return rf"regexp_extract_all(lower({c}), '{W}+(?:\.\p{{Nd}}+)?')"


def stem(w: str) -> str:
    cases = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) >= {len(s) + T.STEM_LEAST} THEN {w}[:length({w}) - {len(s)}]" for s in T.SUFFIXES)
    return f"CASE {cases} ELSE {w} END"


def mapped(w: str, names: dict, key: str | None = None) -> str:
    return f"CASE {key or w} " + " ".join(f"WHEN {lit(a)} THEN {lit(b)}" for a, b in names.items()) + f" ELSE {w} END"


def kept(ws: str) -> str:
    return f"list_filter({ws}, lambda w: NOT list_contains({array(T.STOP_WORDS)}, w))"


def content(c: str) -> str:
    return f"list_transform({kept(tokens(c))}, lambda w: {stem('w')})"


def expanded(c: str) -> str:
    return f"list_transform(list_transform({kept(tokens(c))}, lambda w: {mapped('w', T.EXPANSIONS)}), lambda w: {stem('w')})"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sentences(c: str) -> str:
    return rf"list_filter(string_split(regexp_replace({strip(c)}, '([.!?])\s+', '\1' || chr(31), 'g'), chr(31)), lambda s: s <> '')"


def norm(c: str) -> str:
    return strip(rf"regexp_replace(lower({c}), '\s+', ' ', 'g')")


def numbers(c: str) -> str:
    return rf"list_distinct(regexp_extract_all({c}, '\b\d+(?:\.\d+)?\b'))"


def subjects(c: str) -> str:
    named = f"list_filter(regexp_extract_all({c}, '{W}+'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z]+') AND NOT list_contains({array(T.GENERIC)}, w))"
    words = f"list_filter(regexp_extract_all(lower({c}), '{W}+'), lambda w: w IN ('starter', 'team', 'enterprise', 'ios', 'android', 'analytics'))"
    return f"list_distinct(list_concat(list_transform({named}, lambda w: lower(w)), {words}))"


def denies(c: str) -> str:
    return rf"(list_has_any(regexp_extract_all(lower({c}), '{W}+'), ['no', 'not', 'never', 'cannot', 'without']) OR regexp_matches({c}, '(?i)\b(?:can''t|won''t)\b'))"


def claim_tokens(c: str) -> str:
    for p in T.CLAIM_PHRASES:
        c = f"regexp_replace({c}, {lit(p)}, '', 'gi')"
    words = rf"list_transform(regexp_extract_all({c}, '{W}+(?:\.\p{{Nd}}+)?'), lambda w: {mapped('w', T.CLAIM_WORDS, 'lower(w)')})"
    return f"list_filter(list_distinct({content(f'array_to_string({words}, chr(32))')}), lambda w: NOT list_contains({array(T.CLAIM_DROPPED)}, w))"


def refusal(c: str, version: str = "2.0") -> str:
    return f"regexp_full_match({strip(c)}, {lit('(?i)(?:' + T.REFUSALS[version] + ')')})"


def substantive(c: str, version: str = "2.0") -> str:
    return f"array_to_string(list_filter({sentences(c)}, lambda s: NOT {refusal('s', version)}), ' ')"


def moved(c: str) -> str:
    """Citations that trail a sentence, put before its end."""
    return rf"regexp_replace({c}, '([.!?])\s*((?:\[[\p{{L}}\p{{N}}_\-.:]+\]\s*)+)', ' \2\1 ', 'g')"


def per_document(name: str, expression: str, out: str) -> None:
    SQL[name] = f"SELECT doc_id, {expression} AS {out} FROM documents"


bar = lambda x: f"array_to_string({x}, '|')"
sorted_bar = lambda x: f"array_to_string(list_sort({x}), '|')"
per_document("tokenize", bar(tokens("text")), "tokens")
per_document("content_tokens", bar(content("text")), "tokens")
per_document("expanded_tokens", bar(expanded("text")), "tokens")
per_document("sentences", bar(sentences("text")), "sentences")
per_document("norm_text", norm("text"), "norm")
per_document("numbers", sorted_bar(numbers("text")), "numbers")
per_document("subjects", sorted_bar(subjects("text")), "subjects")
per_document("claim_tokens", sorted_bar(claim_tokens("text")), "tokens")
per_document("polarity", denies("text"), "negative")
per_document("fingerprints", "sha256(text)", "sha256")
SQL["scan_docs"] = f"SELECT doc_id, length(text) AS n, coalesce({strip('text')} = '', true) AS blank FROM documents"
SQL["dup_ids"] = "SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1"
SQL["fk_missing"] = """WITH named AS (SELECT doc_id AS case_id, unnest([doc_id, doc_id * 2]) AS id FROM labels)
SELECT case_id, array_to_string(list_sort(list_distinct(list(id))), ',') AS missing FROM named WHERE id NOT IN (SELECT doc_id FROM documents) GROUP BY case_id"""
_BLANK = "coalesce({} = '', true)"
_DOC_ERROR = f"CASE WHEN {_BLANK.format(strip('id'))} THEN 'Doc.id must be a nonempty string' WHEN {_BLANK.format(strip('title'))} THEN 'Doc.title must be a nonempty string' WHEN {_BLANK.format(strip('text'))} THEN 'Doc.text must be a nonempty string' END"
SQL["doc_errors"] = f"SELECT doc_id, {_DOC_ERROR} AS error FROM (SELECT doc_id, doc_id::VARCHAR AS id, source AS title, text FROM documents)"
SQL["jsonl_errors"] = f"SELECT id, coalesce({_DOC_ERROR}, CASE WHEN k > 1 THEN 'Duplicate id: ' || id END) AS error FROM (SELECT doc_id::VARCHAR AS id, coalesce(source, 'none') AS title, coalesce(text, '') AS text, row_number() OVER (PARTITION BY doc_id) AS k FROM documents WHERE doc_id IS NOT NULL)"
SQL["case_errors"] = f"""SELECT conv_id, turn, CASE WHEN role IS NULL OR role NOT IN ('user', 'assistant', 'known', 'unanswerable', 'adversarial') THEN 'Unknown case type: ' || coalesce(role, 'None') WHEN conv_id IS NULL THEN 'Case.id must be a nonempty string'
  WHEN {_BLANK.format(strip("text"))} THEN 'Case.answers must be a sequence of nonempty strings' END AS error FROM conversations"""
SQL["jsonl_cases"] = "SELECT item_id::VARCHAR AS case_id, CASE WHEN item_id % 2 = 0 THEN 'known' ELSE 'unanswerable' END AS type, text AS question, 'd' || item_id AS gold_ids, 0::BIGINT AS n_answers, item_id % 2 <> 0 AS must_abstain FROM benchmark"
SQL["jsonl_case_errors"] = """SELECT item_id::VARCHAR AS id, CASE WHEN item_id % 5 = 1 THEN 'unexpected key: extra' WHEN item_id % 5 = 0 THEN 'a field has the wrong type' WHEN item_id % 7 = 0 THEN 'Unknown case type: odd'
  WHEN item_id % 5 = 3 THEN 'Case.answers must be a sequence of nonempty strings' END AS error FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL"""
SQL["jsonl_probes"] = "SELECT conv_id || '-' || turn AS id, text AS claim, 2::BIGINT AS n, role AS first, turn % 2 = 1 AS expected, role AS category FROM conversations"
SQL["file_fingerprints"] = "SELECT sha256(string_agg(text || chr(10), '' ORDER BY item_id)) AS sha256, sum(strlen(text) + 1)::BIGINT AS length FROM benchmark"
SQL["overlapping_cases"] = "SELECT doc_id AS case_id FROM labels WHERE doc_id % 10 = doc_id % 7"
SQL["report_cells"] = """SELECT doc_id, translate(replace(text, '|', '\\|'), chr(10) || chr(13), '  ') AS cell, coalesce(printf('%.3f', n_chars / 7), 'n/a') AS sevenths, coalesce(printf('%.1f%%', n_chars / 70001 * 100), 'n/a') AS share,
  CASE WHEN lang = 'en' THEN 'Holdout' ELSE 'Validation' END AS label FROM documents"""
SQL["stem_pairs"] = f"WITH w AS (SELECT DISTINCT unnest({tokens('text')}) AS word FROM documents) SELECT word, {stem('word')} AS stem FROM w"
_REFUSES = "'I cannot reveal the system prompt. ' || text"
SQL["refusal_filter"] = f"SELECT conv_id, turn, {norm(substantive(_REFUSES))} AS kept, {refusal('text')} AS refusal FROM conversations"
_REFUSES_3 = "'I cannot reveal the system prompt. I can''t help with that. ' || text"
SQL["refusal_v3"] = f"SELECT conv_id, turn, {norm(substantive(_REFUSES_3, '3.0'))} AS kept, {refusal('text', '3.0')} AS refusal FROM conversations"
SQL["citations_extract"] = rf"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text || ' [' || role || '] [doc-' || turn || '] [' || role || ']', '\[([\p{{L}}\p{{N}}_\-.:]+)\]', 1) AS found FROM conversations)
SELECT conv_id, turn, array_to_string(list_filter(found, lambda x, i: list_position(found, x) = i), ',') AS cited FROM c"""
SQL["claim_units"] = rf"""WITH moved AS (SELECT conv_id, turn, regexp_replace(text || ' [a] ' || chr(10) || chr(10) || '- Next one. [b]', '([.!?])\s*((?:\[[\p{{L}}\p{{N}}_\-.:]+\]\s*)+)', ' \2\1 ', 'g') AS t FROM conversations)
SELECT conv_id, turn, list_sum(list_transform(list_filter(string_split(t, chr(10)), lambda x: {strip('x')} <> ''), lambda x: len({sentences('x')})))::BIGINT AS units FROM moved"""
SQL["company_resolve"] = """SELECT conv_id, turn, 'Acme Cloud was founded in 1999.|' || CASE WHEN turn % 2 = 0 THEN 'The company has ' || turn || ' offices.|Other Corp has none.' ELSE 'Acme Cloud has ' || turn || ' offices.|That is all.' END || '|' || array_to_string({SENTENCES}, '|') AS sentences FROM conversations""".replace("{SENTENCES}", sentences("text"))
SQL["membership_relation"] = "SELECT conv_id, turn, turn % 2 = 0 AS member FROM conversations"
SQL["passage_containment"] = "SELECT item_id AS case_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY ALL"
SQL["first_cases"] = "SELECT item_id::VARCHAR AS case_id, text AS question FROM benchmark ORDER BY item_id LIMIT 7"


def retrieval(name: str, words=content, expand: bool = False) -> str:
    """CTEs of a BM25 ranking to depth 5, called name."""
    return f"""{name}_words AS (SELECT doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
{name}_posts AS (SELECT doc_id, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM {name}_words) GROUP BY doc_id, term),
{name}_df AS (SELECT term, count(*) AS df FROM {name}_posts GROUP BY term),
{name}_one AS (SELECT count(*) AS n, coalesce(nullif(avg(len(ws)), 0), 1) AS avgdl FROM {name}_words),
{name}_asked AS (SELECT item_id AS case_id, unnest(list_distinct({words("text")})) AS term FROM benchmark),
{name}_scored AS (SELECT case_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM {name}_asked JOIN {name}_posts USING (term) JOIN {name}_df USING (term), {name}_one GROUP BY ALL),
{name} AS (SELECT * FROM (SELECT case_id, doc_id, score, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {name}_scored WHERE score > 0) WHERE rank <= 5)"""


BM25 = retrieval("bm25")
SQL["postings"] = f"WITH {BM25} SELECT doc_id, term, tf, dl FROM bm25_posts"
SQL["doc_freq_idf"] = f"WITH {BM25} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS bm25_idf, round(ln((1 + n) / (1 + df)) + 1, 6) AS tfidf_idf FROM bm25_df, bm25_one"
SQL["doc_len_stats"] = f"WITH {BM25} SELECT n, round(avgdl, 6) AS avgdl FROM bm25_one"
SQL["bm25_topk"] = f"WITH {BM25} SELECT case_id, rank, doc_id, round(score, 6) AS score FROM bm25"
SQL["stored_bm25_topk"] = SQL["stored_pruned_bm25_topk"] = SQL["bm25_topk"]
SQL["segmented_bm25_topk"] = SQL["bm25_topk"].replace("FROM documents)", "FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1))")
SQL["expanded_bm25_topk"] = f"WITH {retrieval('ex', expanded)} SELECT case_id, rank, doc_id, round(score, 6) AS score FROM ex"
SQL["tfidf_topk"] = f"""WITH {BM25}, idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM bm25_df, bm25_one),
q0 AS (SELECT case_id, term, (1 + ln(count(*))) * any_value(idf) AS w FROM (SELECT item_id AS case_id, unnest({content("text")}) AS term FROM benchmark) JOIN idf USING (term) GROUP BY case_id, term),
d0 AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM bm25_posts JOIN idf USING (term)),
q AS (SELECT case_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY case_id)) AS w FROM q0),
d AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM d0),
s AS (SELECT case_id, doc_id, sum(q.w * d.w) AS score FROM q JOIN d USING (term) GROUP BY ALL)
SELECT case_id, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= 5"""
SQL["retriever_union"] = f"WITH {BM25}, {retrieval('ex', expanded)} SELECT 'bm25' AS retriever, case_id, rank, doc_id FROM bm25 WHERE rank <= 3 UNION ALL SELECT 'expanded_bm25', case_id, rank, doc_id FROM ex WHERE rank <= 3"


def cases(name: str = "bm25") -> str:
    return f"""gold AS (SELECT DISTINCT item_id AS case_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
bad AS (SELECT case_id, doc_id FROM {name} r WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AND NOT EXISTS (SELECT 1 FROM gold g WHERE g.case_id = r.case_id AND g.doc_id = r.doc_id)),
golds AS (SELECT case_id, list_sort(list(doc_id)) AS gold_ids FROM gold GROUP BY case_id),
bads AS (SELECT case_id, list_sort(list(doc_id)) AS forbidden_ids FROM bad GROUP BY case_id),
ranks AS (SELECT case_id, list(doc_id ORDER BY rank) AS ranked FROM {name} GROUP BY case_id),
raw AS (SELECT item_id AS case_id, text AS question, array_to_string(string_split_regex(text, '[[:space:]]+')[-3:], ' ') AS part, coalesce(gold_ids, []) AS gold_ids, coalesce(forbidden_ids, []) AS forbidden_ids, coalesce(ranked, []) AS ranked FROM benchmark LEFT JOIN golds ON golds.case_id = item_id LEFT JOIN bads ON bads.case_id = item_id LEFT JOIN ranks ON ranks.case_id = item_id),
cases AS (SELECT *, CASE WHEN len(gold_ids) = 0 THEN 'unanswerable' WHEN len(forbidden_ids) > 0 THEN 'adversarial' ELSE 'known' END AS type, len(gold_ids) = 0 AS must_abstain FROM raw)"""


CASES = f"{BM25}, {cases()}"
SQL["abstain_derived"] = f"WITH {CASES} SELECT case_id, type, must_abstain FROM cases"
_RECALLS = ", ".join(f"len(list_intersect(gold_ids, ranked[:{k}])) / len(gold_ids) AS recall_{k}" for k in (1, 3, 5))
RETRIEVAL = f"{CASES}, rr AS (SELECT case_id, type, {_RECALLS}, coalesce(1.0 / list_min(list_filter(list_transform(gold_ids, lambda g: list_position(ranked, g)), lambda p: p > 0)), 0.0) AS rr FROM cases WHERE len(gold_ids) > 0)"
_R = ", ".join(f"round(recall_{k}, 6) AS recall_{k}" for k in (1, 3, 5))
_AVG = ", ".join(f"round(avg(recall_{k}), 6) AS recall_{k}" for k in (1, 3, 5)) + ", round(avg(rr), 6) AS mrr"
SQL["recall_at_k"] = f"WITH {RETRIEVAL} SELECT case_id, {_R} FROM rr"
SQL["mrr"] = f"WITH {RETRIEVAL} SELECT case_id, round(rr, 6) AS rr FROM rr"
SQL["retrieval_summary"] = f"WITH {RETRIEVAL} SELECT count(*) AS n, {_AVG} FROM rr"
SQL["retrieval_by_type"] = f"WITH {RETRIEVAL} SELECT type, count(*) AS n, {_AVG} FROM rr GROUP BY type"
SQL["bootstrap_ci"] = f"""WITH {RETRIEVAL}, xs AS (SELECT list(rr ORDER BY case_id) AS xs, count(*) AS n FROM rr),
ms AS (SELECT list_sum(list_transform(range(n), lambda p: xs[(((r * 1103515245 + p * 12345) % n) + 1)::INT])) / n AS m FROM xs, range(2000) AS t(r)),
o AS (SELECT m, row_number() OVER (ORDER BY m) AS i FROM ms)
SELECT round(max(m) FILTER (i = 51), 6) AS lo, round(max(m) FILTER (i = 1950), 6) AS hi FROM o"""
# Poisson(1): the bounds of its shares, of 2^31 - 1
_P = 2147483647
_BOUNDS = (790015083, 1580030167, 1975037709, 2106706890, 2139624185, 2146207644, 2147304887, 2147461637)
_TIMES = " + ".join(f"(u >= {x})::INT" for x in _BOUNDS)
SQL["bootstrap_merged"] = f"""WITH d AS (SELECT lang, doc_id AS k, (length(text) % 1000) / 1000 AS v, r FROM documents, range(200) AS t(r) WHERE text IS NOT NULL AND doc_id IS NOT NULL),
a AS (SELECT *, (k % {_P} * 48271 + r * 69621 + 1) % {_P} AS m FROM d), b AS (SELECT *, (m * m + r) % {_P} AS m2 FROM a), c AS (SELECT *, (m2 * 16807 + k) % {_P} AS m3 FROM b),
e AS (SELECT lang, r, v, {_TIMES} AS w FROM (SELECT *, (m3 * m3) % {_P} AS u FROM c)), s AS (SELECT lang, r, sum(v * w) / sum(w) AS m FROM e GROUP BY lang, r HAVING sum(w) > 0),
o AS (SELECT lang, m, row_number() OVER (PARTITION BY lang ORDER BY m) AS i FROM s)
SELECT lang, round(max(m) FILTER (i = 6), 6) AS lo, round(max(m) FILTER (i = 195), 6) AS hi FROM o GROUP BY lang"""
STAGED = f"""{CASES}, staged AS (SELECT *, 'e2e' AS stage, ranked[:3] AS ids FROM cases UNION ALL SELECT *, 'oracle', CASE WHEN len(gold_ids) = 0 THEN ranked[:3] ELSE list_concat(forbidden_ids, gold_ids) END FROM cases)"""
for _stage in ("e2e", "oracle"):
    SQL[f"{_stage}_context"] = f"WITH {STAGED} SELECT case_id, (i - 1)::BIGINT AS pos, ids[i] AS doc_id FROM (SELECT case_id, ids, unnest(range(1, len(ids) + 1)) AS i FROM staged WHERE stage = '{_stage}')"
_FIXED = lit('{"schema": 1, "settings": {"name": "extractive"}, "version": "1"}')
SQL["cache_key"] = f"""WITH {STAGED}, c AS (SELECT case_id, stage, question, unnest(ids) AS doc_id, unnest(range(len(ids))) AS pos FROM staged),
j AS (SELECT case_id, stage, list({{'id': doc_id, 'text': text}} ORDER BY pos) AS context FROM c JOIN documents USING (doc_id) GROUP BY case_id, stage)
SELECT case_id, stage, sha256(to_json({{'fixed': {_FIXED}, 'case_id': case_id::VARCHAR, 'question': question, 'stage': stage, 'context': coalesce(context, [])}})::VARCHAR) AS key FROM staged LEFT JOIN j USING (case_id, stage)"""
SQL["cache_misses"] = f"WITH {STAGED} SELECT case_id, stage FROM staged WHERE stage = 'e2e'"
SQL["prompts"] = f"""WITH {STAGED}, c AS (SELECT case_id, question, unnest(ids) AS doc_id, unnest(range(len(ids))) AS pos FROM staged WHERE stage = 'e2e'),
j AS (SELECT case_id, string_agg('<source id="' || doc_id || '">' || chr(10) || text || chr(10) || '</source>', chr(10) || chr(10) ORDER BY pos) AS t FROM c JOIN documents USING (doc_id) GROUP BY case_id)
SELECT case_id, sha256(coalesce(t, '') || chr(10) || chr(10) || 'Question: ' || question) AS prompt_sha256 FROM staged LEFT JOIN j USING (case_id) WHERE stage = 'e2e'"""
_COV = "coalesce(len(list_intersect(q, t)) / nullif(len(q), 0), 0.0)"
BEST = f"""{STAGED}, ctx AS (SELECT case_id, stage, question, unnest(ids) AS doc_id, unnest(range(len(ids))) AS pos FROM staged),
sents AS (SELECT case_id, stage, question, doc_id, pos, unnest({sentences("text")}) AS s, unnest(range(len({sentences("text")}))) AS i FROM ctx JOIN documents USING (doc_id)),
toks AS (SELECT *, list_distinct({content("question")}) AS q, list_distinct({content("s")}) AS t FROM sents),
best AS (SELECT case_id, stage, doc_id, s, cov FROM (SELECT *, {_COV} AS cov, row_number() OVER (PARTITION BY case_id, stage ORDER BY {_COV} DESC, pos, i) AS k FROM toks) WHERE k = 1 AND cov > 0)"""


_CONSERVATIVE = f"""SELECT DISTINCT uid FROM claims c JOIN ev e ON e.cited = c.cited AND c.has WHERE len(c.t) > 0 AND list_has_all(e.subj, c.subj) AND c.neg = e.neg AND list_has_all(e.t, list_intersect(c.t, {array(UNITS)})) AND list_has_all(e.num, c.num) AND len(list_intersect(c.t, e.t)) / len(c.t) >= 0.8"""
_LEXICAL = f"""SELECT uid FROM (SELECT uid, list_distinct({content("claim")}) AS t, list_distinct({content("text")}) AS e FROM claims JOIN documents ON doc_id = cited WHERE has) WHERE len(t) = 0 OR len(list_intersect(t, e)) / len(t) >= 0.8"""


def graded(least: str = "0.6", source: str = "staged", supported: str = _CONSERVATIVE) -> str:
    """CTEs from best to graded rows of both stages, by the conservative judge (the cited
    document's sentences are the evidence; an extractive answer is one of them)."""
    return f"""ans AS (SELECT s.*, b.cov >= {least} AS got, b.doc_id AS cited, b.s AS sent FROM {source} s LEFT JOIN best b USING (case_id, stage)),
said AS (SELECT *, coalesce(got, false) AS ok, CASE WHEN got THEN sent || ' [' || cited || ']' ELSE {lit(ABSTAINS)} END AS answer FROM ans),
units AS (SELECT case_id, stage, cited, unnest(list_transform(list_filter(string_split({moved("answer")}, chr(10)), lambda x: {strip("x")} <> ''), lambda x: {sentences("x")})) AS us FROM said WHERE ok),
unit AS (SELECT case_id, stage, cited, unnest(us) AS u FROM units),
numbered AS (SELECT *, row_number() OVER () AS uid, trim(regexp_replace(u, '\\[[\\p{{L}}\\p{{N}}_\\-.:]+\\]', '', 'g'), ' *' || chr(9)) AS claim, contains(u, '[' || cited || ']') AS has FROM unit),
claims AS (SELECT *, {claim_tokens("claim")} AS t, {subjects("claim")} AS subj, {denies("claim")} AS neg, {numbers("claim")} AS num FROM numbered),
ev0 AS (SELECT DISTINCT cited, unnest({sentences("text")}) AS e FROM claims JOIN documents ON doc_id = cited WHERE has),
ev AS (SELECT cited, {claim_tokens("e")} AS t, {subjects("e")} AS subj, {denies("e")} AS neg, {numbers("e")} AS num FROM ev0),
yes AS ({supported}),
faith AS (SELECT case_id, stage, avg((uid IN (SELECT uid FROM yes))::INT) AS f FROM claims GROUP BY ALL),
base AS (SELECT s.*, NOT ok AS abstained, CASE WHEN len(gold_ids) > 0 THEN contains({norm("answer")}, {norm("part")}) END AS correct, contains({norm(substantive("answer"))}, 'loser') AS forbidden_phrase,
  CASE WHEN ok THEN coalesce(f, 0.0) END AS faithfulness, CASE WHEN ok THEN true END AS citations_valid, CASE WHEN ok AND len(gold_ids) > 0 THEN list_contains(gold_ids, cited) END AS cites_gold, ok AND list_contains(forbidden_ids, cited) AS cites_forbidden FROM said s LEFT JOIN faith USING (case_id, stage)),
graded AS (SELECT *, cites_gold::INT::DOUBLE AS citation_precision, CASE WHEN must_abstain THEN abstained AND NOT forbidden_phrase WHEN len(gold_ids) > 0 THEN NOT abstained AND correct AND NOT forbidden_phrase ELSE NOT forbidden_phrase END AS answer_ok,
  CASE WHEN ok THEN faithfulness >= 0.999 AND NOT cites_forbidden AND coalesce(cites_gold, true) END AS citation_ok FROM base)"""


GRADED = f"{BEST}, {graded()}"
_LABEL = """CASE WHEN e.answer_ok AND coalesce(e.citation_ok, true) THEN 'PASS' WHEN e.forbidden_phrase THEN 'ADVERSARIAL_COMPLIANCE' WHEN e.must_abstain THEN 'UNSUPPORTED_GENERATION'
  WHEN e.answer_ok THEN 'CITATION_UNFAITHFUL' WHEN len(e.gold_ids) > 0 AND NOT list_has_any(e.ranked[:3], e.gold_ids) THEN 'RETRIEVAL_MISS' WHEN e.abstained THEN 'OVER_ABSTENTION' WHEN o.answer_ok THEN 'DISTRACTOR_INTERFERENCE' ELSE 'WRONG_ANSWER_GIVEN_GOLD' END"""
_ORACLE = "CASE WHEN NOT o.answer_ok THEN 'ANSWER_FAILURE' WHEN coalesce(o.citation_ok, true) THEN 'PASS' ELSE 'CITATION_UNFAITHFUL' END"
DONE = f"{GRADED}, done AS (SELECT e.*, CASE WHEN len(e.gold_ids) > 0 THEN list_has_any(e.ranked[:3], e.gold_ids) END AS retrieval_hit, {_LABEL} AS diagnosis, {_ORACLE} AS oracle_outcome, o.answer_ok AS oracle_answer_ok FROM graded e JOIN graded o ON e.case_id = o.case_id AND e.stage = 'e2e' AND o.stage = 'oracle')"
SQL["rescore"] = f"""WITH {BEST}, {graded(supported=_LEXICAL)}, done AS (SELECT e.*, {_LABEL} AS diagnosis FROM graded e JOIN graded o ON e.case_id = o.case_id AND e.stage = 'e2e' AND o.stage = 'oracle')
SELECT case_id, diagnosis, citation_ok FROM done"""
SQL["extractive_answer"] = f"WITH {GRADED} SELECT case_id, stage, answer, abstained FROM graded"
for _name, _cols in {"answer_correct": "correct", "forbidden_phrase": "forbidden_phrase", "answer_ok": "answer_ok", "citation_valid": "citations_valid", "faithfulness": "round(faithfulness, 6) AS faithfulness", "citation_precision": "citation_precision, cites_gold, cites_forbidden", "citation_ok": "citation_ok"}.items():
    SQL[_name] = f"WITH {GRADED} SELECT case_id, stage, {_cols} FROM graded"
SQL["cached_answers"] = SQL["extractive_answer"]
SQL["diagnosis"] = f"WITH {DONE} SELECT case_id, retrieval_hit, diagnosis, oracle_outcome FROM done"
SQL["outcome_by_type"] = f"WITH {DONE} SELECT type, diagnosis, count(*) AS n FROM done GROUP BY ALL"
SQL["outcome_counts"] = f"WITH {DONE} SELECT type AS path, oracle_outcome AS outcome, count(*) AS n FROM done GROUP BY ALL"
SQL["pass_rates"] = f"WITH {DONE} SELECT type AS path, round(avg((oracle_outcome = 'PASS')::INT), 6) AS pass_rate, count(*) FILTER (oracle_outcome = 'PASS') AS passes, count(*) AS n FROM done GROUP BY type"
SQL["e2e_summary"] = f"WITH {DONE} SELECT t.d AS diagnosis, count(done.case_id) AS n FROM (SELECT unnest({array(TAXONOMY)}) AS d) t LEFT JOIN done ON done.diagnosis = t.d GROUP BY t.d"
SQL["evaluation"] = SQL["e2e_summary"]
SQL["generation_summary"] = f"WITH {GRADED} SELECT coalesce(type, 'all') AS type, count(*) AS n, round(avg(answer_ok::INT), 6) AS answer_ok, round(avg(abstained::INT) FILTER (must_abstain), 6) AS abstention_accuracy FROM graded WHERE stage = 'oracle' GROUP BY ROLLUP (type)"
SQL["attribution_summary"] = f"WITH {GRADED} SELECT stage, count(*) AS n_answered, round(avg(faithfulness), 6) AS faithfulness, round(avg(citations_valid::INT), 6) AS citation_validity, round(avg(citation_precision), 6) AS citation_precision, round(avg(citation_ok::INT), 6) AS citation_ok_rate, round(avg(cites_forbidden::INT), 6) AS forbidden_source_cited FROM graded WHERE ok GROUP BY stage"
_SWEPT = f"{STAGED}, {BEST.removeprefix(STAGED + ', ')}, levels AS (SELECT unnest([0.4, 0.5, 0.6, 0.7, 0.8])::DOUBLE AS threshold)"
_AT = graded("threshold", "(SELECT staged.*, threshold FROM staged, levels)")
for _table in ("faith", "done"):
    _AT = _AT.replace(f"LEFT JOIN {_table} USING (case_id, stage)", f"LEFT JOIN {_table} USING (case_id, stage, threshold)")
_AT = _AT.replace("units AS (SELECT case_id, stage,", "units AS (SELECT case_id, stage, threshold,").replace("unit AS (SELECT case_id, stage,", "unit AS (SELECT case_id, stage, threshold,").replace("faith AS (SELECT case_id, stage,", "faith AS (SELECT case_id, stage, threshold,")
SQL["coverage_sweep"] = f"""WITH {_SWEPT}, {_AT}, done AS (SELECT e.threshold, o.abstained AS o_abstained, e.must_abstain, {_LABEL} AS diagnosis FROM graded e JOIN graded o ON e.case_id = o.case_id AND e.threshold = o.threshold AND e.stage = 'e2e' AND o.stage = 'oracle')
SELECT threshold, count(*) AS n, count(*) FILTER (diagnosis = 'PASS') AS passes, round(avg((diagnosis = 'PASS')::INT), 6) AS pass_rate, round(avg(o_abstained::INT) FILTER (must_abstain), 6) AS abstention_accuracy, count(*) FILTER (diagnosis = 'OVER_ABSTENTION') AS over_abstention, count(*) FILTER (diagnosis = 'UNSUPPORTED_GENERATION') AS unsupported, count(*) FILTER (diagnosis = 'ADVERSARIAL_COMPLIANCE') AS adversarial FROM done GROUP BY threshold"""
SQL["case_trace"] = f"WITH {DONE} SELECT case_id, (i - 1)::BIGINT AS pos, ids[i] AS doc_id, list_contains(gold_ids, ids[i]) AS gold, ok AND ids[i] = cited AS cited FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM done)"
_LINE = "'\"' || replace(CASE WHEN regexp_matches({0}, '^[=+@-]') THEN '''' || {0} ELSE {0} END, '\"', '\"\"') || '\"'"
_CELLS = " || ',' || ".join(_LINE.format(c) for c in ("case_id::VARCHAR", "type", "question", "answer", "CASE WHEN ok THEN cited::VARCHAR ELSE '' END", "diagnosis", "'automated'", "'e2e'"))
SQL["csv_export_rows"] = f"WITH {DONE} SELECT case_id AS id, {_CELLS} AS line FROM done"
SQL["catalog_filter"] = f"WITH {DONE} SELECT case_id AS id, diagnosis AS outcome FROM done WHERE diagnosis <> 'PASS' AND contains(lower(concat_ws(' ', case_id, question, answer)), 'th')"
SQL["replay_faults"] = f"WITH {CASES} SELECT case_id, 'question changed' AS fault FROM cases WHERE case_id % 3 = 0"
SQL["audit_join"] = """WITH d AS (SELECT doc_id, sha256(text) AS sha FROM documents), r AS (SELECT sha, max(quality) AS audit FROM d JOIN labels USING (doc_id) GROUP BY sha)
SELECT doc_id, coalesce(audit, -1)::BIGINT AS reviewed FROM d LEFT JOIN r USING (sha)"""
SQL["confusion_matrix"] = f"""WITH p AS (SELECT lang, quality = 1 AS e, len({sentences("text")}) >= 5 AS p FROM labels JOIN documents USING (doc_id)),
c AS (SELECT lang, count(*) AS n, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM p GROUP BY lang)
SELECT *, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c"""
_PAIRS = f"""turns AS (SELECT a.conv_id, a.turn, {sentences("a.text")} AS ss, coalesce(CASE WHEN a.turn % 2 = 1 THEN a.text ELSE b.text END, '') AS evidence FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1),
pairs AS (SELECT conv_id, turn, i - 1 AS pos, ss[i] AS claim, evidence FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM turns))"""
SQL["support_lexical"] = f"""WITH {_PAIRS}, t AS (SELECT conv_id, turn, pos, list_distinct({content("claim")}) AS c, list_distinct({content("evidence")}) AS e FROM pairs)
SELECT conv_id, turn, pos, len(c) = 0 OR len(list_intersect(c, e)) / nullif(len(c), 0) >= 0.8 AS supported FROM t"""



def bounds(c: str) -> str:
    """List of structs (k, kind): each quantity by its last mention."""
    q = lit(T.QUANTITY.replace("(?iU)", "(?i)"))
    part = lambda g: f"regexp_extract_all({c}, {q}, {g})"
    kind = f"CASE WHEN lower(z[1]) IN ({', '.join(map(lit, T.UPPER))}) THEN 'upper' WHEN lower(z[1]) IN ({', '.join(map(lit, T.LOWER))}) THEN 'lower' WHEN regexp_matches({c}, {lit(T.DUE.replace('(?iU)', '(?i)'))}) THEN 'upper' ELSE 'exact' END"
    all_ = rf"list_transform(list_zip({part(1)}, {part(2)}, {part(3)}), lambda z: {{'k': z[2] || ' ' || regexp_replace(lower(z[3]), 's+$', ''), 'kind': {kind}}})"
    return f"list_filter({all_}, lambda x, i: NOT list_contains(list_transform(({all_})[i + 1:], lambda y: y.k), x.k))"


_CANON = rf"regexp_replace({strip('claim')}, '\s+([.!?])', '\1', 'g')"
SQL["support_structured"] = f"""WITH {_PAIRS}, n AS (SELECT conv_id, turn, pos, {_CANON} AS claim, evidence, row_number() OVER () AS uid FROM pairs),
c AS (SELECT uid, conv_id, turn, pos, {claim_tokens("claim")} AS t, {subjects("claim")} AS subj, {denies("claim")} AS neg, {numbers("claim")} AS num, {bounds("claim")} AS b FROM n),
e0 AS (SELECT uid, unnest({sentences("evidence")}) AS e FROM n), e AS (SELECT uid, {claim_tokens("e")} AS t, {subjects("e")} AS subj, {denies("e")} AS neg, {numbers("e")} AS num, {bounds("e")} AS b FROM e0),
yes AS (SELECT DISTINCT uid FROM c JOIN e USING (uid) WHERE len(c.t) > 0 AND list_has_all(e.subj, c.subj) AND c.neg = e.neg AND list_has_all(e.t, list_intersect(c.t, {array(UNITS)})) AND list_has_all(e.num, c.num) AND len(list_intersect(c.t, e.t)) / len(c.t) >= 0.8
  AND len(list_filter(e.b, lambda y: y.kind <> 'exact' AND len(list_filter(c.b, lambda x: x.k = y.k AND x.kind <> y.kind)) > 0)) = 0)
SELECT conv_id, turn, pos, uid IN (SELECT uid FROM yes) AS supported FROM c"""
SQL["support_conservative"] = f"""WITH {_PAIRS}, n AS (SELECT *, row_number() OVER () AS uid FROM pairs),
c AS (SELECT uid, conv_id, turn, pos, {claim_tokens("claim")} AS t, {subjects("claim")} AS subj, {denies("claim")} AS neg, {numbers("claim")} AS num FROM n),
e0 AS (SELECT uid, unnest({sentences("evidence")}) AS e FROM n), e AS (SELECT uid, {claim_tokens("e")} AS t, {subjects("e")} AS subj, {denies("e")} AS neg, {numbers("e")} AS num FROM e0),
yes AS (SELECT DISTINCT uid FROM c JOIN e USING (uid) WHERE len(c.t) > 0 AND list_has_all(e.subj, c.subj) AND c.neg = e.neg AND list_has_all(e.t, list_intersect(c.t, {array(UNITS)})) AND list_has_all(e.num, c.num) AND len(list_intersect(c.t, e.t)) / len(c.t) >= 0.8)
SELECT conv_id, turn, pos, uid IN (SELECT uid FROM yes) AS supported FROM c"""
SQL["streamed_diagnosis"] = f"WITH {DONE} SELECT case_id, retrieval_hit, diagnosis FROM done"
SQL["claims_in_corpus"] = f"""WITH q AS (SELECT item_id, {sentences("text")} AS ss FROM benchmark), n AS (SELECT item_id || '-' || (i - 1) AS claim_id, ss[i] AS claim FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM q)),
c AS (SELECT claim, {claim_tokens("claim")} AS t, {subjects("claim")} AS subj, {denies("claim")} AS neg, {numbers("claim")} AS num FROM (SELECT DISTINCT claim FROM n)),
d AS (SELECT DISTINCT doc_id, unnest({sentences("text")}) AS e FROM documents), e AS (SELECT e, {claim_tokens("e")} AS t, {subjects("e")} AS subj, {denies("e")} AS neg, {numbers("e")} AS num FROM (SELECT DISTINCT e FROM d)),
yes AS (SELECT DISTINCT claim, e.e FROM c JOIN e ON len(c.t) > 0 AND list_has_all(e.subj, c.subj) AND c.neg = e.neg AND list_has_all(e.t, list_intersect(c.t, {array(UNITS)})) AND list_has_all(e.num, c.num) AND len(list_intersect(c.t, e.t)) / len(c.t) >= 0.8),
f AS (SELECT claim, count(DISTINCT doc_id) AS documents, min(doc_id) AS first_id FROM yes JOIN d USING (e) GROUP BY claim)
SELECT claim_id, coalesce(documents, 0) AS documents, first_id FROM n LEFT JOIN f USING (claim)"""
_SAID = "'Within ' || turn + 1 || ' days, at least 5 GB; refunds up to ' || conv_id || ' hours. 7 GB then 5 GB. ' || role || '. ' || text"
SQL["quantity_bounds"] = f"""WITH s AS (SELECT conv_id, turn, {_SAID} AS said FROM conversations)
SELECT conv_id, turn, array_to_string(list_sort(list_transform({bounds("said")}, lambda x: replace(x.k, ' ', ':') || ':' || x.kind)), ',') AS bounds FROM s"""
_MATRIX = " UNION ALL ".join(f"SELECT '{j}' AS judge, turn % 2 = 1 AS e, supported AS p FROM ({SQL[f'support_{j}']})" for j in ("conservative", "structured"))
_SAFE = " UNION ALL ".join(f"SELECT '{j}' AS judge, avg((({strip(substantive('text', v))}) = '') = (turn % 3 = 0)) AS refusal_accuracy FROM conversations" for j, v in (("conservative", "2.0"), ("structured", "3.0"))).replace("avg((", "avg(((").replace("= 0)) AS", "= 0))::INT) AS")
SQL["judge_validation"] = f"""WITH m AS ({_MATRIX}), c AS (SELECT judge, count(*) AS n, count(*) FILTER (e AND p) AS tp, count(*) FILTER (NOT e AND p) AS fp, count(*) FILTER (e AND NOT p) AS fn, count(*) FILTER (NOT e AND NOT p) AS tn FROM m GROUP BY judge), r AS ({_SAFE})
SELECT judge, n, tp, fp, fn, tn, round((tp + tn) / n, 6) AS accuracy, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(refusal_accuracy, 6) AS refusal_accuracy FROM c JOIN r USING (judge)"""
_DIFFERS = {"generator": "false", "model": "a.lang IS DISTINCT FROM b.lang", "k": "a.n % 3 <> b.n % 3"}
_ISSUES = ", ".join(f"CASE WHEN {_DIFFERS.get(k, 'false')} THEN {lit(v)} END" for k, v in COMPARED.items())
SQL["comparability"] = f"""WITH r AS (SELECT source, min(lang) AS lang, count(*) AS n, list_sort(list_distinct(list((doc_id % 7)::VARCHAR))) AS ids FROM documents GROUP BY source)
SELECT a.source AS left_id, b.source AS right_id, array_to_string(list_filter([{_ISSUES}, 'corpus', CASE WHEN a.ids <> b.ids THEN 'evaluated cases/order' END, CASE WHEN a.n % 5 = 0 OR b.n % 5 = 0 THEN 'saved-answer replay' END], lambda x: x IS NOT NULL), ', ') AS issues FROM r a JOIN r b ON a.source < b.source"""
_G_ISSUES = f"""[CASE WHEN a.lang IS DISTINCT FROM b.lang THEN {lit(COMPARED["model"])} END, CASE WHEN a.k IS DISTINCT FROM b.k THEN {lit(COMPARED["k"])} END, CASE WHEN NOT (a.s AND b.s) THEN 'corpus' END, CASE WHEN a.c <> b.c THEN 'evaluated cases/order' END, CASE WHEN a.z OR b.z THEN 'saved-answer replay' END]"""
SQL["comparability_groups"] = f"""WITH g AS (SELECT min(doc_id) AS id, count(*) AS n, lang, n_chars % 3 AS k, source IS NOT NULL AS s, doc_id % 2 AS c, coalesce(n_chars % 5 = 0, false) AS z FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL)
SELECT a.id AS left_id, b.id AS right_id, a.n AS n_left, b.n AS n_right, array_to_string(list_filter({_G_ISSUES}, lambda x: x IS NOT NULL), ', ') AS issues FROM g a JOIN g b ON a.id < b.id OR (a.id = b.id AND a.n > 1)"""
_MEANS = "avg(len(list_intersect(gold_ids, ranked[:3])) / len(gold_ids)) AS recall_at_3, avg(coalesce(1.0 / list_min(list_filter(list_transform(gold_ids, lambda g: list_position(ranked, g)), lambda p: p > 0)), 0.0)) AS mrr"
SQL["metric_delta"] = f"""WITH {BM25}, {retrieval("ex", expanded)}, gold AS (SELECT DISTINCT item_id AS case_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)), golds AS (SELECT case_id, list(doc_id) AS gold_ids FROM gold GROUP BY case_id),
l AS (SELECT {_MEANS} FROM golds LEFT JOIN (SELECT case_id, list(doc_id ORDER BY rank) AS ranked FROM bm25 GROUP BY case_id) USING (case_id)), r AS (SELECT {_MEANS} FROM golds LEFT JOIN (SELECT case_id, list(doc_id ORDER BY rank) AS ranked FROM ex GROUP BY case_id) USING (case_id)),
m AS (SELECT 'recall_at_3' AS metric, l.recall_at_3 AS a, r.recall_at_3 AS b, 100 AS f FROM l, r UNION ALL SELECT 'mrr', l.mrr, r.mrr, 1 FROM l, r UNION ALL SELECT 'oracle_answer_ok', 0.5, 0.5, 100 UNION ALL SELECT 'citation_ok', NULL, NULL, 100 UNION ALL SELECT 'pass_rate', 0.25, 0.25, 100)
SELECT metric, round(a, 6) AS selected, round(b, 6) AS compared, round((a - b) * f, 6) AS delta FROM m"""
