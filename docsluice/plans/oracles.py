"""DuckDB SQL for the registered queries, written apart from the Spark plans."""

from __future__ import annotations

from ..functions.text import CITATION, QUOTE, STOPWORDS, TERM, WORD, WS
from ..operators import merkle
from ..operators.rules import RULES
from ..operators.retrieve import LEAD, NO_FACTS, NOTE
from ..operators.telemetry import MODELS, QUANTS


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


STOP = "[" + ", ".join(q(w) for w in STOPWORDS) + "]"
SEP = "chr(1)"


def tokens(x: str) -> str:
    comma = q(r"(\p{Nd}),(\p{Nd})")
    plain = f"regexp_replace(regexp_replace(lower(coalesce({x}, '')), {comma}, '\\1\\2', 'g'), {comma}, '\\1\\2', 'g')"
    return f"list_filter(regexp_extract_all({plain}, {q(TERM)}), lambda t: length(t) >= 2 AND NOT list_contains({STOP}, t))"


def words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), {q(WORD)})"


def content(x: str) -> str:
    kept = f"list_filter({words(x)}, lambda w: NOT list_contains({STOP}, w))"
    return f"CASE WHEN len({kept}) > 0 THEN {kept} ELSE {words(x)} END"


def sentences(x: str, after: str = ".!?") -> str:
    return f"string_split(regexp_replace({x}, {q(f'([{after}]){WS}+')}, '\\1' || {SEP}, 'g'), {SEP})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^{WS}+|{WS}+$')}, '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(f'{WS}+')}, ' ', 'g')"


def normal(x: str) -> str:
    return f"replace(replace(replace(coalesce({x}, ''), chr(0), ' '), chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def word_count(x: str) -> str:
    return f"len(list_filter(regexp_split_to_array({x}, {q(f'{WS}+')}), lambda w: w <> ''))"


def nl(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')))"


def slot(h: str, digits: int, dim: int) -> str:
    step, out = (1 << 32) % dim, "0"
    for at in range(1, digits, 8):
        out = f"(({out}) * {step} + CAST('0x' || substr({h}, {at}, 8) AS BIGINT)) % {dim}"
    return f"CAST({out} AS INTEGER)"


def sign(h: str, digits: int) -> str:
    return f"CASE WHEN CAST('0x' || substr({h}, {digits - 2}, 1) AS INTEGER) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END"


RAW = "raw AS (SELECT doc_id AS row_id, source || '_' || doc_id AS title, text AS raw, list_element(['CLINICAL', 'FINANCIAL', 'LEGAL', 'DEFENSE', 'GENERAL'], doc_id % 5 + 1) AS category FROM documents)"
VALID = f"""{RAW}, valid AS (SELECT row_id, title, category, sha256(coalesce(raw, '')) AS sha256, text, CASE WHEN length(coalesce(raw, '')) = 0 THEN 'EMPTY' WHEN {strip('text')} = '' THEN 'WHITESPACE' WHEN length(text) > 5000000 THEN 'TOO_LARGE' END AS load_error
  FROM (SELECT *, {normal('raw')} AS text FROM raw))"""
CORPUS = f"""{VALID}, corpus AS (SELECT 'doc_' || substr(md5(sha256), 1, 10) AS doc_key, row_id, title, category, sha256, text FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY row_id) AS rn FROM valid WHERE load_error IS NULL) WHERE rn = 1)"""
CHUNKS = f"""{CORPUS}, cuts AS (SELECT doc_key, title, category, text, unnest(range(0, CAST(greatest(1, ceil((length(text) - 60) / 390.0)) AS BIGINT))) AS i FROM corpus),
  parts AS (SELECT doc_key, title, category, i AS chunk_index, substr(text, i * 390 + 1, 450) AS content, {nl('substr(text, 1, i * 390)')} + 1 AS start_line FROM cuts),
  chunks AS (SELECT doc_key || '_chunk_' || chunk_index AS chunk_id, doc_key, title, category, CAST(chunk_index AS INTEGER) AS chunk_index, content, CAST({word_count('content')} AS INTEGER) AS word_count,
    CAST((start_line - 1) // 50 + 1 AS INTEGER) AS page_number, CAST(start_line AS INTEGER) AS start_line, CAST(start_line + {nl('content')} AS INTEGER) AS end_line, sha256(content) AS sha256 FROM parts)"""
TF = f"""{CHUNKS}, toks AS (SELECT chunk_id, {tokens('content')} AS t FROM chunks), tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM toks) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), stats AS (SELECT count(*) AS n, coalesce(avg(len(t)), 0) AS avgdl FROM toks)"""
BM25 = f"""{TF}, questions AS (SELECT item_id AS query_id, text AS query FROM benchmark), qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens('query')}) AS term FROM questions) GROUP BY ALL),
  bm AS (SELECT query_id, chunk_id, sum(qtf * (ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS bm25 FROM tf JOIN df USING (term) JOIN qt USING (term), stats GROUP BY ALL),
  bm_top AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, round(bm25, 6) AS score FROM bm) WHERE score > 0) WHERE rank <= 20)"""


def embedded(name: str, source: str, key: str, text: str, dim: int) -> str:
    return f"""{name}_w AS (SELECT {key}, {content(text)} AS w FROM {source}), {name}_p AS (SELECT {key}, w, unnest(range(len(w))) AS pos FROM {name}_w),
  {name}_h AS (SELECT {key}, pos, md5(w[pos + 1]) AS m, CASE WHEN pos > 0 THEN sha1(w[pos] || '_' || w[pos + 1]) END AS s FROM {name}_p),
  {name}_s AS (SELECT {key}, {slot('m', 32, dim)} AS slot, {sign('m', 32)} * (1 + 1.0::DOUBLE / (pos + 1)) AS x FROM {name}_h UNION ALL SELECT {key}, {slot('s', 40, dim)}, {sign('s', 40)} * 1.5::DOUBLE FROM {name}_h WHERE s IS NOT NULL),
  {name}_v AS (SELECT {key}, slot, sum(x) AS x FROM {name}_s GROUP BY ALL), {name} AS (SELECT {key}, slot, CASE WHEN n = 0 THEN x ELSE x / n END AS weight FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {key})) AS n FROM {name}_v))"""


DENSE = f"""{BM25}, {embedded('ce', 'chunks', 'chunk_id', 'content', 384)}, {embedded('qe', 'questions', 'query_id', 'query', 384)},
  chunk_ids AS (SELECT DISTINCT chunk_id FROM ce), query_ids AS (SELECT DISTINCT query_id FROM qe), pairs AS (SELECT query_id, chunk_id, sum(ce.weight * qe.weight) AS s FROM ce JOIN qe USING (slot) GROUP BY ALL),
  dn AS (SELECT query_id, chunk_id, round(coalesce(s, 0), 6) AS score FROM query_ids CROSS JOIN chunk_ids LEFT JOIN pairs USING (query_id, chunk_id)),
  dn_top AS (SELECT * FROM (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM dn) WHERE rank <= 20)"""
CLOUD = DENSE.replace(embedded("ce", "chunks", "chunk_id", "content", 384), embedded("ce", "chunks", "chunk_id", "content", 768)).replace(embedded("qe", "questions", "query_id", "query", 384), embedded("qe", "questions", "query_id", "query", 768))
JSON_TEXT = r"""WITH c AS (SELECT doc_id, regexp_extract_all(text, '(?s).') AS c FROM documents),
  e AS (SELECT doc_id, list_transform(c, lambda x: CASE x WHEN '"' THEN '\"' WHEN '\' THEN '\\' WHEN chr(10) THEN '\n' WHEN chr(13) THEN '\r' WHEN chr(9) THEN '\t' WHEN chr(8) THEN '\b' WHEN chr(12) THEN '\f'
    ELSE CASE WHEN unicode(x) BETWEEN 32 AND 126 THEN x WHEN unicode(x) < 65536 THEN '\u' || lpad(lower(to_hex(unicode(x))), 4, '0')
      ELSE '\u' || lower(to_hex(55296 + (unicode(x) - 65536) // 1024)) || '\u' || lower(to_hex(56320 + (unicode(x) - 65536) % 1024)) END END) AS e FROM c)
  SELECT doc_id, sha256('"' || coalesce(array_to_string(e, ''), '') || '"') AS sha256 FROM e"""
FUSED = f"""{DENSE}, seen AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS s, rank AS o FROM dn_top UNION ALL SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank), 1000 + rank FROM bm_top),
  fused AS (SELECT query_id, chunk_id, rrf, CAST(row_number() OVER (PARTITION BY query_id ORDER BY whole DESC, o, chunk_id) AS INTEGER) AS rank FROM (SELECT query_id, chunk_id, sum(s) AS whole, round(sum(s), 6) AS rrf, min(o) AS o FROM seen GROUP BY ALL))"""
HYBRID = f"""{FUSED}, got AS (SELECT f.query_id, f.rank, f.chunk_id, c.title, c.category, c.content, c.page_number, c.start_line, c.end_line, round(coalesce(d.score, 0), 4) AS similarity_score, round(coalesce(b.score, 0), 4) AS bm25_score, round(f.rrf, 4) AS rrf_score,
    'Doc: ' || c.title || ', Page ' || c.page_number || ', Line ' || c.start_line || '-' || c.end_line AS citation_label
  FROM fused f JOIN chunks c USING (chunk_id) LEFT JOIN dn_top d USING (query_id, chunk_id) LEFT JOIN bm_top b USING (query_id, chunk_id) WHERE f.rank <= 4)"""
ANSWERS = f"""{HYBRID}, ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, rank) AS r FROM got),
  split AS (SELECT query_id, r, citation_label, query, list_filter(list_transform({sentences('content', '.!?' + chr(10))}, lambda s: {strip('s')}), lambda s: s <> '') AS parts FROM ranked JOIN questions USING (query_id) WHERE r <= 3),
  each AS (SELECT query_id, r, citation_label, query, unnest(parts) AS s, unnest(range(len(parts))) AS i FROM split),
  rated AS (SELECT *, row_number() OVER (PARTITION BY query_id, r ORDER BY len(list_intersect(list_distinct({words('s')}), list_distinct({words('query')}))) DESC, i) AS k FROM each),
  best AS (SELECT query_id, r, citation_label, string_agg('"' || s || '"', ' ' ORDER BY k) AS quoted FROM rated WHERE k <= 2 GROUP BY ALL),
  bodies AS (SELECT query_id, string_agg({q(LEAD)} || citation_label || ']:' || chr(10) || quoted || ' [' || citation_label || ']', chr(10) || chr(10) ORDER BY r) AS body FROM best GROUP BY 1),
  answers AS (SELECT query_id, coalesce(body || {q(NOTE)}, {q(NO_FACTS)}) AS answer FROM questions LEFT JOIN bodies USING (query_id))"""


def claims(x: str) -> str:
    lines = f"list_filter(list_transform(string_split({x}, chr(10)), lambda l: {strip('l')}), lambda l: l <> '' AND NOT starts_with(l, 'Note:') AND NOT starts_with(l, 'Based on'))"
    said = f"flatten(list_transform({lines}, lambda l: {sentences('l')}))"
    bare = "list_transform(" + said + ", lambda s: " + strip(f"replace(regexp_replace(s, {q(CITATION)}, '', 'g'), chr(34), '')") + ")"
    return f"list_filter({bare}, lambda s: length(s) >= 15)"


VERIFIED = f"""{ANSWERS}, said AS (SELECT query_id, unnest(c) AS claim_text, unnest(range(len(c))) AS claim_index FROM (SELECT query_id, {claims('answer')} AS c FROM answers WHERE NOT contains(lower(answer), 'do not contain information') AND query_id IN (SELECT query_id FROM got))),
  worded AS (SELECT *, list_distinct({words('claim_text')}) AS w FROM said), shared AS (SELECT query_id, claim_index, claim_text, title, content, start_line, end_line, rank, len(list_intersect(w, list_distinct({words('content')}))) AS k, len(w) AS n FROM worded JOIN got USING (query_id) WHERE len(w) > 0),
  claims AS (SELECT query_id, CAST(claim_index AS INTEGER) AS claim_index, CASE WHEN k / n >= 0.5 THEN 'VERIFIED' WHEN k / n >= 0.25 THEN 'INFERRED' ELSE 'UNSUPPORTED' END AS status, CASE WHEN k > 0 THEN title END AS verifying_doc, CASE WHEN k > 0 THEN start_line || '-' || end_line END AS verifying_lines, round(k / n, 3) AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id, claim_index ORDER BY k DESC, rank) AS r FROM shared) WHERE r = 1)"""
EVIDENCE = f"""{VERIFIED}, held AS (SELECT query_id, {squeeze("string_agg(content, ' ' ORDER BY rank)")} AS held, list(lower(title)) AS names FROM got GROUP BY 1),
  counted AS (SELECT query_id, answer, held, regexp_extract_all(answer, {q(QUOTE)}, 1) AS quotes, regexp_extract_all(answer, {q(CITATION)}, 1) AS cited, names FROM answers LEFT JOIN held USING (query_id)),
  counts AS (SELECT query_id, answer, held IS NULL AS bare, len(quotes) AS q, coalesce(len(list_filter(quotes, lambda x: contains(held, {squeeze(strip('x'))}))), 0) AS qm, len(cited) AS x,
    coalesce(len(list_filter(cited, lambda c: len(list_filter(names, lambda n: contains(n, lower({strip('c')})) OR contains(lower({strip('c')}), n))) > 0)), 0) AS xm FROM counted)"""
VECTORS = "vecs AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), probes AS (SELECT CAST(label AS BIGINT) AS query_id, v AS b FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM vecs) WHERE r = 1), both_ AS (SELECT vec_id, v AS a, b FROM vecs JOIN probes ON label = query_id)"
DOT, NORMS = "list_dot_product(a, b)", "(sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b)))"
COSINE = f"CASE WHEN {NORMS} = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, {DOT} / {NORMS})) END"
UNIT = "CASE WHEN list_dot_product(v, v) = 0 THEN v ELSE list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END"
EVENTS = """ev AS (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts,
    'Query executed via ' || event_type || ' (retrieved ' || event_id || ' chunks, grounded: ' || CASE WHEN event_id % 2 = 0 THEN 'True' ELSE 'False' END || ')' AS payload_summary,
    '{"chunks_retrieved": ' || event_id || ', "grounded": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || ', "model": "' || event_type || '"}' AS data FROM events),
  hashed AS (SELECT ledger, idx, ts, payload_summary, sha256(payload_summary || data) AS data_hash FROM ev)"""
CHAIN = f"""{EVENTS}, chain AS (
    SELECT ledger, idx, ts, data_hash, repeat('0', 64) AS previous_hash, sha256(idx || ':' || ts || ':LOCAL_QUERY:' || data_hash || ':' || repeat('0', 64)) AS current_hash FROM hashed WHERE idx = 0
    UNION ALL SELECT h.ledger, h.idx, h.ts, h.data_hash, c.current_hash, sha256(h.idx || ':' || h.ts || ':LOCAL_QUERY:' || h.data_hash || ':' || c.current_hash) FROM chain c JOIN hashed h ON h.ledger = c.ledger AND h.idx = c.idx + 1)"""


def checked(data_hash: str) -> str:
    return f"""WITH RECURSIVE {CHAIN}, given AS (SELECT ledger, idx, ts, {data_hash} AS data_hash, previous_hash, current_hash FROM chain),
      tested AS (SELECT ledger, idx, previous_hash = CASE WHEN idx = 0 THEN repeat('0', 64) ELSE lag(current_hash) OVER (PARTITION BY ledger ORDER BY idx) END AND current_hash = sha256(idx || ':' || ts || ':LOCAL_QUERY:' || data_hash || ':' || previous_hash) AS good FROM given)
      SELECT ledger, bool_and(good) AS valid, coalesce(min(CASE WHEN NOT good THEN idx END), -1) AS first_bad, count(*) AS n FROM tested GROUP BY 1"""


def _entries() -> str:
    """Each kind of ledger entry: summary and data by event."""
    true = lambda c, yes, no: f"CASE WHEN {c} THEN '{yes}' ELSE '{no}' END"
    each = (
        ("DOCUMENT_INGEST", "'Document Ingested: ' || event_type || ' (' || event_id || ' chunks)'", """'{"category": "GENERAL", "chunks": ' || event_id || ', "doc_id": "doc_' || event_id || '", "sha256": "' || sha256(CAST(event_id AS VARCHAR)) || '"}'"""),
        ("PII_REDACT", "'PII Redaction: ' || event_id % 9 || ' entities sanitized (risk score: ' || least(100, event_id % 9 * 12) || ')'", """'{"entities_redacted": ' || event_id % 9 || ', "risk_score_heuristic": ' || least(100, event_id % 9 * 12) || '}'"""),
        ("LOCAL_QUERY", f"'Query executed via ' || event_type || ' (retrieved ' || event_id || ' chunks, grounded: ' || {true('event_id % 2 = 0', 'True', 'False')} || ')'", f"""'{{"chunks_retrieved": ' || event_id || ', "grounded": ' || {true('event_id % 2 = 0', 'true', 'false')} || ', "model": "' || event_type || '"}}'"""),
        ("AIR_GAP_VERIFY", f"'Air Gap Verification: loopback=' || {true('event_id % 3 = 0', 'True', 'False')} || ', observed non-loopback egress bytes=' || event_id", f"""'{{"egress_bytes": ' || event_id || ', "loopback_verified": ' || {true('event_id % 3 = 0', 'true', 'false')} || '}}'"""),
        ("QUANT_TELEMETRY", "'Quantization Telemetry: ' || event_type || ' (Q4) memory estimate ' || event_id || ' GiB'", """'{"model": "' || event_type || '", "quant": "Q4", "vram_estimate_gib": ' || event_id || '}'"""),
        ("ERROR", "'Error: [' || event_type || '] ' || substr(repeat(event_type, 40), 1, 120)", """'{"error_class": "' || event_type || '", "message": "' || repeat(event_type, 40) || '"}'"""),
        ("MODE_SWITCH", "'Mode switched to ' || event_type", """'{"mode": "' || event_type || '"}'"""),
        ("SYSTEM_SHUTDOWN", "event_type", "'{}'"),
    )
    return " UNION ALL ".join(f"SELECT event_id, '{name}' AS entry, {summary} AS payload_summary, sha256({summary} || {data}) AS data_hash FROM events WHERE event_id % 8 = {i}" for i, (name, summary, data) in enumerate(each))


def tampered() -> str:
    """Records by place, each against the one before it, after the third record was changed, repeated, removed or swapped."""
    return f"""WITH RECURSIVE {CHAIN}, moved AS (SELECT ledger, idx, ts, CASE WHEN ledger % 5 = 0 AND idx = 2 THEN repeat('0', 64) ELSE data_hash END AS data_hash, previous_hash, current_hash,
        CASE WHEN ledger % 5 = 3 AND idx IN (2, 3) THEN 5 - idx ELSE idx END AS place FROM chain WHERE NOT (ledger % 5 = 2 AND idx = 2)),
      given AS (SELECT * FROM moved UNION ALL SELECT * FROM moved WHERE ledger % 5 = 1 AND idx = 2),
      tested AS (SELECT ledger, row_number() OVER w - 1 AS position, previous_hash = coalesce(lag(current_hash) OVER w, repeat('0', 64)) AND current_hash = sha256(idx || ':' || ts || ':LOCAL_QUERY:' || data_hash || ':' || previous_hash) AS good
        FROM given WINDOW w AS (PARTITION BY ledger ORDER BY place, idx))
      SELECT ledger, bool_and(good) AS valid, coalesce(min(CASE WHEN NOT good THEN position END), -1) AS first_bad, count(*) AS n FROM tested GROUP BY 1"""


def ascii_pattern(p: str) -> str:
    """The rule with its classes spelt out and without lookaround, for counting: a match may take in what it looks ahead at, and a name's further words are those that are not excluded."""
    other = "(?!at\\b|in\\b|on\\b|to\\b|from\\b|by\\b|with\\b|and\\b|or\\b)[A-Za-z]{2,}"
    return p.replace(other, _but("at in on to by or and from with".split())).replace("(?=", "(?:").replace(r"[^\s", r"[^ \t\n\r\f\x0B").replace(r"\d", "[0-9]")


def _but(words: list[str]) -> str:
    """A pattern for words of two letters or more other than ``words``, longer ones first."""

    def rest(left: list[str], n: int) -> list[str]:
        if not left:
            return [f"[a-z]{{{n}}}"] if n else [""]
        if not n:
            return []
        firsts = sorted({w[0] for w in left})
        out = [f"[^{''.join(firsts)}\\W0-9_]" + tail for tail in rest([], n - 1)]
        return out + [c + tail for c in firsts for tail in rest([w[1:] for w in left if w[0] == c], n - 1)]

    longest = max(map(len, words))
    parts = [f"[a-z]{{{longest + 1},}}"] + [x for n in range(longest, 1, -1) for x in rest([w for w in words if len(w) == n], n)]
    return "(?:" + "|".join(parts) + ")"


def _pii() -> str:
    kinds: dict[str, list[str]] = {}
    for kind, p, group, *_ in RULES:
        kinds.setdefault(kind, []).append(f"len(list_filter(regexp_extract_all(text, {q(ascii_pattern(p))}, {group}), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\x0B]')))")
    rows = " UNION ALL ".join(f"SELECT doc_id, {q(k)} AS type, CAST({' + '.join(v)} AS BIGINT) AS n FROM documents" for k, v in kinds.items())
    return f"SELECT * FROM ({rows}) WHERE n > 0"


def _spans() -> str:
    """The overlap sweep by recursion over each order's spans."""
    return """WITH RECURSIVE spans AS (SELECT l_orderkey, s, z, row_number() OVER (PARTITION BY l_orderkey ORDER BY s, s - z, -d, f) AS k FROM (SELECT l_orderkey, CAST(dayofyear(l_shipdate) AS INTEGER) AS s, CAST(dayofyear(l_shipdate) + l_linenumber * 5 AS INTEGER) AS z, l_returnflag AS f, l_discount AS d FROM lineitem)),
      sweep AS (SELECT l_orderkey, k, [{'s': s, 'z': z}] AS kept FROM spans WHERE k = 1
        UNION ALL SELECT a.l_orderkey, b.k, CASE WHEN b.s >= a.kept[-1].z THEN list_append(a.kept, {'s': b.s, 'z': b.z}) WHEN b.z - b.s > a.kept[-1].z - a.kept[-1].s THEN list_append(a.kept[:-2], {'s': b.s, 'z': b.z}) ELSE a.kept END FROM sweep a JOIN spans b ON b.l_orderkey = a.l_orderkey AND b.k = a.k + 1),
      done AS (SELECT l_orderkey, kept FROM (SELECT *, max(k) OVER (PARTITION BY l_orderkey) AS m FROM sweep) WHERE k = m)
      SELECT l_orderkey, CAST(i AS INTEGER) AS i, x.s AS start, x.z AS "end" FROM (SELECT l_orderkey, unnest(kept) AS x, unnest(range(len(kept))) AS i FROM done)"""


def _memory() -> str:
    rows = lambda t: ", ".join("(" + ", ".join(q(x) if isinstance(x, str) else f"CAST({x} AS DOUBLE)" for x in r) + ")" for r in t)
    return f"""mem AS (SELECT m.n AS model_id, u.n AS quant_type, context_length, batch_size, params * 1e9 * bytes / 1073741824.0 AS w, 4 * layers * kv * (hidden // heads) * context_length * batch_size / 1073741824.0 AS c
        FROM (VALUES {rows(MODELS)}) m(n, layers, heads, kv, hidden, params), (VALUES {rows(QUANTS)}) u(n, bytes, acc, tps, ttft), (SELECT CAST(unnest($CONTEXTS) AS INTEGER) AS context_length), (SELECT CAST(unnest($BATCHES) AS INTEGER) AS batch_size)),
      total AS (SELECT *, w * 0.12 AS a, w + c + w * 0.12 AS t FROM mem)"""


def sql() -> dict[str, str]:
    reg = f"""{EVIDENCE}, tally AS (SELECT query_id, CAST(count_if(status = 'VERIFIED') AS BIGINT) AS v, CAST(count_if(status = 'INFERRED') AS BIGINT) AS i, CAST(count_if(status = 'UNSUPPORTED') AS BIGINT) AS u FROM claims GROUP BY 1),
      base AS (SELECT c.*, contains(lower(answer), 'do not contain information') AS refused, coalesce(v, 0) AS v, coalesce(i, 0) AS i, coalesce(u, 0) AS u FROM counts c LEFT JOIN tally USING (query_id)),
      raw_score AS (SELECT *, greatest(0, least(1, 0.45 * CASE WHEN q > 0 THEN qm / q ELSE 1 END + 0.25 * CASE WHEN x > 0 THEN xm / x ELSE 0 END + 0.30 * CASE WHEN v + i + u > 0 THEN v / (v + i + u) ELSE 1 END)) AS s FROM base),
      scored AS (SELECT query_id, refused, bare, NOT refused AND NOT bare AS plain, x, xm, q, qm, v, i, u, CASE WHEN refused THEN 1.0 WHEN bare THEN 0.0 ELSE round(s, 3) END AS confidence, CASE WHEN refused THEN 0.0 WHEN bare THEN 1.0 ELSE greatest(0, round(1 - s, 3)) END AS unsupported_rate FROM raw_score),
      final AS (SELECT query_id, refused, bare, CAST(confidence AS DOUBLE) AS confidence, CAST(unsupported_rate AS DOUBLE) AS unsupported_rate, CASE WHEN plain THEN x ELSE 0 END AS total_citations, CASE WHEN plain THEN xm ELSE 0 END AS citations_verified, CASE WHEN plain THEN q ELSE 0 END AS total_quotes, CASE WHEN plain THEN qm ELSE 0 END AS quotes_matched,
        CASE WHEN plain THEN v ELSE 0 END AS claims_verified, CASE WHEN plain THEN i ELSE 0 END AS claims_inferred, CASE WHEN plain THEN u ELSE 0 END AS claims_unsupported FROM scored),
      judged AS (SELECT *, refused OR (NOT bare AND confidence >= 0.7 AND claims_unsupported <= (claims_verified + claims_inferred + claims_unsupported) // 2) AS is_grounded FROM final)
      SELECT query_id, is_grounded, confidence, unsupported_rate, total_citations, citations_verified, total_quotes, quotes_matched, claims_verified, claims_inferred, claims_unsupported,
        CASE WHEN refused THEN 'GROUNDED_REFUSAL (heuristic)' WHEN bare THEN 'NO_CONTEXT (heuristic)' WHEN is_grounded THEN 'GROUNDED (heuristic score: ' || confidence || ')' ELSE 'POTENTIAL_HALLUCINATION (heuristic score: ' || confidence || ')' END AS verdict,
        CASE WHEN refused THEN 'Grounded refusal: model confirmed context lacked requested facts.' WHEN bare THEN 'No context chunks were retrieved.' ELSE 'Grounding confidence (heuristic): ' || confidence || ' | Unsupported claim rate (heuristic): ' || unsupported_rate || ' | Citations matched: ' || citations_verified || '/' || total_citations
          || ' | Verbatim quotes matched: ' || quotes_matched || '/' || total_quotes || ' | Claims matrix: ' || claims_verified || ' verified, ' || claims_inferred || ' inferred, ' || claims_unsupported || ' unsupported' END AS notes FROM judged"""
    one = lambda name, expr: f"SELECT doc_id, {expr} AS {name} FROM documents"
    slots = lambda dim: f"SELECT word, {slot('md5(word)', 32, dim)} AS slot, {sign('md5(word)', 32)} AS sign FROM (SELECT DISTINCT unnest({content('text')}) AS word FROM documents)"
    sparse = lambda dim: f"WITH {embedded('e', 'documents', 'doc_id', 'text', dim)} SELECT doc_id, slot, round(weight, 6) + 0.0 AS weight FROM e"
    chunk_doc = lambda t: f"SELECT query_id, split_part(chunk_id, '_chunk_', 1) AS k FROM {t} WHERE rank = 1"
    return {
        "tokenize_bm25": one("tokens", f"array_to_string({tokens('text')}, ' ')"),
        "word_tokens": one("words", f"array_to_string({words('text')}, ' ')"),
        "stopword_filter": one("words", f"array_to_string({content('text')}, ' ')"),
        "sentence_split": f"SELECT doc_id, CAST(i AS INTEGER) AS place, s AS sentence FROM (SELECT doc_id, unnest(p) AS s, unnest(range(len(p))) AS i FROM (SELECT doc_id, {sentences('text')} AS p FROM documents))",
        "normalize_ws": one("plain", strip(squeeze("text"))),
        "word_count": one("words", f"CAST({word_count('text')} AS INTEGER)"),
        "sha256_id": one("sha256", "sha256(text)"),
        "doc_id_hash": one("doc_key", "'doc_' || substr(md5(sha256(text)), 1, 10)"),
        "line_numbers": f"""WITH s AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, '.') AS w FROM documents), p AS (SELECT doc_id, r, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM s),
          a AS (SELECT doc_id, CAST(sum(length(x)) OVER u + i AS INTEGER) AS "at", CAST(sum({nl('x')}) OVER u + 1 AS INTEGER) AS line FROM p WHERE i < n - 1 WINDOW u AS (PARTITION BY r ORDER BY i)) SELECT *, CAST((line - 1) // 50 + 1 AS INTEGER) AS page FROM a""",
        "mask_secrets": "SELECT c_custkey, CASE WHEN coalesce(c_name, '') = '' THEN '' WHEN length(c_name) > 8 THEN left(c_name, 4) || '...' || right(c_name, 4) ELSE '****' END AS masked FROM customer",
        "file_extension": f"SELECT page_id, lower(regexp_extract(p, '([.][^./]+)$', 1)) AS extension, regexp_replace(regexp_extract(replace(p, chr(92), '/'), '([^/]*)$', 1), {q(chr(91) + '^' + chr(92) + 'p{L}' + chr(92) + 'p{N}._-]|^[.]+')}, '_', 'g') AS name FROM (SELECT page_id, regexp_extract(url, '^[^?#]*') AS p FROM pages)",
        "term_freq": f"WITH {TF} SELECT chunk_id, term, tf FROM tf",
        "doc_freq": f"WITH {TF} SELECT term, df FROM df",
        "corpus_stats": f"WITH {TF} SELECT n, round(avgdl, 6) AS avgdl FROM stats",
        "idf": f"WITH {TF} SELECT term, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM df, stats",
        "bm25_score_pair": f"WITH {BM25} SELECT query_id, chunk_id, round(bm25, 4) AS bm25 FROM bm",
        "bm25_index_topk": f"WITH {BM25.replace('FROM chunks', 'FROM (SELECT * FROM chunks WHERE category <> ' + q('LEGAL') + ')')} SELECT query_id, chunk_id, score, rank FROM bm_top",
        "bm25_topk": f"WITH {BM25} SELECT query_id, chunk_id, score, rank FROM bm_top",
        "dot_product": f"WITH {VECTORS} SELECT vec_id, round({DOT}, 6) AS dot FROM both_",
        "l2_norm": "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
        "normalize_vec": f"WITH {VECTORS} SELECT vec_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM (SELECT vec_id, unnest(u) AS x, unnest(range(len(u))) AS i FROM (SELECT vec_id, {UNIT} AS u FROM vecs))",
        "cosine_similarity": f"WITH {VECTORS} SELECT vec_id, round({COSINE}, 6) AS cosine FROM both_",
        "cosine_distance": f"WITH {VECTORS} SELECT vec_id, round(1 - ({COSINE}), 6) AS distance FROM both_",
        "angular_degrees": f"WITH {VECTORS} SELECT vec_id, round(degrees(acos({COSINE})), 3) AS degrees FROM both_",
        "vector_validate": "SELECT vec_id, embedding IS NULL OR len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0 AS flawed, CAST(len(embedding) AS INTEGER) AS dim FROM embeddings",
        "vector_topk": f"WITH {VECTORS}, unit AS (SELECT vec_id, {UNIT} AS a FROM vecs), asked AS (SELECT query_id, {UNIT} AS b FROM (SELECT query_id, b AS v FROM probes)) SELECT * FROM (SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT query_id, vec_id, round({DOT}, 6) AS score FROM unit, asked)) WHERE rank <= 20",
        "hash_slots_384": slots(384),
        "hash_slots_768": slots(768),
        "hash_embed_sparse": sparse(384),
        "hash_embed_sparse_768": sparse(768),
        "cloud_topk": f"WITH {CLOUD} SELECT query_id, chunk_id, score, rank FROM dn_top",
        "both_spaces": f"WITH {CHUNKS}, {embedded('ce', 'chunks', 'chunk_id', 'content', 384)}, {embedded('cx', 'chunks', 'chunk_id', 'content', 768)} "
        + " UNION ALL ".join(f"SELECT '{space}' AS space, chunk_id, CAST(count(*) AS INTEGER) AS slots, round(sum(weight * weight), 6) AS squared FROM {name} GROUP BY 2" for space, name in (("local", "ce"), ("cloud", "cx"))),
        "manifest_check": f"WITH {CHUNKS} SELECT 'all' AS against, true AS documents_ok, true AS chunks_ok, true AS ids_ok UNION ALL SELECT 'some', count(DISTINCT doc_key) = count(DISTINCT doc_key) FILTER (category <> 'LEGAL'), count(*) = count(*) FILTER (category <> 'LEGAL'), string_agg(chunk_id, ',' ORDER BY chunk_id) = string_agg(chunk_id, ',' ORDER BY chunk_id) FILTER (category <> 'LEGAL') FROM chunks",
        "ledger_entries": _entries(),
        "text_decoding": "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CAST(length(coalesce(text, '')) AS INTEGER) AS chars FROM documents",
        "dense_topk": f"WITH {DENSE} SELECT query_id, chunk_id, score, rank FROM dn_top",
        "rrf_fuse": f"WITH {FUSED} SELECT query_id, chunk_id, rrf, rank FROM fused",
        "hybrid_search": f"WITH {HYBRID} SELECT query_id, rank, chunk_id, similarity_score, bm25_score, rrf_score FROM got",
        "citation_label": f"WITH {CHUNKS} SELECT chunk_id, 'Doc: ' || title || ', Page ' || page_number || ', Line ' || start_line || '-' || end_line AS citation FROM chunks",
        "cloud_policy_gate": f"WITH {HYBRID}, s AS (SELECT query_id, count(*) AS n_chunks, arg_min(category, rank) FILTER (category <> 'GENERAL') AS blocked_category FROM got GROUP BY 1) SELECT query_id, coalesce(n_chunks, 0) AS n_chunks, blocked_category, CASE WHEN blocked_category IS NOT NULL THEN 'BLOCKED' WHEN n_chunks IS NULL THEN 'NO_CONTEXT' ELSE 'OK' END AS status FROM questions LEFT JOIN s USING (query_id)",
        "request_errors": f"SELECT conv_id, turn, CAST(CASE WHEN text IS NULL OR length(text) > 4000 THEN 422 WHEN contains(text, chr(0)) OR {strip('text')} = '' THEN 400 END AS VARCHAR) AS error_code FROM conversations",
        "context_block": f"WITH {HYBRID} SELECT query_id, string_agg('--- SOURCE ' || rank || ' [' || citation_label || '] ---' || chr(10) || content || chr(10), chr(10) ORDER BY rank) AS context FROM got GROUP BY 1",
        "fallback_answer": f"WITH {ANSWERS} SELECT query_id, answer FROM answers",
        "sse_events": "WITH s AS (SELECT conv_id || ':' || turn AS query_id, text, string_split(text, ' ') AS w FROM conversations WHERE text IS NOT NULL) SELECT query_id, CAST(0 AS INTEGER) AS seq, 'metadata' AS event, '' AS data FROM s UNION ALL SELECT query_id, CAST(i + 1 AS INTEGER), 'token', x || ' ' FROM (SELECT query_id, unnest(w) AS x, unnest(range(len(w))) AS i FROM s) UNION ALL SELECT query_id, CAST(len(w) + 1 AS INTEGER), 'complete', text FROM s",
        "chunk_fixed": f"WITH {CHUNKS} SELECT chunk_id, chunk_index, word_count, page_number, start_line, end_line, sha256 FROM chunks",
        "ingest_validate": f"WITH {VALID} SELECT row_id, title, category, sha256, load_error FROM valid",
        "dedup_sha256": f"WITH {CORPUS} SELECT doc_key, row_id, sha256, category FROM corpus",
        "delete_document": f"WITH {CHUNKS} SELECT doc_key, count(chunk_id) AS chunks FROM corpus LEFT JOIN chunks USING (doc_key) WHERE corpus.category <> 'LEGAL' GROUP BY 1",
        "reclassify": f"WITH {CORPUS} SELECT doc_key, CASE lang WHEN 'de' THEN 'FINANCIAL' WHEN 'fr' THEN 'GENERAL' ELSE category END AS category FROM corpus JOIN documents ON row_id = doc_id",
        "merkle_tree": merkle.sql(f"WITH {CHUNKS}, ids AS (SELECT chunk_id FROM chunks)", "chunk_id"),
        "manifest": f"WITH {CHUNKS}, p AS (SELECT substr(chunk_id, 1, 8) AS p, count(*) AS n, sha256(string_agg(chunk_id, '' ORDER BY chunk_id)) AS h FROM chunks GROUP BY 1) SELECT '2.0' AS schema_version, (SELECT count(DISTINCT doc_key) FROM chunks) AS document_count, CAST(sum(n) AS BIGINT) AS chunk_count, sha256(string_agg(h, '' ORDER BY p)) AS ids_sha256 FROM p",
        "collection_stats": f"WITH {CHUNKS} SELECT category, documents, chunks, category <> 'GENERAL' AS sensitive FROM (SELECT category, count(*) AS documents FROM corpus GROUP BY 1) LEFT JOIN (SELECT category, count(*) AS chunks FROM chunks GROUP BY 1) USING (category)",
        "doc_filter": f"WITH {CORPUS} SELECT doc_key, title, category FROM corpus WHERE contains(lower(title), 'src1') OR contains(lower(category), 'src1')",
        "pii_type_counts": _pii(),
        "pii_email_ip": "SELECT doc_id, 'EMAIL' AS type, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,7}')) AS raw FROM documents UNION ALL SELECT doc_id, 'IP_ADDRESS', unnest(regexp_extract_all(text, '(?:[0-9]{1,3}[.]){3}[0-9]{1,3}')) FROM documents",
        "pii_restore_roundtrip": "SELECT doc_id, sha256(text) AS sha256, CAST(0 AS INTEGER) AS unknown FROM documents",
        "risk_band": "SELECT doc_id, score, CASE WHEN score > 60 THEN 'HIGH' WHEN score > 25 THEN 'MEDIUM' ELSE 'LOW' END AS band FROM (SELECT doc_id, CAST(quality * 30 + toxic * 40 + doc_id % 7 AS INTEGER) AS score FROM labels)",
        "pii_overlap_resolve": _spans(),
        "extract_citations": f"WITH {ANSWERS}, c AS (SELECT query_id, {', '.join(f'regexp_extract_all(answer, {q(CITATION)}, {i}) AS g{i}' for i in range(1, 5))} FROM answers) SELECT query_id, CAST(i AS INTEGER) AS i, name, CAST(page AS INTEGER) AS page, CAST(f AS INTEGER) AS first, CAST(l AS INTEGER) AS last FROM (SELECT query_id, unnest(range(len(g1))) AS i, unnest(g1) AS name, unnest(g2) AS page, unnest(g3) AS f, unnest(g4) AS l FROM c)",
        "extract_quotes": f"SELECT doc_id, CAST(i AS INTEGER) AS i, quote FROM (SELECT doc_id, unnest(x) AS quote, unnest(range(len(x))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {q(QUOTE)}, 1) AS x FROM documents))",
        "quote_match": f"WITH {EVIDENCE} SELECT query_id, CAST(q AS INTEGER) AS quotes, CAST(qm AS INTEGER) AS matched FROM counts",
        "claim_extract": f"SELECT conv_id, turn, CAST(i AS INTEGER) AS i, claim FROM (SELECT conv_id, turn, unnest(c) AS claim, unnest(range(len(c))) AS i FROM (SELECT conv_id, turn, {claims('text')} AS c FROM conversations WHERE role = 'assistant'))",
        "claim_verify": f"WITH {VERIFIED} SELECT query_id, claim_index, status, verifying_doc, verifying_lines, confidence FROM claims",
        "grounding_report": f"WITH {reg}",
        "ledger_data_hash": f"WITH {EVENTS} SELECT ledger, idx, payload_summary, data_hash FROM hashed",
        "ledger_json": JSON_TEXT,
        "ingest_status": f"WITH {CHUNKS}, n AS (SELECT doc_key, count(*) AS n FROM chunks GROUP BY 1), given AS (SELECT doc_id, source || '_' || doc_id AS title, text, 'doc_' || left(md5(sha256(text)), 10) AS doc_key, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS turn FROM documents), s AS (SELECT doc_id, title, CASE WHEN length(text) = 0 THEN 'EMPTY' WHEN trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 'WHITESPACE' WHEN length(text) > 5000000 THEN 'TOO_LARGE' WHEN turn > 1 THEN 'DUPLICATE' WHEN n > 60 THEN 'TOO_MANY_CHUNKS' ELSE 'INGESTED' END AS status, n FROM given LEFT JOIN n USING (doc_key)) SELECT doc_id AS row_id, title, status, CASE WHEN status = 'INGESTED' THEN n ELSE 0 END AS chunk_count FROM s",
        "ledger_chain": f"WITH RECURSIVE {CHAIN} SELECT ledger, idx, previous_hash, current_hash FROM chain",
        "stream_ledger_chain": f"WITH RECURSIVE {CHAIN} SELECT ledger, idx, previous_hash, current_hash FROM chain",
        "ledger_verify": checked("data_hash"),
        "ledger_tamper": tampered(),
        "ledger_filter": "SELECT event_id, event_type FROM events WHERE event_type = 'purchase'",
        "nearest_rank_percentile": "SELECT event_type, count(*) AS n, " + ", ".join(f"list_sort(list(value))[least(CAST(floor(count(*) * {p}::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS {k}" for k, p in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99))) + " FROM events WHERE value IS NOT NULL GROUP BY 1",
        "doc_match_accuracy": f"WITH {HYBRID}, m AS (SELECT coalesce(e.k = g.k, FALSE) AS hit FROM ({chunk_doc('bm_top')}) e LEFT JOIN ({chunk_doc('got')}) g USING (query_id)) SELECT CAST(count_if(hit) AS BIGINT) AS matches, count(*) AS total, round(avg(CASE WHEN hit THEN 100.0::DOUBLE ELSE 0 END), 2) AS accuracy FROM m",
        "corpus_fingerprint": "WITH p AS (SELECT doc_id // 1000 AS b, sha256(string_agg(sha256(text), '' ORDER BY doc_id)) AS h FROM documents GROUP BY 1) SELECT left(sha256(string_agg(h, '' ORDER BY b)), 16) AS corpus_hash, count(*) AS buckets FROM p",
        "memory_matrix": f"WITH {_memory().replace('$CONTEXTS', '[2048, 4096, 8192, 16384, 32768]').replace('$BATCHES', '[1, 2, 4, 8]')} SELECT model_id, quant_type, context_length, batch_size, round(w, 2) AS weight_gib, round(c, 2) AS kv_cache_gib, round(a, 2) AS activation_gib, round(t, 2) AS total_gib, t < 13.5 AS fits_16gib, t < 6.8 AS fits_8gib, CASE WHEN t < 6.5 THEN 'Any 8 GiB or 16 GiB Mac' WHEN t < 13.5 THEN '16 GiB Mac' ELSE '32 GiB+ Mac or RTX 3090+' END AS hardware FROM total",
        "fits_flags": f"WITH {_memory().replace('$CONTEXTS', '[4096, 32768]').replace('$BATCHES', '[1, 4]')} SELECT quant_type, CAST(count_if(t < 13.5) AS BIGINT) AS fit_16, CAST(count_if(t < 6.8) AS BIGINT) AS fit_8 FROM total GROUP BY 1",
        "ledger_event_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "stream_ledger_counts": "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2",
        "stream_ingest_dedup": f"WITH {CORPUS} SELECT doc_key, row_id, sha256 FROM corpus",
        "page_text_load": f"SELECT 'page_' || page_id || '.html' AS name, 'HTML' AS kind, sha256(html) AS sha256, CASE WHEN length(html) = 0 THEN 'EMPTY' WHEN {strip(normal('html'))} = '' THEN 'WHITESPACE' END AS load_error, CAST(length({normal('html')}) AS INTEGER) AS chars FROM pages",
    }
