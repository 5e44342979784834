"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from shoplake.llm.quality import RULES, STOP_WORDS, Rule


def _fails(r: Rule) -> str:
    """A row of the threshold table as SQL."""
    outside = [f"{r.metric} < {r.low}::DOUBLE"] * (r.low is not None) + [f"{r.metric} > {r.high}::DOUBLE"] * (r.high is not None)
    return f"CASE WHEN n_words >= {r.least_words} AND ({' OR '.join(outside)}) THEN '{r.name}' END"


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


def _crc32(text: str) -> str:
    """CRC-32 in SQL: a step for each bit of each byte, from the polynomial."""
    bits = f"flatten([[CAST(ascii({text}[i]) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] for i in range(1, length({text}) + 1)])"
    return f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1))), 4294967295)"


def _merkle(levels: int = 7, fanout: int = 8) -> str:
    """Trees by groups ``g`` of at most fanout^levels leaves: level l holds nodes of groups that are one node already as they are."""

    def tree(name: str, source: str, depth: int) -> list[str]:
        out = [f"{name}0 AS ({source})"]
        for k in range(depth):
            many = f"n > {fanout**k}"
            out.append(f"{name}r{k} AS (SELECT g, n, idx // {fanout} AS p, list(h ORDER BY idx) hs FROM {name}{k} WHERE {many} GROUP BY ALL)")
            out.append(f"{name}{k + 1} AS (SELECT g, n, p AS idx, sha256(array_to_string(hs, '')) h FROM {name}r{k} UNION ALL SELECT g, n, idx, h FROM {name}{k} WHERE NOT {many})")
        return out

    def climb(name: str, runs: str, source: str, depth: int) -> list[str]:
        """Rows (rid, g, idx, f, proof), a level at a time."""
        out = [f"{name}0 AS ({source})"]
        for k in range(depth):
            left, right = f"array_to_string(hs[1:idx % {fanout}], '')", f"array_to_string(hs[idx % {fanout} + 2:], '')"
            out.append(f"{name}{k + 1} AS (SELECT rid, a.g, CASE WHEN hs IS NULL THEN idx ELSE idx // {fanout} END idx, CASE WHEN hs IS NULL THEN f ELSE sha256({left} || f || {right}) END f, CASE WHEN hs IS NULL THEN proof ELSE proof || {left} || {right} END proof FROM {name}{k} a LEFT JOIN {runs}r{k} r ON r.g = a.g AND r.p = a.idx // {fanout})")
        return out

    field = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    whole = lambda text: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    parts = [
        f"d AS (SELECT row_number() OVER () rid, doc_id, coalesce('1' || lang, '0') g, {whole('text')} leaf, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {whole("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {whole('text')} END other FROM documents)",
        "l AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 idx, count(*) OVER (PARTITION BY g) n FROM d)",
        *tree("t", "SELECT g, n, idx, leaf AS h FROM l", levels),
        f"s AS (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 idx, count(*) OVER () n FROM t{levels})",
        *tree("u", "SELECT '' AS g, n, idx, subroot AS h FROM s", 3),
        *climb("c", "t", "SELECT rid, g, idx, other AS f, '' AS proof FROM l", levels),
        *climb("e", "u", f"SELECT rid, '' AS g, s.idx, f, proof FROM c{levels} c JOIN s ON s.g = c.g", 3),
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, leaf, subroot, u3.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = u3.h AS verified FROM e3 JOIN l USING (rid) JOIN s ON s.g = l.g, u3"


ORACLE_SQL = {
    "op11_tput_search": f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, {_TERMS} ts FROM documents), g AS (SELECT count(*) FILTER (WHERE len(ts) > 0) n, sum(len(ts))::BIGINT l FROM d),
p AS (SELECT rid, t, count(*) tf FROM (SELECT rid, unnest(ts) t FROM d) GROUP BY ALL), q AS (SELECT DISTINCT item_id, text FROM benchmark), i AS (SELECT item_id, text, unnest(list_distinct({_TERMS})) t FROM q),
w AS (SELECT t, CAST(floor(1000 * ln((2 * any_value(n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) w FROM p, g WHERE t IN (SELECT t FROM i) GROUP BY t),
m AS (SELECT rid, doc_id, 50 + (50 * len(ts) * n) // l m FROM d, g WHERE len(ts) > 0),
s AS (SELECT item_id, text, rid, any_value(doc_id) doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT score FROM i JOIN w USING (t) JOIN p USING (t) JOIN m USING (rid) GROUP BY item_id, text, rid)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS FIRST) rank FROM s WHERE score > 0) WHERE rank <= 50
""",
    "op12_merkle_manifest": _merkle(),
    "op4_quality_rules": f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x09-\\x0D\\x20]')) ls FROM d),
g0 AS (SELECT rid, ws, unnest(range(1, len(ws) - 3)) i FROM w WHERE len(ws) >= 5), g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') five FROM g0),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, five) c FROM g) WHERE c > 1), p AS (SELECT rid, unnest(range(i, i + 5)) pos FROM twice), r AS (SELECT rid, count(DISTINCT pos) n FROM p GROUP BY rid),
m AS (SELECT doc_id, len(ws) n_words, length(array_to_string(ws, '')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, len(ls) - len(list_distinct(ls)) n_dup_lines, coalesce(r.n, 0) n_repeat_words, len(ls) n_lines,
  length(regexp_replace(t, '[^!]+', '', 'g')) n_exclamations, len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) n_stop_words, len(list_filter(ls, lambda x: regexp_matches(x, '[.!?:;]["'')]*[\\x09-\\x0D\\x20]*$'))) n_ended_lines FROM w LEFT JOIN r USING (rid)),
q AS (SELECT *, word_chars / greatest(n_words, 1)::DOUBLE mean_word_chars, n_symbols / greatest(n_words, 1)::DOUBLE symbol_ratio, n_exclamations / greatest(n_words, 1)::DOUBLE exclamation_ratio, n_stop_words / greatest(n_words, 1)::DOUBLE stop_word_ratio, n_repeat_words / greatest(n_words, 1)::DOUBLE repeat_word_ratio,
  n_dup_lines / greatest(n_lines, 1)::DOUBLE dup_line_ratio, n_ended_lines / greatest(n_lines, 1)::DOUBLE ended_line_ratio, n_words < 10 OR 100 * n_repeat_words > 20 * n_words base_failed FROM m),
f AS (SELECT *, concat_ws(',', {", ".join(map(_fails, RULES))}) failed_rules FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM f
""",
    "op2_tool_links": """
WITH RECURSIVE t AS (SELECT conv_id, CAST(turn AS BIGINT) turn, role, coalesce(text, '') txt FROM conversations),
c AS (SELECT conv_id, 'call-' || turn call_id, turn, list_value('search', 'lookup', 'paint')[length(txt) % 3 + 1] AS name, length(txt) % 50 lim, nullif(regexp_extract(txt, '^\\p{L}+'), '') q FROM t WHERE role = 'assistant'),
r AS (SELECT conv_id, 'call-' || (turn - 1) call_id, turn, md5(txt) content FROM t WHERE role = 'user' AND turn >= 1),
f AS (SELECT conv_id, call_id, min_by(content, turn) content, count(*) n FROM r GROUP BY ALL),
w AS (SELECT conv_id, call_id, 'call-' || (turn - b) needed FROM c, (VALUES (2), (4)) v(b) WHERE turn >= b),
d AS (SELECT w.* FROM w JOIN c ON c.conv_id = w.conv_id AND c.call_id = w.needed),
p AS (SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM c UNION SELECT d.conv_id, d.call_id, p.level + 1 FROM p JOIN d ON d.conv_id = p.conv_id AND d.needed = p.call_id),
lv AS (SELECT conv_id, call_id, max(level) AS level FROM p GROUP BY ALL)
SELECT c.conv_id, c.call_id, c.turn, c.name, lv.level, f.content IS NOT NULL AS linked, coalesce(f.n, 0) AS n_results,
  CASE c.name WHEN 'search' THEN concat_ws(',', CASE WHEN q IS NULL THEN 'missing:query' END, CASE WHEN lim < 1 THEN 'low:limit' END, CASE WHEN lim > 40 THEN 'high:limit' END)
    WHEN 'lookup' THEN concat_ws(',', CASE WHEN q IS NULL THEN 'missing:query' END, CASE WHEN lim > 30 THEN 'high:limit' END) ELSE 'unknown_tool' END AS errors,
  '{"arguments":{' || CASE WHEN turn >= 4 THEN '"after":["call-' || (turn - 2) || '","call-' || (turn - 4) || '"],' WHEN turn >= 2 THEN '"after":["call-' || (turn - 2) || '"],' ELSE '' END || '"limit":' || lim || CASE WHEN q IS NOT NULL THEN ',"query":"' || q || '"' ELSE '' END || '},"id":"' || c.call_id || '","name":"' || c.name || '"}' AS canonical,
  f.content AS result
FROM c LEFT JOIN f USING (conv_id, call_id) JOIN lv USING (conv_id, call_id)
UNION ALL
SELECT r.conv_id, r.call_id, r.turn, NULL, NULL, FALSE, 0, 'orphan_result', NULL, r.content FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND c.call_id = r.call_id)
""",
    "op6_temporal_lists": """
WITH cap AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id % 365 AS INTEGER) AS DATE) fetched, regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]|[^/?#:\\[]*)', 1)), '\\.+$', '') h,
  regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]+(/[^?#]*)', 1) p FROM pages),
hosts AS (SELECT DISTINCT h FROM cap WHERE h <> ''),
e0 AS (SELECT CASE length(h) % 5 WHEN 1 THEN h || '/en' WHEN 2 THEN CASE WHEN len(string_split(h, '.')) > 2 THEN substr(h, strpos(h, '.') + 1) ELSE h END ELSE h END entry, length(h) * 7 % 200 s FROM hosts WHERE length(h) % 3 <> 0),
e AS (SELECT entry, min(s) s FROM e0 GROUP BY entry),
iv AS (SELECT entry, CAST(DATE '2024-01-01' + CAST(s AS INTEGER) AS DATE) since, CAST(DATE '2024-01-01' + CAST(s + 60 AS INTEGER) AS DATE) til FROM e
  UNION ALL SELECT entry, CAST(DATE '2024-01-01' + CAST(s + 150 AS INTEGER) AS DATE), NULL FROM e),
l AS (SELECT page_id, fetched, string_split(h, '.') labels, string_split(p, '/') parts FROM cap WHERE h <> ''),
k1 AS (SELECT page_id, fetched, labels, parts, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) i FROM l),
k2 AS (SELECT page_id, fetched, labels, parts, i, unnest(range(1, len(parts) + 1)) j FROM k1),
k AS (SELECT DISTINCT page_id, fetched, array_to_string(labels[i:], '.') || array_to_string(parts[1:j], '/') AS entry FROM k2),
hit AS (SELECT page_id, min(struct_pack(entry := k.entry, since := since)) b FROM k JOIN iv ON k.entry = iv.entry AND since <= fetched AND (til IS NULL OR fetched < til) GROUP BY page_id)
SELECT page_id, url, fetched, b IS NOT NULL AS blocked, b.entry AS entry, b.since AS since FROM cap LEFT JOIN hit USING (page_id)
""",
    "op10_revisits": """
WITH b AS (SELECT page_id, regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://|#.*$', '', 'g') bare, md5(coalesce(html, '')) tag, octet_length(encode(coalesce(html, '')))::VARCHAR size FROM pages),
u AS (SELECT *, regexp_extract(bare, '^[^/?]*') site, regexp_extract(substr(bare, length(regexp_extract(bare, '^[^/?]*')) + 1), '^[^?]*') path,
  list_sort(list_filter(string_split(regexp_extract(bare, '\\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|gclid|fbclid|msclkid|mc_cid|mc_eid|ref)(=|$)'))) args FROM b),
n AS (SELECT page_id, tag, size, regexp_replace(lower(site), '^(www|m)\\.', '') || regexp_replace(path, '(\\.html|/)$', '') || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS canonical FROM u),
v AS (SELECT page_id * 3 + k record_id, canonical, page_id % 1000 * 600 + k * 200000 ts, CASE WHEN k = 0 THEN 200 ELSE 304 END status, size, tag,
  CASE WHEN page_id % 7 = 0 THEN NULL WHEN k = 2 AND page_id % 5 = 0 THEN reverse(tag) ELSE tag END etag, CASE WHEN page_id % 7 = 0 THEN 'm' || (page_id % 11) || CASE WHEN k = 2 AND page_id % 3 = 0 THEN 'later' ELSE '' END END modified FROM n, (VALUES (0), (1), (2)) x(k)),
src AS (SELECT a.record_id, max(struct_pack(ts := f.ts, record_id := f.record_id, etag := f.etag, size := f.size, tag := f.tag, modified := f.modified)) s FROM v a JOIN v f ON a.canonical = f.canonical AND f.status = 200 AND f.ts < a.ts WHERE a.status = 304 GROUP BY a.record_id),
o AS (SELECT v.*, s, CASE WHEN status = 200 THEN 'full' WHEN s IS NULL THEN 'no_earlier' WHEN CASE WHEN v.etag IS NOT NULL AND s.etag IS NOT NULL THEN s.etag = v.etag ELSE coalesce(s.modified = v.modified, false) END THEN 'resolved' ELSE 'validator_mismatch' END outcome FROM v LEFT JOIN src USING (record_id))
SELECT record_id, canonical, ts, status, outcome, CASE WHEN outcome = 'resolved' THEN s.record_id END AS source_id,
  CASE outcome WHEN 'resolved' THEN '{"cache-control":"max-age=60","content-length":"' || s.size || '","content-type":"text/html","date":"t' || ts || '","x-tag":"' || s.tag || '"}'
    WHEN 'full' THEN '{"content-length":"' || size || '","content-type":"text/html","date":"t' || ts || '","x-tag":"' || tag || '"}' END AS headers
FROM o
""",
}
