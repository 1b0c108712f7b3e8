r"""DuckDB SQL of the training-data queries that SQL can express.

Each text states its query's contract on its own: all pairs, all windows and
closed forms in place of the operators' methods.  The others are left out: they
score with a learnt model (1, 2, 5), need look-around in patterns (7), a BPE
tokenizer (8) or all periodic runs of a text (11); their tests compare them with brute force, exact round trips
and held-out rows.
"""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {_words(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id < b.doc_id
  JOIN n AS na ON na.doc_id = a.doc_id JOIN n AS nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
), edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, e.b FROM reach AS r JOIN edges AS e ON r.b = e.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

# windows: spans of 768 tokens packed in stretches of 16, 256 tokens of history, 4 tokens a turn beside its words
CHAT_WINDOWS = rf"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    len({_words("text")}) + 4 AS tokens
  FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
), p AS (
  SELECT *, row_number() OVER w - 1 AS seq, coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    length('<turn>' || regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*/?turn)', '<\\\1', 'g') || chr(10)
      || regexp_replace(text, '<(\\*/?turn)', '<\\\1', 'g') || '</turn>') AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), q AS (
  SELECT *, seq AS first, before AS start FROM p WHERE seq = 0
  UNION ALL
  SELECT p.*, CASE WHEN p.before // 12288 > q.before // 12288 OR p.before + p.tokens - q.start > 768 THEN p.seq ELSE q.first END,
    CASE WHEN p.before // 12288 > q.before // 12288 OR p.before + p.tokens - q.start > 768 THEN p.before ELSE q.start END
  FROM q JOIN p ON p.conv_id IS NOT DISTINCT FROM q.conv_id AND p.seq = q.seq + 1
), spans AS (SELECT DISTINCT conv_id, first, start FROM q
), own AS (SELECT conv_id, sum(chars) AS chars FROM q GROUP BY conv_id
), recent AS (
  SELECT q.conv_id, sum(q.chars) AS chars FROM q
  JOIN spans AS s ON q.conv_id = s.conv_id AND q.before + q.tokens <= s.start AND q.before >= s.start - 256
  WHERE NOT (q.seq = 0 AND q.role = 'system') GROUP BY q.conv_id
), system AS (
  SELECT q.conv_id, sum(q.chars) AS chars FROM q JOIN spans AS s ON s.conv_id = q.conv_id AND s.first > 0
  WHERE q.seq = 0 AND q.role = 'system' GROUP BY q.conv_id
), g AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY seq) FILTER (role = 'assistant'), '') AS loss
  FROM q GROUP BY conv_id
)
SELECT g.conv_id, g.n_turns, g.turns_sha256, length(g.loss)::BIGINT AS loss_chars, sha256(g.loss) AS loss_sha256,
  (own.chars + coalesce(recent.chars, 0) + coalesce(system.chars, 0))::BIGINT AS formatted_chars
FROM g JOIN own USING (conv_id) LEFT JOIN recent USING (conv_id) LEFT JOIN system USING (conv_id)
"""

# risk 0.01 for all rules of a language together, confidence 0.95 over the languages tested; cutoffs from the mildest on
_RULES = """('symbols_per_word', 1, [0.8, 0.4, 0.2, 0.1, 0.05, 0.02], 1), ('dup_lines', 1, [0.9, 0.7, 0.5, 0.4, 0.3, 0.2], 2),
 ('repeats', 1, [0.25, 0.2, 0.15, 0.1, 0.05], 3), ('long_words', 1, [9.0, 8.0, 7.5, 7.0, 6.5, 6.0], 4),
 ('short_words', -1, [2.0, 2.5, 3.0, 3.5, 4.0], 5), ('few_distinct', -1, [0.05, 0.1, 0.2, 0.3, 0.4, 0.5], 6),
 ('upper_case', 1, [0.5, 0.3, 0.2, 0.1], 7)"""

QUALITY_RULES = rf"""
WITH b AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS t, {_words("text")} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)
), twice AS (
  SELECT doc_id, i FROM win JOIN (SELECT doc_id, x FROM win GROUP BY doc_id, x HAVING count(*) > 1) USING (doc_id, x)
), rep AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS k FROM twice) GROUP BY doc_id
), m AS (
  SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(lines) AS n_lines, len(list_distinct(w)) AS n_distinct, length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) AS n_upper
  FROM b LEFT JOIN rep USING (doc_id)
), v AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), r AS (
  SELECT doc_id, lang, base_failed, unnest([
    {{'rule': 'symbols_per_word', 'x': n_symbols::DOUBLE / greatest(n_words, 1)}},
    {{'rule': 'dup_lines', 'x': n_dup_lines::DOUBLE / greatest(n_lines, 1)}},
    {{'rule': 'repeats', 'x': n_repeat_words::DOUBLE / greatest(n_words, 1)}},
    {{'rule': 'long_words', 'x': word_chars::DOUBLE / greatest(n_words, 1)}},
    {{'rule': 'short_words', 'x': word_chars::DOUBLE / greatest(n_words, 1)}},
    {{'rule': 'few_distinct', 'x': n_distinct::DOUBLE / greatest(n_words, 1)}},
    {{'rule': 'upper_case', 'x': n_upper::DOUBLE / greatest(word_chars, 1)}}]) AS e FROM v
), cuts AS (
  SELECT rule, sign, unnest(cuts)::DOUBLE AS cutoff, unnest(range(1, len(cuts) + 1)) AS level, nr FROM (VALUES {_RULES}) AS g(rule, sign, cuts, nr)
), path AS (SELECT *, row_number() OVER (ORDER BY level, nr) - 1 AS step FROM cuts
), first AS (
  SELECT r.doc_id, r.lang, r.base_failed, min(p.step) FILTER ((e.x - p.cutoff) * p.sign > 0) AS step
  FROM r JOIN path AS p ON p.rule = e.rule GROUP BY ALL
), good AS (SELECT doc_id FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = 1
), tried AS (
  SELECT f.lang, p.step, count(*) AS n, count(*) FILTER (f.step <= p.step) AS k
  FROM first AS f JOIN good USING (doc_id), path AS p WHERE NOT f.base_failed GROUP BY ALL
  HAVING count(*) * ln(1 - 0.01::DOUBLE) <= ln(0.05::DOUBLE)
), tested AS (
  SELECT *, CASE WHEN k <= n * 0.01::DOUBLE THEN list_sum(list_transform(range(0, k + 1), lambda i:
    exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01::DOUBLE) + (n - i) * ln(1 - 0.01::DOUBLE))))
    ELSE 1.0 END AS p FROM tried
), last AS (
  SELECT lang, max(step) AS last FROM tested WHERE p <= 0.05::DOUBLE / (SELECT count(DISTINCT lang) FROM tried) GROUP BY lang
)
SELECT v.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, v.base_failed,
  NOT v.base_failed AND coalesce(f.step > l.last, true) AS kept
FROM v JOIN first AS f USING (doc_id) LEFT JOIN last AS l ON l.lang = v.lang
"""

MIX = f"""
WITH d AS (
  SELECT doc_id, source, len({_words("text")})::BIGINT AS size, md5('mix:' || doc_id::VARCHAR) AS h FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rn FROM d GROUP BY source
), c AS (SELECT *, ([1, 2, 3])[rn % 3 + 1]::DOUBLE AS weight, 3 * source_size AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER ()
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / sum(weight) OVER (ORDER BY cap / weight, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c
), t AS (
  SELECT *, CASE WHEN cap / weight <= level THEN cap::DOUBLE ELSE
    (SELECT level FROM l WHERE cap / weight > level ORDER BY cap / weight, rn LIMIT 1) * weight END AS target FROM l
), n AS (SELECT source, source_size, target, floor(target + 0.5)::BIGINT AS line FROM t
), placed AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d
)
SELECT doc_id, size, source_size, target, (
  greatest(0, least(start + size, line) - start)
  + greatest(0, least(source_size + start + size, line) - source_size - start)
  + greatest(0, least(2 * source_size + start + size, line) - 2 * source_size - start))::BIGINT AS taken
FROM placed JOIN n ON placed.source IS NOT DISTINCT FROM n.source
"""

# every window of an item's size that shares a shingle with it; items of five words and more
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, {_words("lower(text)")} AS w FROM documents
), i AS (SELECT item_id, {_words("lower(text)")} AS w FROM benchmark WHERE len({_words("lower(text)")}) >= 5
), ds AS (
  SELECT doc_id, n, p, array_to_string(w[p + 1 : p + 5], ' ') AS x
  FROM (SELECT doc_id, w, len(w) AS n, unnest(range(0, len(w) - 4)) AS p FROM d WHERE len(w) >= 5)
), it AS (
  SELECT item_id, m, x, count(*) AS c FROM (
    SELECT item_id, len(w) AS m, array_to_string(w[p + 1 : p + 5], ' ') AS x FROM (SELECT item_id, w, unnest(range(0, len(w) - 4)) AS p FROM i)
  ) GROUP BY ALL
), hits AS (SELECT doc_id, item_id, m, n, p FROM ds JOIN it USING (x)
), starts AS (
  SELECT DISTINCT doc_id, item_id, least(m, n) AS size, m, unnest(range(greatest(0, p - least(m, n) + 5), least(p, n - least(m, n)) + 1)) AS a FROM hits
), counted AS (
  SELECT doc_id, item_id, size, m, a, x, count(*) AS c FROM starts JOIN ds USING (doc_id)
  WHERE p >= a AND p <= a + size - 5 GROUP BY ALL
), sim AS (
  SELECT doc_id, item_id, size, m, a, sum(least(counted.c, it.c)) AS common
  FROM counted JOIN it USING (item_id, m, x) GROUP BY ALL
), leaks AS (
  SELECT DISTINCT doc_id, item_id FROM sim WHERE 100 * common >= 80 * (size - 4 + m - 4 - common)
), per AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id) AS item_ids FROM leaks GROUP BY doc_id
)
SELECT doc_id, coalesce(n_items, 0)::BIGINT AS n_items, coalesce(item_ids, '') AS item_ids, n_items IS NOT NULL AS contaminated
FROM documents LEFT JOIN per USING (doc_id)
"""

_WS = " || ".join(f"chr({c})" for c in (32, 9, 10, 11, 12, 13))

LINE_DEDUP = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), l AS (
  SELECT r, doc_id, i, ls[i] AS line, translate(trim(ls[i], {_WS}), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM t)
), common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), k AS (SELECT l.*, c.key IS NOT NULL AS dropped FROM l LEFT JOIN common AS c USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
FROM k GROUP BY r, doc_id
"""


def _leaf(text: str) -> str:
    fields = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(strlen(({x})::VARCHAR) || ':' || ({x})::VARCHAR, '-')" for x in fields) + ")"


def _up(name: str) -> str:
    """The levels above ``name``'s nodes of level 0, as the recursive part."""
    return f"""
  SELECT tree, level + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM {name}) WHERE n > 1 GROUP BY tree, level, pos // 8"""


def _fold(name: str, nodes: str, tops: str) -> str:
    return f"""
  SELECT f.r, f.tree, f.level + 1, f.pos // 8,
    sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.digest ELSE n.digest END, '' ORDER BY n.pos))
  FROM {name} AS f JOIN {tops} AS t ON t.tree = f.tree AND f.level < t.level
  JOIN {nodes} AS n ON n.tree = f.tree AND n.level = f.level AND n.pos // 8 = f.pos // 8
  GROUP BY f.r, f.tree, f.level, f.pos // 8"""


def _siblings(part: int, nodes: str, tops: str, tree: str, pos: str) -> str:
    return f"""
  SELECT l.r, {part} AS part, n.level, n.pos, n.digest
  FROM l JOIN {nodes} AS n ON n.tree = {tree} AND n.pos // 8 = (l.{pos} >> (3 * n.level)) // 8 AND n.pos <> l.{pos} >> (3 * n.level)
  JOIN {tops} AS t ON t.tree = n.tree AND n.level < t.level"""


MERKLE = f"""
WITH RECURSIVE bits AS (
  SELECT range AS b, range AS c, 0 AS k FROM range(256)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
), walk AS (
  SELECT DISTINCT doc_id, coalesce(doc_id::VARCHAR, '') AS s, 1 AS i, 4294967295::BIGINT AS c FROM documents
  UNION ALL SELECT w.doc_id, w.s, w.i + 1, xor(w.c >> 8, t.c)
  FROM walk AS w JOIN bits AS t ON t.k = 8 AND t.b = xor(w.c & 255, ascii(w.s[w.i])) WHERE w.i <= length(w.s)
), crc AS (SELECT doc_id, xor(c, 4294967295) AS h FROM walk WHERE i = length(s) + 1
), d AS (
  SELECT documents.*, CASE WHEN h % 3 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END AS other
  FROM documents JOIN crc ON documents.doc_id IS NOT DISTINCT FROM crc.doc_id
), l AS (
  SELECT row_number() OVER () AS r, *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, fresh) - 1 AS pos,
    dense_rank() OVER (ORDER BY tree) - 1 AS lang_pos
  FROM (SELECT doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("text")} AS leaf, {_leaf("other")} AS fresh FROM d)
), nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest FROM l UNION ALL{_up("nodes")}
), tops AS (SELECT tree, max(level) AS level FROM nodes GROUP BY tree
), subroots AS (SELECT n.tree, n.digest FROM nodes AS n JOIN tops AS t ON n.tree = t.tree AND n.level = t.level
), forest AS (
  SELECT 'root' AS tree, 0 AS level, row_number() OVER (ORDER BY tree) - 1 AS pos, digest FROM subroots UNION ALL{_up("forest")}
), forest_tops AS (SELECT tree, max(level) AS level FROM forest GROUP BY tree
), fold AS (
  SELECT r, tree, 0 AS level, pos, fresh AS digest FROM l UNION ALL{_fold("fold", "nodes", "tops")}
), fold_root AS (
  SELECT f.r, 'root' AS tree, 0 AS level, l.lang_pos AS pos, f.digest
  FROM fold AS f JOIN tops AS t ON f.tree = t.tree AND f.level = t.level JOIN l ON l.r = f.r
  UNION ALL{_fold("fold_root", "forest", "forest_tops")}
), ended AS (SELECT f.r, f.digest FROM fold_root AS f JOIN forest_tops AS t ON f.level = t.level
), siblings AS ({_siblings(0, "nodes", "tops", "l.tree", "pos")}
  UNION ALL{_siblings(1, "forest", "forest_tops", "'root'", "lang_pos")}
), proofs AS (SELECT r, sha256(string_agg(digest, '' ORDER BY part, level, pos)) AS proof FROM siblings GROUP BY r
), root AS (SELECT f.digest AS root FROM forest AS f JOIN forest_tops AS t ON f.level = t.level
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, root.root, coalesce(p.proof, sha256('')) AS proof_sha256,
  e.digest AS folded_root, e.digest = root.root AS verified
FROM l JOIN subroots AS s ON s.tree = l.tree JOIN ended AS e ON e.r = l.r LEFT JOIN proofs AS p ON p.r = l.r, root
"""

ORACLE_SQL = {
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op4_chat_windows": CHAT_WINDOWS,
    "op6_quality_rules": QUALITY_RULES,
    "op9_mix_sources": MIX,
    "op10_decontaminate_benchmark": DECONTAMINATE,
    "op12_line_dedup": LINE_DEDUP,
    "op13_merkle_manifest": MERKLE,
}
