"""SQL of the queries that it can express, written from the contracts."""

from __future__ import annotations

from reviewgraph.llm.chat_format import BODY, CONTROL, END, MARK, TURN
from reviewgraph.llm.quality_rules import (
    COMMON_WORDS,
    COMPARED_WORDS,
    MAX_CHAR_DISTANCE,
    MAX_WORD_DISTANCE,
)

LINE_DEDUP = r"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line FROM (
    SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos FROM (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
keys AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keys WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT keys.*, repeated.keeper IS NOT NULL AND keys.doc_id <> repeated.keeper AS dropped
  FROM keys LEFT JOIN repeated ON keys.k = repeated.k)
SELECT doc_id, count(*)::BIGINT AS n_lines,
  (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id
"""


JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS s FROM (
      SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
    UNION ALL SELECT doc_id, array_to_string(w, chr(10)) FROM words WHERE len(w) IN (1, 2))),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON b.s = a.s AND b.doc_id > a.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT p.x, p.y FROM pairs p JOIN sizes a ON a.doc_id = p.x JOIN sizes b ON b.doc_id = p.y
  WHERE 100 * p.k >= 90 * (a.n + b.n - p.k)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT b.y, r.c FROM reached r JOIN both_ways b ON b.x = r.doc_id)
SELECT r.doc_id, max(coalesce(s.n, 0))::BIGINT AS n_shingles, min(r.c) AS component_id
FROM reached r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
"""

WARC = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages),
sized AS (
  SELECT page_id, octet_length(encode(payload)) AS n, sha256(payload) AS digest FROM payloads),
firsts AS (
  SELECT digest, min(page_id) AS smallest FROM sized WHERE n >= 100 GROUP BY digest)
SELECT s.page_id, s.n::BIGINT AS payload_bytes, s.digest AS payload_digest,
  CASE WHEN f.smallest <> s.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.smallest <> s.page_id THEN f.smallest END AS refers_to, true AS complete
FROM sized s LEFT JOIN firsts f ON f.digest = s.digest AND s.n >= 100
"""


def _marks(text: str) -> str:
    """How many marks escaping adds: one for each mark and each control string."""
    return " + ".join(f"(length({text}) - length(replace({text}, '{x}', ''))) // {len(x)}"
                      for x in (MARK, *CONTROL))


CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), ''))
    AS loss_sha256,
  sum({len(TURN) + len(BODY) + len(END)} + length(role) + length(text)
      + {_marks("role")} + {_marks("text")})::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""


def _distance(rows: str, key: str) -> str:
    """The Jensen-Shannon distance by key of rows with shares p and q."""
    part = "CASE WHEN {x} > 0 THEN {x} * log2({x} / ((p + q) / 2)) ELSE 0 END"
    return (f"SELECT {key}, sqrt(greatest(sum(({part.format(x='p')} + {part.format(x='q')}) / 2), 0))"
            f" AS distance FROM {rows} GROUP BY {key}")


_CLASSES = {1: r"[\x20\x09-\x0D]", 2: "[#*$%&|<>]", 3: "[A-Z]", 4: "[0-9]",
            5: "[.,;:!?''\"()-]"}
_CLASS_ROWS = " UNION ALL ".join(
    f"SELECT doc_id, lang, {k} AS bin, length(t) - length(regexp_replace(t, '{c}', '', 'g')) AS n "
    f"FROM texts" for k, c in _CLASSES.items())

QUALITY = rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
word_lists AS (
  SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words FROM texts),
words AS (
  SELECT doc_id, lang, i, words[i] AS word, len(words) AS n, words FROM (
    SELECT doc_id, lang, words, unnest(range(1, len(words) + 1)) AS i FROM word_lists)),
windows AS (
  SELECT doc_id, i, words[i] || chr(10) || words[i + 1] || chr(10) || words[i + 2] || chr(10)
    || words[i + 3] || chr(10) || words[i + 4] AS w FROM words WHERE i + 4 <= n),
repeated AS (
  SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM (
    SELECT a.doc_id, a.i, unnest([0, 1, 2, 3, 4]) AS k
    FROM windows a JOIN repeated b ON b.doc_id = a.doc_id AND b.w = a.w) GROUP BY doc_id),
lines AS (
  SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM texts),
line_counts AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT l.doc_id, l.lang, len(l.words) AS n_words,
    length(l.t) - length(regexp_replace(l.t, '[\x20\x09-\x0D]', '', 'g')) AS n_space,
    length(l.t) AS n_chars,
    length(l.t) - length(regexp_replace(l.t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM word_lists l LEFT JOIN line_counts d ON d.doc_id = l.doc_id
  LEFT JOIN covered c ON c.doc_id = l.doc_id),
marked AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
some_classes AS (
  {_CLASS_ROWS}
  UNION ALL SELECT doc_id, lang, 6, octet_length(encode(t)) - length(t) FROM texts),
classes AS (
  SELECT doc_id, lang, bin, n FROM some_classes
  UNION ALL SELECT t.doc_id, t.lang, 7, greatest(length(t.t) - s.n, 0)
  FROM texts t JOIN (SELECT doc_id, sum(n) AS n FROM some_classes GROUP BY doc_id) s
  ON s.doc_id = t.doc_id),
class_refs AS (
  SELECT lang, bin, n / greatest(sum(n) OVER (PARTITION BY lang), 1) AS q FROM (
    SELECT lang, bin, sum(n) AS n FROM classes WHERE lang IS NOT NULL GROUP BY lang, bin)),
class_shares AS (
  SELECT c.doc_id, c.n / greatest(sum(c.n) OVER (PARTITION BY c.doc_id), 1) AS p, r.q
  FROM classes c JOIN class_refs r ON r.lang = c.lang AND r.bin = c.bin),
class_distances AS ({_distance("class_shares", "doc_id")}),
uses AS (
  SELECT lang, word, count(*) AS n FROM words WHERE lang IS NOT NULL GROUP BY lang, word),
totals AS (SELECT lang, sum(n) AS total FROM uses GROUP BY lang),
common AS (
  SELECT u.lang, u.word, u.n / t.total AS q FROM (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM uses) u
  JOIN totals t ON t.lang = u.lang WHERE u.place <= {COMMON_WORDS}),
common_rest AS (SELECT lang, 1 - sum(q) AS q FROM common GROUP BY lang),
found AS (
  SELECT w.doc_id, w.word, count(*) AS n FROM words w
  JOIN common c ON c.lang = w.lang AND c.word = w.word GROUP BY w.doc_id, w.word),
word_shares AS (
  SELECT b.doc_id, coalesce(f.n, 0) / greatest(b.n_words, 1) AS p, c.q
  FROM base b JOIN common c ON c.lang = b.lang
  LEFT JOIN found f ON f.doc_id = b.doc_id AND f.word = c.word
  UNION ALL
  SELECT b.doc_id, (b.n_words - coalesce(f.n, 0)) / greatest(b.n_words, 1), r.q
  FROM base b JOIN common_rest r ON r.lang = b.lang
  LEFT JOIN (SELECT doc_id, sum(n) AS n FROM found GROUP BY doc_id) f ON f.doc_id = b.doc_id),
word_distances AS ({_distance("word_shares", "doc_id")})
SELECT m.doc_id, m.n_words::BIGINT AS n_words, (m.n_chars - m.n_space)::BIGINT AS word_chars,
  m.n_symbols::BIGINT AS n_symbols, m.n_dup_lines::BIGINT AS n_dup_lines,
  m.n_repeat_words::BIGINT AS n_repeat_words, m.base_failed,
  NOT m.base_failed AND (m.n_words < {COMPARED_WORDS}
    OR NOT (coalesce(c.distance > {MAX_CHAR_DISTANCE}, false)
            OR coalesce(w.distance > {MAX_WORD_DISTANCE}, false))) AS kept
FROM marked m LEFT JOIN class_distances c ON c.doc_id = m.doc_id
LEFT JOIN word_distances w ON w.doc_id = m.doc_id
"""

SEARCH = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
uses AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM lengths),
strata AS (
  SELECT doc_id, 100 - 50 + ((50 * n * n_docs) // n_terms)::BIGINT AS m
  FROM lengths CROSS JOIN totals),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM uses GROUP BY term) CROSS JOIN totals),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (
  SELECT a.item_id, u.doc_id,
    sum(w.w * ((1000000000 * u.tf) // (1000 * u.tf + 20 * s.m)))::BIGINT AS score
  FROM asked a JOIN weights w ON w.term = a.term JOIN uses u ON u.term = a.term
  JOIN strata s ON s.doc_id = u.doc_id GROUP BY a.item_id, u.doc_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place
  FROM scored WHERE score > 0)
SELECT item_id, place::INTEGER AS rank, doc_id, score FROM ranked WHERE place <= 50
"""

_CRC32 = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
    list_transform(range(1, length({x}) + 1), lambda i: ascii({x}[i])::BIGINT)),
    lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]),
      lambda c, step: xor(c >> 1, (c & 1) * 3988292384))))"""

TRIE = f"""
WITH own AS (
  SELECT conv_id AS conv, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(
      length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT DISTINCT conv, conv - conv % 100 AS donor, ({_CRC32.format(x="CAST(conv AS VARCHAR)")}) % 6 AS h
  FROM own),
taken AS (
  SELECT c.conv, 0 AS part, o.place, o.role, o.text
  FROM convs c JOIN own o ON o.conv = c.donor AND o.place <= c.h
  UNION ALL SELECT c.conv, 1, o.place, o.role, o.text
  FROM convs c JOIN own o ON o.conv = c.conv AND o.place > c.h),
turns AS (
  SELECT conv, row_number() OVER w AS depth, length(text) AS chars,
    sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w) AS k
  FROM taken WINDOW w AS (PARTITION BY conv ORDER BY part, place)),
paths AS (
  SELECT conv, depth, chars, k, coalesce(lag(k) OVER (PARTITION BY conv ORDER BY depth), '')
    AS parent FROM turns
  UNION ALL SELECT conv, 0, 0, '', NULL FROM convs),
ends AS (SELECT conv, max(depth) AS depth FROM paths GROUP BY conv),
nodes AS (
  SELECT p.k, p.parent, p.depth, p.chars, min(p.conv) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(p.conv::VARCHAR, ',' ORDER BY p.conv)
      FILTER (WHERE e.depth = p.depth), '')) AS ends_sha256
  FROM paths p JOIN ends e ON e.conv = p.conv GROUP BY p.k, p.parent, p.depth, p.chars),
children AS (
  SELECT parent AS k, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
totals AS (
  SELECT p.k, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves,
    sum((n.n_convs - 1) * n.chars) AS saved_tokens
  FROM nodes n JOIN paths p ON p.conv = n.conv_id AND p.depth <= n.depth
  LEFT JOIN children c ON c.k = n.k GROUP BY p.k)
SELECT n.conv_id, n.depth::BIGINT AS depth, a.conv_id AS parent_conv_id,
  n.n_convs::BIGINT AS n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
  t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN totals t ON t.k = n.k LEFT JOIN nodes a ON a.k = n.parent
LEFT JOIN children c ON c.k = n.k
"""


def oracle_sql() -> dict[str, str]:
    """SQL by query name."""
    return {"op1_jaccard_join": JACCARD, "op3_warc": WARC, "op4_line_dedup": LINE_DEDUP,
            "op6_quality_rules": QUALITY, "op9_chat_format": CHAT,
            "op11_lexical_search": SEARCH, "op12_prefix_trie": TRIE}
