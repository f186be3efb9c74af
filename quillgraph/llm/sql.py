"""DuckDB statements that give the same rows as the queries of this subpackage, where SQL can."""

from __future__ import annotations

_WS = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"

_P4 = f"""
WITH e AS (
  SELECT lower(replace(regexp_replace(concept_id, '^{_WS}+|{_WS}+$', '', 'g'), '_', '-')) AS term, paper_id
  FROM paper_concepts WHERE concept_id IS NOT NULL
), n AS (
  SELECT term, count(*) AS edges, count(DISTINCT paper_id) AS papers FROM e GROUP BY term
), c AS (
  SELECT lower(replace(regexp_replace(id, '^{_WS}+|{_WS}+$', '', 'g'), '_', '-')) AS term, min(id) AS id
  FROM concepts WHERE id IS NOT NULL GROUP BY 1
), m AS (
  SELECT coalesce(c.id, n.term) AS concept_id, CAST(n.edges AS BIGINT) AS edges, n.papers,
    CASE WHEN n.papers / CAST((SELECT count(*) FROM papers) AS DOUBLE) > (SELECT generic_concept_threshold FROM search_config) THEN 'common'
         WHEN n.papers = 1 THEN 'rare' END AS mark
  FROM n LEFT JOIN c ON n.term = c.term
)
"""

# brute force; the operator may lose a pair now and then (none of the 507 at sf0.01)
_P1 = """
WITH v AS (
  SELECT row_idx, CAST(vector AS DOUBLE[64]) AS v FROM concept_vectors WHERE len(vector) = 64 AND list_sum(list_transform(vector, lambda x: abs(x))) > 0
), s AS (
  SELECT a.row_idx AS l, b.row_idx AS r, round(array_cosine_similarity(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.row_idx <> b.row_idx WHERE array_cosine_similarity(a.v, b.v) >= 0.85 - 1e-9
), k AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l ORDER BY score DESC, r) AS n FROM s) WHERE n <= 5
)
"""

# words with what stands around them, a letter for the boundary behind each, then cut by cut; marker lines between U+FDD0 and U+FDD1
_MARK = r"(?m)^([\x{09}\x{0b}\x{0c}\x{1c}-\x{20}\x{a0}\x{3000}]*<!-- (?:figure|equation): \d+ -->[\x{09}\x{0b}-\x{0d}\x{1c}-\x{20}\x{a0}\x{3000}]*)$"
_TOKEN = rf"(?:\x{{fdd0}}[^\x{{fdd1}}]*\x{{fdd1}}{_WS}*)*{_WS.replace('[', '[^', 1)[:-1]}\x{{fdd0}}\x{{fdd1}}]+{_WS}*(?:(?:\x{{fdd0}}[^\x{{fdd1}}]*\x{{fdd1}}{_WS}*)+$)?"
_END = r"[\n\r\x{85}\x{2028}\x{2029}]"
_P5 = rf"""
WITH RECURSIVE m AS (
  SELECT r.paper_id, min(struct_pack(most := r.chunk_max_tokens, shared := coalesce(r.chunk_overlap_tokens, 0))) AS l FROM (SELECT unnest(paper_ids) AS paper_id, chunk_max_tokens, chunk_overlap_tokens FROM index_manifests) r WHERE chunk_max_tokens IS NOT NULL GROUP BY 1
), p AS (
  SELECT paper_id, page, any_value(text) AS text FROM pages GROUP BY 1, 2
), t AS (
  SELECT p.paper_id, page, text, l.most AS most, greatest(0, least(l.shared, l.most - 1)) AS shared, regexp_extract_all(regexp_replace(text, '{_MARK}', chr(64976) || '\1' || chr(64977), 'g'), '{_TOKEN}') AS w
  FROM p JOIN m ON m.paper_id = p.paper_id WHERE text IS NOT NULL AND l.most >= 1
), c AS (
  SELECT *, array_to_string(list_transform(w, lambda x: CASE
    WHEN regexp_matches(replace(x, chr(13) || chr(10), chr(10)), '{_END}[\x{{09}}\x{{0b}}\x{{0c}}\x{{1c}}-\x{{20}}\x{{a0}}\x{{3000}}]*{_END}{_WS}*$') THEN 'p'
    WHEN regexp_matches(x, '[.!?\x{{2026}}\x{{3002}}\x{{ff01}}\x{{ff1f}}]["''\x{{201d}}\x{{2019}}\x{{300d}})\]]*{_WS}*$') THEN 's'
    WHEN regexp_matches(x, '{_END}{_WS}*$') THEN 'l' WHEN regexp_matches(x, '[,;:\x{{3001}}\x{{ff0c}}\x{{ff1b}}]{_WS}*$') THEN 'c' ELSE 'w' END), '') AS code
  FROM t WHERE len(w) > most
), s AS (
  SELECT paper_id, page, -1 AS piece, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS n FROM c
  UNION ALL
  SELECT paper_id, page, piece + 1, done, CASE
    WHEN length(code) - done <= fresh THEN length(code) - done
    WHEN strpos(back, 'p') BETWEEN 1 AND room THEN fresh - strpos(back, 'p') + 1 WHEN strpos(back, 's') BETWEEN 1 AND room THEN fresh - strpos(back, 's') + 1
    WHEN strpos(back, 'l') BETWEEN 1 AND room THEN fresh - strpos(back, 'l') + 1 WHEN strpos(back, 'c') BETWEEN 1 AND room THEN fresh - strpos(back, 'c') + 1 ELSE fresh END
  FROM (
    SELECT s.paper_id, s.page, s.piece, s.pos + s.n AS done, c.code, c.most - c.shared AS fresh, c.most - c.shared - greatest(1, (c.most - c.shared) // 2) + 1 AS room, reverse(substr(c.code, CAST(s.pos + s.n + 1 AS BIGINT), c.most - c.shared)) AS back
    FROM s JOIN c USING (paper_id, page) WHERE s.pos + s.n < length(c.code)
  )
)
SELECT paper_id, page, CAST(piece AS INTEGER) AS piece, regexp_replace(translate(array_to_string(w[pos - least(pos, shared) + 1:pos + n], ''), chr(64976) || chr(64977), ''), '{_WS}+$', '') AS text FROM s JOIN c USING (paper_id, page) WHERE piece >= 0
UNION ALL
SELECT paper_id, page, 0, regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') FROM t WHERE len(w) <= most AND regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') <> ''
"""

# runs of five words, as leakage.words has them
_P7 = r"""
WITH d AS (
  SELECT DISTINCT doc_id, regexp_extract_all(lower(replace(regexp_replace(text, '(\p{L})[-\x{2010}\x{ad}][ \t]*\r?\n[ \t]*(\p{L})', '\1\2', 'g'), chr(173), '')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM heldout_passages WHERE text IS NOT NULL
), dr AS (
  SELECT DISTINCT doc_id, array_to_string(w[n:n + 4], ' ') AS run FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS n FROM d)
), ir AS (
  SELECT item_id, n, len(w) AS words, array_to_string(w[n:n + 4], ' ') AS run FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS n FROM i)
), m AS (
  SELECT doc_id, item_id, any_value(words) AS item_words, count(DISTINCT k) AS covered_words
  FROM (SELECT doc_id, item_id, words, unnest(range(n, n + 5)) AS k FROM dr JOIN ir USING (run)) GROUP BY 1, 2
)
"""

SQL = {
    "p1_found": _P1 + "SELECT DISTINCT least(l, r) AS left_row_idx, greatest(l, r) AS right_row_idx FROM k",
    "p5_pieces": _P5,
    "p7_found": _P7 + "SELECT doc_id, item_id FROM m WHERE covered_words >= 0.5 * item_words",
    "p4_counts": _P4 + "SELECT concept_id, edges, papers, mark FROM m",
    "p4_found": _P4 + "SELECT concept_id, mark FROM m WHERE mark IS NOT NULL",
    "p5_found": rf"""
WITH m AS (
  SELECT paper_id, min(chunk_max_tokens) AS most FROM (SELECT unnest(paper_ids) AS paper_id, chunk_max_tokens FROM index_manifests) GROUP BY 1
), w AS (
  SELECT p.paper_id, p.page, m.most,
    len(list_filter(regexp_split_to_array(regexp_replace(replace(text, chr(13) || chr(10), chr(10)),
      '(?m)^[\x{{09}}\x{{0b}}\x{{0c}}\x{{1c}}-\x{{20}}\x{{a0}}\x{{3000}}]*<!-- (?:figure|equation): \d+ -->[\x{{09}}\x{{0b}}-\x{{0d}}\x{{1c}}-\x{{20}}\x{{a0}}\x{{3000}}]*$', '', 'g'), '{_WS}+'), lambda x: x <> '')) AS n
  FROM pages p JOIN m ON p.paper_id = m.paper_id WHERE text IS NOT NULL
)
SELECT DISTINCT paper_id, page FROM w WHERE n > most
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
