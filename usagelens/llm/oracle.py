"""SQL twins of the registered queries, where SQL can express them.

XXH64, BPE merges, Viterbi paths, learned models, a seeded shuffle and patterns that look behind have no such form;
their queries are held against plain loops in the tests.
"""

VECTORS = """WITH RECURSIVE sound AS (
    SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
  reached AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b),
  least AS (SELECT a AS vec_id, min(b) AS component_id FROM reached GROUP BY a)
  SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, component_id,
    e.vec_id = component_id AS kept
  FROM embeddings e JOIN least USING (vec_id)"""

_WORDS = ("regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

CONTAMINATION = rf"""WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
  docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
  item_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS p FROM items WHERE len(w) > 0)),
  doc_windows AS (
    SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS s
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p
      FROM docs, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
  hits AS (SELECT doc_id, p, n, item_id FROM doc_windows JOIN item_windows USING (n, s)),
  hit_words AS (SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS word FROM hits) GROUP BY doc_id),
  hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed FROM (
    SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(listed, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
  FROM docs LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)"""

ARCHIVED = """WITH payloads AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  firsts AS (SELECT h, min(page_id) AS first FROM payloads GROUP BY h),
  bits AS (
    SELECT page_id, strlen(h) AS payload_bytes, first, array_to_string(list_transform(string_split(sha1(h), ''),
      lambda c: ['0000', '0001', '0010', '0011', '0100', '0101', '0110', '0111', '1000', '1001', '1010', '1011', '1100',
        '1101', '1110', '1111'][instr('0123456789abcdef', c)]), '') AS b
    FROM payloads JOIN firsts USING (h))
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr(
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(b, 5 * k + 1, 1)::INT + 8 * substr(b, 5 * k + 2, 1)::INT
      + 4 * substr(b, 5 * k + 3, 1)::INT + 2 * substr(b, 5 * k + 4, 1)::INT + substr(b, 5 * k + 5, 1)::INT, 1)), '')
      AS payload_digest,
    CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first THEN first END AS refers_to
  FROM bits"""

def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    step = "lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    return f"xor(list_reduce([4294967295]::BIGINT[] || {codes}, {step}), 4294967295)"


_SPLIT = r"[^\x20\x09-\x0D]+"

TRIE = rf"""WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS p, k, w
    FROM (SELECT conv_id, turn, sha256(length(r)::VARCHAR || ':' || r || x) AS k, len(regexp_extract_all(x, '{_SPLIT}')) AS w
      FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL))),
  convs AS (SELECT c, c - c % 20 AS b, {_crc32('c::VARCHAR')} % 4 AS h FROM (SELECT DISTINCT conv_id AS c FROM turns)),
  rebuilt AS (
    SELECT c, 0 AS piece, p, k, w FROM convs JOIN turns ON conv_id = b WHERE b <> c AND p < h
    UNION ALL SELECT c, 1, p, k, w FROM convs JOIN turns ON conv_id = c WHERE b = c OR p >= h),
  prefixes AS (
    SELECT c, '' AS s, 0 AS d, 0 AS w FROM convs
    UNION ALL SELECT c, string_agg(k, '') OVER here, row_number() OVER here, w FROM rebuilt
    WINDOW here AS (PARTITION BY c ORDER BY piece, p ROWS UNBOUNDED PRECEDING)),
  lengths AS (SELECT c, max(d) AS n FROM prefixes GROUP BY c),
  nodes AS (
    SELECT s, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(w) AS own,
      sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = n), '')) AS ends_sha256
    FROM prefixes JOIN lengths USING (c) GROUP BY s, d),
  children AS (SELECT left(s, 64 * (d - 1)) AS s, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
  full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (s)),
  below AS (
    SELECT left(s, 64 * up) AS s, sum((n_children = 0)::BIGINT) AS n_leaves, sum(own) AS saved_tokens
    FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM full_nodes) GROUP BY ALL)
  SELECT a.conv_id, a.d::BIGINT AS depth, b.conv_id AS parent_conv_id, a.n_convs, a.n_children,
    n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, a.ends_sha256
  FROM full_nodes a JOIN below USING (s) LEFT JOIN nodes b ON a.d > 0 AND b.s = left(a.s, 64 * (a.d - 1))"""

RULES = rf"""WITH words AS (
    SELECT doc_id, x, regexp_extract_all(x, '{_SPLIT}') AS w,
      list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '{_SPLIT}')) AS lines
    FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents)),
  windows AS (
    SELECT doc_id, p, array_to_string(w[p:p + 7], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM words)),
  repeated AS (SELECT doc_id, p FROM windows JOIN (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1) USING (doc_id, s)),
  inside AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM repeated) GROUP BY doc_id),
  m AS (
    SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
      len(regexp_extract_all(x, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
      coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
      len(list_filter(w, lambda word: regexp_matches(word, '\p{{L}}'))) AS alpha,
      len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS bullets,
      len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS opened
    FROM words LEFT JOIN inside USING (doc_id)),
  bits AS (
    SELECT *, [n_words < 20, 100 * n_repeat_words > 30 * n_words, word_chars < 2 * n_words, word_chars > 12 * n_words,
      10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines, 10 * alpha < 7 * n_words, 10 * bullets > 9 * n_lines,
      10 * opened > 3 * n_lines]::INT[] AS b FROM m)
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b[1] + b[2] > 0 AS base_failed,
    b[1] + b[2] + b[5] + b[7] = 0 AND b[3] + b[4] + b[6] + b[8] + b[9] <= 1 AS kept,
    list_sum(list_transform(range(9), lambda k: b[k + 1] << k))::BIGINT AS failed
  FROM bits"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::VARCHAR)::VARCHAR || ':' || {value}::VARCHAR, '-')"


def _levels(name: str, leaves: str) -> str:
    """Nodes (tree, level, i, n, h) of every level above (tree, i, n, h)."""
    return f"""{name} AS (
    SELECT tree, 0 AS level, i, n, h FROM {leaves}
    UNION ALL SELECT tree, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM {name}
    WHERE n > 1 GROUP BY tree, level, i // 3, n)"""


def _siblings(name: str, nodes: str) -> str:
    return f"""{name} AS (
    SELECT tree, level, i, coalesce(string_agg(h, '') OVER (run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(h, '') OVER (run ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
    FROM {nodes} WHERE n > 1 WINDOW run AS (PARTITION BY tree, level, i // 3 ORDER BY i))"""


def _proof(name: str, leaves: str, siblings: str) -> str:
    return f"""{name} AS (
    SELECT a.tree, a.i, list(l || '|' || r ORDER BY level) FILTER (level IS NOT NULL) AS way
    FROM {leaves} a LEFT JOIN {siblings} b ON b.tree = a.tree AND b.i = a.i // (3 ** level)::BIGINT GROUP BY ALL)"""


_LEAF = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
MERKLE = f"""WITH RECURSIVE docs AS (
    SELECT doc_id, source, sha256({_LEAF} || {_field("text")}) AS h, sha256({_LEAF} || {_field("shown")}) AS t
    FROM (SELECT *, CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS shown FROM documents)),
  leaves AS (
    SELECT *, coalesce('s' || source, '') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
      count(*) OVER (PARTITION BY source) AS n FROM docs),
  {_levels("nodes", "leaves")},
  subroots AS (
    SELECT 'top' AS tree, tree AS below, h, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
  {_levels("top", "subroots")},
  {_siblings("near", "nodes")},
  {_siblings("near_top", "top")},
  {_proof("ways", "leaves", "near")},
  {_proof("ways_top", "subroots", "near_top")},
  whole AS (
    SELECT a.doc_id, a.h AS leaf, a.t, s.h AS subroot, (SELECT h FROM top WHERE n = 1) AS root,
      coalesce(w.way, []::VARCHAR[]) || coalesce(u.way, []::VARCHAR[]) AS way
    FROM leaves a JOIN ways w ON w.tree = a.tree AND w.i = a.i JOIN subroots s ON s.below = a.tree
    JOIN ways_top u ON u.i = s.i)
  SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(way, ''), '|', '')) AS proof_sha256, folded_root,
    folded_root = root AS verified
  FROM (SELECT *, list_reduce([t] || way, lambda d, p: sha256(split_part(p, '|', 1) || d || split_part(p, '|', 2))) AS folded_root
    FROM whole)"""


ORACLE: dict[str, str] = {
    "op3_vectors": VECTORS,
    "op4_decontaminate": CONTAMINATION,
    "op5_warc": ARCHIVED,
    "op11_trie": TRIE,
    "op12_rules": RULES,
    "op13_merkle": MERKLE,
}
