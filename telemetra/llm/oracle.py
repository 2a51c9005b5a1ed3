"""DuckDB statements of the tree operators."""

from __future__ import annotations


def crc32(decimal: str) -> str:
    """CRC-32 of ASCII text, bit by bit: each byte enters, then eight shifts."""
    feed = f"flatten(list_transform(range(length({decimal})), lambda i: [ascii(substr({decimal}, CAST(i + 1 AS INTEGER), 1)), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"""xor(list_reduce(list_prepend(4294967295, {feed}), lambda c, e:
      CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""


def _climb(tree: str, start: str, levels: int) -> str:
    """CTEs that fold nodes ``start`` (tree, place, digest, key) by sixteens: ``{tree}{k}`` (tree, place, digest, n), n the nodes of that level."""
    ctes = [f"{tree}0 AS (SELECT tree, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM {start})"]
    for k in range(levels):
        ctes.append(f"""{tree}{k + 1} AS (SELECT tree, place, digest, count(*) OVER (PARTITION BY tree) AS n FROM (
  SELECT tree, place // 16 AS place, sha256(string_agg(digest, '' ORDER BY place)) AS digest FROM {tree}{k} WHERE n > 1 GROUP BY tree, place // 16
  UNION ALL SELECT tree, place, digest FROM {tree}{k} WHERE n = 1))""")
    return ",\n".join(ctes)


def _walk(tree: str, start: str, levels: int) -> str:
    """CTEs that lead each row of ``start`` (id, tree, place, folded, proof) up: ``{tree}w{k}``."""
    ctes = [f"{tree}w0 AS (SELECT id, tree, place, folded, proof FROM {start})"]
    for k in range(levels):
        ctes.append(f"""{tree}w{k + 1} AS (
  SELECT id, w.tree, CASE WHEN any_value(l.n) > 1 THEN w.place // 16 ELSE w.place END AS place,
         CASE WHEN any_value(l.n) > 1 THEN sha256(string_agg(CASE WHEN l.place = w.place THEN folded ELSE l.digest END, '' ORDER BY l.place)) ELSE folded END AS folded,
         proof || coalesce(string_agg(CASE WHEN l.place <> w.place THEN l.digest END, '' ORDER BY l.place), '') AS proof
  FROM {tree}w{k} w JOIN {tree}{k} l ON l.tree = w.tree AND l.place // 16 = w.place // 16 GROUP BY id, w.tree, w.place, folded, proof)""")
    return ",\n".join(ctes)


def _leaf(text: str) -> str:
    fields = [f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return "sha256(" + " || ".join(fields) + ")"


LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Up to 16**5 documents a source and 16**3 sources.
MERKLE = f"""
WITH rowed AS (
  SELECT row_number() OVER () AS id, doc_id, source, {_leaf('text')} AS leaf,
         CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_leaf(LOWER)} ELSE {_leaf('text')} END AS now
  FROM documents
), leaves AS (
  SELECT *, coalesce('1' || source, '0') AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM rowed
), start AS (SELECT tree, place, leaf AS digest FROM leaves),
{_climb('s', 'start', 5)},
tops AS (SELECT 'top' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, tree AS name FROM s5),
{_climb('t', 'tops', 3)},
begin AS (SELECT id, tree, place, now AS folded, '' AS proof FROM leaves),
{_walk('s', 'begin', 5)},
middle AS (SELECT id, 'top' AS tree, tops.place, folded, proof FROM sw5 JOIN tops ON tops.name = sw5.tree),
{_walk('t', 'middle', 3)}
SELECT doc_id, leaf, s5.digest AS subroot, t3.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = t3.digest AS verified
FROM leaves JOIN s5 ON s5.tree = leaves.tree JOIN tw3 ON tw3.id = leaves.id CROSS JOIN t3"""

TRIE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY place) AS turns, {crc32('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM t GROUP BY conv_id
), seqs AS (
  SELECT o.conv_id, list_concat(coalesce(list_slice(b.turns, 1, o.h), []), list_slice(o.turns, o.h + 1, len(o.turns))) AS turns
  FROM own o LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 5
), steps AS (
  SELECT conv_id, len(turns) AS length, d AS depth, list_slice(turns, 1, d) AS node, CASE WHEN d > 0 THEN list_slice(turns, 1, d - 1) END AS parent
  FROM (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS d FROM seqs)
), nodes AS (
  SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN length = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256,
         CASE WHEN depth > 0 THEN (count(*) - 1) * strlen(node[-1].text) ELSE 0 END AS worth
  FROM steps GROUP BY depth, node
), kids AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent),
flat AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.parent
), above AS (SELECT worth, n_children, list_slice(node, 1, d) AS top FROM (SELECT *, unnest(range(depth + 1)) AS d FROM flat)),
sums AS (SELECT top, sum(worth) AS saved, count(*) FILTER (n_children = 0) AS leaves FROM above GROUP BY top)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM flat JOIN sums ON sums.top = flat.node"""
