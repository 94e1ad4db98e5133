"""Check SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

from ampwise.llm.url_rules import DEFAULT, LOWER, RULES, UPPER
from ampwise.llm.warc import BASE32

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATION = rf"""
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_WORDS}') AS w FROM benchmark
), gram AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda k: array_to_string(w[k:k + 9], ' '))) AS g
  FROM item WHERE len(w) > 0
), doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORDS}') AS w FROM documents
), size AS (SELECT DISTINCT len(string_split(g, ' ')) AS n FROM gram),
place AS (
  SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, size WHERE len(w) >= n)
), hit AS (SELECT doc_id, n, k, item_id FROM place JOIN gram USING (g)),
word AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS spot FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items
  FROM hit GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

WARC_CAPTURES = f"""
WITH page AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
named AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, max(page_id) OVER (PARTITION BY body) AS newest,
         array_to_string(list_transform(range(0, 32), lambda k: substr('{BASE32}',
           (((('0x' || substr(hex, (k * 5) // 4 + 1, 2))::INT >> (3 - (k * 5) % 4)::INT) & 31) + 1)::INT, 1)), '') AS payload_digest
  FROM page
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = newest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> newest THEN newest END AS refers_to, true AS digest_ok
FROM named
"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 2)), lambda k: array_to_string(w[k:k + 3], ' '))) AS s
  FROM doc WHERE len(w) > 0
), size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN size USING (doc_id)
"""

URL_RULES = f"""
WITH rule(h, p, v) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
part AS (
  SELECT page_id, translate(coalesce(regexp_extract(rest, '^[^/?#]*'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM rest
), fit AS (
  SELECT page_id, arg_max(h || p, length(h) + length(p)) AS rule, arg_max(v, length(h) + length(p)) AS v
  FROM part, rule WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM part LEFT JOIN fit USING (page_id)
"""

def _tree_levels(name: str, nodes: str, levels: int) -> list[str]:
    """CTEs of a tree's levels: runs of eight and the nodes over them, from ``nodes`` (tree, i, d, n) upwards."""
    out = [f"{name}0 AS ({nodes})"]
    for k in range(levels):
        out.append(f"{name}run{k} AS (SELECT tree, n, i // 8 AS r, list(d ORDER BY i) AS kids FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
        out.append(
            f"{name}{k + 1} AS (SELECT tree, r AS i, sha256(array_to_string(kids, '')) AS d, (n + 7) // 8 AS n FROM {name}run{k} "
            f"UNION ALL SELECT tree, i, d, n FROM {name}{k} WHERE n = 1)"
        )
    return out


def _path_levels(name: str, tree: str, start: str, levels: int) -> list[str]:
    """CTEs that lead ``start`` (leaf columns, tree, i, proof, fold) up the levels of ``tree``."""
    left, right = "array_to_string(kids[1:i % 8], '')", "array_to_string(kids[i % 8 + 2:], '')"
    out = [f"{name}0 AS ({start})"]
    for k in range(levels):
        out.append(
            f"{name}{k + 1} AS (SELECT p.* EXCLUDE (i, proof, fold), i // 8 AS i, proof || coalesce({left} || {right}, '') AS proof, "
            f"coalesce(sha256({left} || fold || {right}), fold) AS fold FROM {name}{k} p LEFT JOIN {tree}run{k} t ON p.tree = t.tree AND p.i // 8 = t.r)"
        )
    return out


def _framed_sql(text: str) -> str:
    columns = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars")] + [text]
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in columns) + ")"


_CRC32 = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)"""
_SHOWN = f"CASE WHEN {_CRC32} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
_ROW_LEVELS, _GROUP_LEVELS = 9, 5  # for up to 8**9 rows a group and 8**5 groups

MERKLE_MANIFEST = "WITH " + ",\n".join(
    [
        f"""leaf AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_framed_sql("text")} AS d, {_framed_sql("shown")} AS shown
        FROM (SELECT *, {_SHOWN} AS shown FROM documents))""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS i,
        count(*) OVER (PARTITION BY tree) AS n FROM leaf)""",
        *_tree_levels("row_", "SELECT tree, i, d, n FROM placed", _ROW_LEVELS),
        f"top AS (SELECT tree AS name, d, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM row_{_ROW_LEVELS})",
        *_tree_levels("group_", "SELECT '' AS tree, i, d, n FROM top", _GROUP_LEVELS),
        *_path_levels("up_", "row_", "SELECT doc_id, d AS leaf, tree, i, '' AS proof, shown AS fold FROM placed", _ROW_LEVELS),
        *_path_levels(
            "over_",
            "group_",
            f"SELECT doc_id, leaf, top.d AS subroot, '' AS tree, top.i, proof, fold FROM up_{_ROW_LEVELS} u JOIN top ON u.tree = top.name",
            _GROUP_LEVELS,
        ),
    ]
) + f"""
SELECT doc_id, leaf, subroot, g.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = g.d AS verified
FROM over_{_GROUP_LEVELS} CROSS JOIN group_{_GROUP_LEVELS} g
"""


CHECKS = {
    "op4_decontamination": DECONTAMINATION,
    "op5_warc_captures": WARC_CAPTURES,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op9_url_rules": URL_RULES,
    "op12_merkle_manifest": MERKLE_MANIFEST,
}
