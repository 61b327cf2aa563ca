"""SQL statements of the queries whose results are fixed by their contract, for DuckDB."""

from __future__ import annotations

from tillwise.llm.manifest import FANOUT, LOWER, UPPER

#: Levels that the statement of the manifest unrolls: FANOUT ** LEVELS documents.
LEVELS, FOREST = 10, 6

#: CRC-32 of ASCII text: the table by its rule, then a byte at a time.
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY i) AS steps
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)
)"""


def crc32(text: str, steps: str = "steps") -> str:
    letters = f"list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT))"
    folded = f"list_reduce([4294967295::BIGINT] || {letters}, lambda c, b: xor(c >> 8, {steps}[(xor(c, b) & 255) + 1]))"
    return f"xor({folded}, 4294967295)"


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


def _tree(name: str, nodes: str, levels: int) -> tuple[list[str], str, str, str]:
    """CTEs of the levels above nodes(tree, pos, n, node) and of siblings; how a row `l` of
    the lowest level meets them, its siblings in order, and its digest `{0}` folded up."""
    ctes, last = [], nodes
    for k in range(levels):
        ctes.append(
            f"""{name}_{k}_near AS (
  SELECT tree, pos, n > 1 AS grows,
         coalesce(string_agg(node, '') OVER (PARTITION BY tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(node, '') OVER (PARTITION BY tree, pos // {FANOUT} ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM {last}
)"""
        )
        ctes.append(
            f"""{name}_{k + 1} AS (
  SELECT tree, pos // {FANOUT} AS pos, (n + {FANOUT - 1}) // {FANOUT} AS n,
         CASE WHEN n = 1 THEN any_value(node) ELSE sha256(string_agg(node, '' ORDER BY pos)) END AS node
  FROM {last} GROUP BY tree, pos // {FANOUT}, n
)"""
        )
        last = f"{name}_{k + 1}"
    joins = " ".join(f"JOIN {name}_{k}_near {name}{k} ON {name}{k}.tree = {name}_l.tree AND {name}{k}.pos = {name}_l.pos // {FANOUT**k}" for k in range(levels))
    proof = " || ".join(f"CASE WHEN {name}{k}.grows THEN {name}{k}.l || {name}{k}.r ELSE '' END" for k in range(levels))
    return ctes, joins, proof, last


def _folds(name: str, levels: int, source: str, start: str, keep: str) -> tuple[list[str], str]:
    """CTEs that fold a digest up, a level each, so that no expression nests."""
    ctes, last = [], source
    for k in range(levels):
        digest = start if k == 0 else "fold"
        ctes.append(
            f"""{name}_fold{k} AS (
  SELECT {keep}, CASE WHEN s.grows THEN sha256(s.l || x.{digest} || s.r) ELSE x.{digest} END AS fold
  FROM {last} x JOIN {name}_{k}_near s ON s.tree = x.{name}_tree AND s.pos = x.{name}_pos // {FANOUT**k}
)"""
        )
        last = f"{name}_fold{k}"
    return ctes, last


def manifest() -> str:
    fields = ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "text")))
    sent = ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", "sent")))
    ctes, joins, proof, top = _tree("t", "t_0", LEVELS)
    up, up_joins, up_proof, root = _tree("f", "f_0", FOREST)
    keep = "x.num, x.doc_id, x.leaf, x.sent, x.t_tree, x.t_pos, x.f_tree, x.f_pos"
    folds, folded = _folds("t", LEVELS, "leaves", "sent", keep)
    more, done = _folds("f", FOREST, folded, "fold", keep)
    return f"""WITH {CRC_TABLE},
said AS (
  SELECT row_number() OVER () AS num, doc_id, lang, source, n_chars, text,
         CASE WHEN {crc32("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END AS sent
  FROM documents, crc_table
),
hashed AS (
  SELECT num, doc_id, coalesce('=' || lang, '-') AS tree, sha256(concat({fields})) AS leaf, sha256(concat({sent})) AS sent FROM said
),
t_0 AS (
  SELECT num, doc_id, leaf, sent, leaf AS node, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, num) - 1 AS pos,
         count(*) OVER (PARTITION BY tree) AS n
  FROM hashed
),
{", ".join(ctes)},
f_0 AS (
  SELECT 'all' AS tree, tree AS of_tree, node, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n FROM {top}
),
{", ".join(up)},
leaves AS (
  SELECT t.num, t.doc_id, t.leaf, t.sent, t.tree AS t_tree, t.pos AS t_pos, 'all' AS f_tree, f.pos AS f_pos
  FROM t_0 t JOIN f_0 f ON f.of_tree = t.tree
),
{", ".join(folds)},
{", ".join(more)},
proofs AS (SELECT t_l.num, {proof} AS p FROM t_0 t_l {joins}),
up_proofs AS (SELECT f_l.of_tree, f_l.node AS subroot, {up_proof} AS p FROM f_0 f_l {up_joins})
SELECT x.doc_id, x.leaf, u.subroot, r.node AS root, sha256(p.p || u.p) AS proof_sha256, x.fold AS folded_root, x.fold = r.node AS verified
FROM {done} x JOIN proofs p ON p.num = x.num JOIN up_proofs u ON u.of_tree = x.t_tree JOIN {root} r ON r.tree = 'all'"""


RECOMPRESSION = r"""WITH said AS (
  SELECT row_number() OVER () AS num, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
starts AS (
  SELECT num, words, unnest(generate_series(1, len(words) - 34)) AS place FROM said WHERE len(words) >= 35
),
windows AS (
  SELECT num, place, sha256(array_to_string(words[place : place + 34], ' ')) AS said FROM starts
),
repeated AS (
  SELECT num, place FROM windows WHERE said IN (SELECT said FROM windows GROUP BY said HAVING count(*) > 1)
),
removed AS (
  SELECT DISTINCT num, unnest(generate_series(place, place + 34)) AS place FROM repeated
),
every AS (
  SELECT num, unnest(words) AS word, unnest(generate_series(1, len(words))) AS place FROM said
),
kept AS (
  SELECT e.num, string_agg(e.word, ' ' ORDER BY e.place) AS text FROM every e ANTI JOIN removed r ON r.num = e.num AND r.place = e.place GROUP BY e.num
)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words,
       (SELECT count(*) FROM removed r WHERE r.num = s.num) AS n_removed,
       sha256(coalesce(k.text, '')) AS kept_sha256
FROM said s LEFT JOIN kept k ON k.num = s.num"""

EMBEDDINGS = """WITH RECURSIVE vectors AS (
  SELECT row_number() OVER () AS num, vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
usable AS (
  SELECT num, vec_id, label, v FROM vectors
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.num AS a, b.num AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.num <> b.num
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93
),
reached AS (
  SELECT num AS a, num AS b FROM vectors
  UNION
  SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b
),
smallest AS (
  SELECT r.a AS num, min(v.vec_id) AS component_id FROM reached r JOIN vectors v ON v.num = r.b GROUP BY r.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.num) AS n_links, s.component_id, v.vec_id = s.component_id AS kept
FROM vectors v JOIN smallest s ON s.num = v.num"""

def conversations() -> str:
    """Costs go back row by row, then the audit is traced one edit a step."""
    name = "concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))"
    told = "ORDER BY turn NULLS FIRST, role, digest, copy"
    keep = "CASE WHEN initial = '{}' THEN 0 ELSE 2 END + cut"
    return rf"""WITH RECURSIVE {CRC_TABLE},
spoken AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS said, {crc32(name)} % 20 AS fault FROM conversations, crc_table
),
damaged AS (
  SELECT coalesce('=' || CAST(conv_id AS VARCHAR), '-') AS key, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(said, '[.!?]', '', 'g') ELSE said END AS said,
         unnest(CASE fault WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM spoken WHERE fault <> 0
),
hashed AS (SELECT *, sha256(CAST(length(role) AS VARCHAR) || ':' || role || said) AS digest FROM damaged),
placed AS (
  SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY key {told}) AS i, count(*) OVER (PARTITION BY key) AS n,
         row_number() OVER (PARTITION BY key, role, said {told}) AS nth, lag(left(role, 1)) OVER (PARTITION BY key {told}) AS ahead
  FROM hashed
),
marked AS (
  SELECT *, fault IN ('b', 'd') AS goes, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cut FROM (
    SELECT *, CASE WHEN NOT regexp_matches(said, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd'
                   WHEN regexp_matches(said, '[^.!?\x20\x09-\x0D][\x20\x09-\x0D]*$') THEN 't' ELSE '-' END AS fault
    FROM placed)
),
costs AS (
  SELECT key, n + 1 AS i, [0, 4, 2, 0] AS c FROM marked WHERE i = 1
  UNION ALL
  SELECT key, i, CASE WHEN goes THEN d ELSE [least(d[1], d[3] + 2, d[4] + 4), least(d[2], d[3] + 2, d[4] + 4), least(d[3], d[4] + 2), least(d[4], d[3] + 2)] END
  FROM (
    SELECT m.key, m.i, m.goes, CASE WHEN goes THEN list_transform(c, lambda x: x + 3) ELSE [
      least(c[1] + 3, c[3] + {keep.format("u")}, CASE WHEN initial = 's' THEN c[2] + cut ELSE c[1] + 3 END),
      least(c[2] + 3, c[3] + {keep.format("u")}), least(c[3] + 3, c[4] + {keep.format("a")}), least(c[4] + 3, c[3] + {keep.format("u")})] END AS d
    FROM costs JOIN marked m ON m.key = costs.key AND m.i = costs.i - 1)
),
traced AS (
  SELECT key, 1 AS i, 1 AS state, '' AS audit, CAST([] AS VARCHAR[]) AS lines, 0 AS step FROM marked WHERE i = 1
  UNION ALL
  SELECT key, CASE WHEN edit = 'I' THEN i ELSE i + 1 END, CASE edit WHEN 'D' THEN state WHEN 'S' THEN 2 ELSE follows END,
         audit || CASE edit WHEN 'S' THEN 'K' ELSE edit END,
         CASE edit WHEN 'D' THEN lines WHEN 'I' THEN lines || [turn || ':'] WHEN 'R' THEN lines || [turn || ':' || said] ELSE lines || [role || ':' || said] END,
         step + 1
  FROM (
    SELECT t.*, m.said, m.role, [3, 3, 4, 3][t.state] AS follows, ['user', 'user', 'assistant', 'user'][t.state] AS turn,
           CASE WHEN m.i IS NULL THEN 'I' WHEN h.c[t.state] = a.c[t.state] + 3 THEN 'D' WHEN h.c[t.state] = h.c[[3, 3, 4, 3][t.state]] + 2 THEN 'I'
                WHEN initial = 's' AND t.state = 1 AND h.c[1] = a.c[2] + cut THEN 'S'
                WHEN initial = ['u', 'u', 'a', 'u'][t.state] AND h.c[t.state] = a.c[[3, 3, 4, 3][t.state]] + cut THEN 'K' ELSE 'R' END AS edit
    FROM traced t JOIN costs h ON h.key = t.key AND h.i = t.i
    LEFT JOIN costs a ON a.key = t.key AND a.i = t.i + 1 LEFT JOIN marked m ON m.key = t.key AND m.i = t.i
    WHERE m.i IS NOT NULL OR h.c[t.state] > 0)
),
ended AS (SELECT key, arg_max(audit, step) AS audit, arg_max(lines, step) AS lines FROM traced GROUP BY key),
figures AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank,
         count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
         count(*) FILTER (WHERE ahead IS NOT NULL AND ahead || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY key
)
SELECT o.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
       coalesce(f.illegal, 0) AS illegal, CAST(coalesce(c.c[1], 0) AS BIGINT) AS cost, coalesce(e.audit, '') AS audit,
       sha256(coalesce(array_to_string(e.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('=' || CAST(conv_id AS VARCHAR), '-') AS key FROM conversations) o
LEFT JOIN figures f ON f.key = o.key LEFT JOIN ended e ON e.key = o.key LEFT JOIN costs c ON c.key = o.key AND c.i = 1"""


SQL = {"op5_recompression": RECOMPRESSION, "op6_embeddings": EMBEDDINGS, "op12_conversations": conversations(), "op13_manifest": manifest()}
