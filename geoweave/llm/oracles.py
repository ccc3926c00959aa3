"""DuckDB texts of the queries that SQL can express, written from the rules and not from the Spark code."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

_BLANK = "[\\x20\\x09-\\x0D]"
_FOLDED = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
_CONTROLS = "(<)(\\|turn\\|>|\\|body\\|>|\\|end\\|>|\\|image\\|>|\\|audio\\|>|\\|document\\|>|s>|/s>|<SYS>>|</SYS>>)|(\\[)(INST\\]|/INST\\])"

ORACLES["op3_chat_parts"] = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(role, '~', '~0'), '{_CONTROLS}', '\\1\\3~1\\2\\4', 'g')) AS nr,
    length(regexp_replace(replace(text, '~', '~0'), '{_CONTROLS}', '\\1\\3~1\\2\\4', 'g')) AS nt FROM m)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len('<|turn|><|body|><|end|>')} + nr + nt) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

ORACLES["op7_winnowing"] = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_FOLDED} AS w FROM benchmark),
bn AS (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bn))),
hit AS (SELECT DISTINCT doc_id, item_id, unnest(range(i, i + dw.n)) AS pos FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
per AS (SELECT doc_id, count(DISTINCT pos) AS n_hit, count(DISTINCT item_id) AS n_items FROM hit GROUP BY 1),
ids AS (SELECT doc_id, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)"""

ORACLES["op8_bag_minhash"] = f"""
WITH RECURSIVE d AS (SELECT doc_id, text, {_FOLDED} AS w FROM documents),
s AS (SELECT doc_id, g, count(*) AS n FROM (
  SELECT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)) GROUP BY 1, 2),
total AS (SELECT doc_id, sum(n) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS n FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
edge AS (
  SELECT a, b FROM common JOIN total ta ON ta.doc_id = a JOIN total tb ON tb.doc_id = b WHERE common.n >= 0.8 * (ta.n + tb.n - common.n)
  UNION SELECT m, doc_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS m FROM documents) WHERE m < doc_id),
both_ways AS (SELECT a, b FROM edge UNION SELECT b, a FROM edge),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a"""

_PHRASES = ("all rights reserved|cookie policy|privacy policy|terms of use|terms of service|accept cookies|use of cookies|enable javascript|javascript is disabled|sign in|sign up|log in to|"
            "subscribe to our|newsletter|click here|read more|share this|follow us|skip to content|back to top|lorem ipsum")

ORACLES["op9_line_quality"] = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}+'), lambda x: x <> '') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM g WHERE n > 1) GROUP BY 1),
l AS (
  SELECT doc_id, line, length(regexp_replace(line, '[^!-/:-@\\[-`{{-~]+', '', 'g')) AS marks, len(regexp_split_to_array(trim(line, ' '), '{_BLANK}+')) AS nw,
    len(regexp_extract_all(line, '[!?]{{2,}}|[#*$%&=~_+]{{2,}}|[-.,;:]{{4,}}')) AS runs, len(regexp_extract_all(line, '[|»•›·>]')) AS bars
  FROM (SELECT doc_id, unnest(lines) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
j AS (
  SELECT doc_id, line, (marks >= 4 AND marks > 0.3 * length(line)) OR (runs >= 3 AND runs >= 0.25 * nw) OR NOT regexp_matches(line, '[\\p{{L}}\\p{{N}}]') OR (bars >= 3 AND nw <= 6 * bars)
    OR (regexp_matches(line, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({_PHRASES})') AND nw <= 30) AS bad FROM l),
k AS (
  SELECT doc_id, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS n_lines_removed, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
    sum(length(regexp_replace(line, '{_BLANK}+', '', 'g'))) FILTER (WHERE bad) AS lost FROM j GROUP BY 1),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '{_BLANK}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines_removed, 0) AS n_lines_removed, coalesce(lost, 0) AS lost, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN k USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost <= 0.5 * word_chars AND 100 * n_symbols <= 10 * word_chars AND 2 * n_dup_lines <= n_lines AS kept, n_lines_removed FROM f"""


def _crc32(text: str) -> str:
    """Unsigned CRC-32 of a short ASCII string, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform({steps}, lambda x: x::BIGINT)), "
            "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END), 4294967295::BIGINT)")


ORACLES["op11_burst_trie"] = f"""
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''),
    md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT c, c - c % 100 AS b, {_crc32('CAST(c AS VARCHAR)')} % 6 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (
  SELECT h.c, t.i, t.role, t.text, false AS own FROM h JOIN t ON t.c = h.b AND t.i <= h.h
  UNION ALL SELECT h.c, t.i, t.role, t.text, true FROM h JOIN t ON t.c = h.c AND t.i > h.h),
s AS (SELECT c, row_number() OVER w AS d, length(text) AS n, md5(role || chr(1) || text) AS id, string_agg(md5(role || chr(1) || text), '') OVER w AS path FROM r WINDOW w AS (PARTITION BY c ORDER BY own, i)),
p AS (SELECT c, d, n, path, left(path, 32 * (d - 1)) AS up FROM s UNION ALL SELECT c, 0, 0, '', NULL FROM h),
g AS (SELECT path, any_value(up) AS up, any_value(d) AS d, any_value(n) AS n, min(c) AS c, count(*) AS k FROM p GROUP BY path),
e AS (SELECT path, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, d) AS path FROM p GROUP BY c) GROUP BY path),
kids AS (SELECT up AS path, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY up),
f AS (SELECT g.*, coalesce(kids.n, 0) AS kids FROM g LEFT JOIN kids USING (path)),
below AS (
  SELECT left(path, 32 * a) AS path, sum(CASE WHEN kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((k - 1) * n) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM f) GROUP BY 1)
SELECT f.c AS conv_id, CAST(f.d AS BIGINT) AS depth, u.c AS parent_conv_id, f.k AS n_convs, f.kids AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(e.ids, '')) AS ends_sha256
FROM f LEFT JOIN f u ON f.up = u.path LEFT JOIN e ON e.path = f.path JOIN below ON below.path = f.path"""


#: The pages of the given tables keep their text in one article element; its blocks are parted by p, h1 and br tags there.
ORACLES["op13_flat_blocks"] = """
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's'), '\\s+', ' ', 'g') AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(x, '</?(p|h1|br)>', chr(10), 'g'), '<[^>]*>', '', 'g'), chr(10)) AS lines FROM a),
c AS (
  SELECT page_id, url, array_to_string(list_filter(list_transform(lines, lambda l: trim(regexp_replace(
    regexp_replace(replace(replace(replace(replace(replace(l, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '&amp$', '&'), '\\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, length(text) AS n_chars FROM c"""


def _tree(name: str, base: str, levels: int) -> str:
    """CTEs {name}0.. of the nodes (tree, i, d, n) of every level above `base`, and {name}s0.. with what stands left and right of each node in its run of three."""
    out = [f"{name}0 AS MATERIALIZED ({base})"]
    for k in range(levels):
        out.append(f"""{name}s{k} AS MATERIALIZED (SELECT a.tree, a.i, a.n, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.d, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 3 = b.i // 3 GROUP BY a.tree, a.i, a.n)""")
        out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT tree, i // 3 AS i, CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d, (any_value(n) + 2) // 3 AS n FROM {name}{k} GROUP BY tree, i // 3)")
    return ",\n".join(out)


def _folds(name: str, tree: str, base: str, levels: int) -> str:
    """CTEs {name}0.. that carry (rid, tree, i, f, proof, tag) up the levels of a tree: the folded digest and the siblings passed."""
    out = [f"{name}0 AS MATERIALIZED ({base})"]
    for k in range(levels):
        out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT x.rid, x.tree, x.i // 3 AS i, CASE WHEN s.n = 1 THEN x.f ELSE sha256(s.l || x.f || s.r) END AS f, x.proof || s.l || s.r AS proof
  FROM {name}{k} x JOIN {tree}s{k} s ON s.tree = x.tree AND s.i = x.i)""")
    return ",\n".join(out)


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {text})"
#: Levels written out: trees of up to 3**_UP rows a source and 3**_UP_FOREST sources.
_UP, _UP_FOREST = 11, 6
_CUT = f"CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END"

ORACLES["op12_merkle_manifest"] = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('+' || source, '') AS tree, {_LEAF.format(text=_field('text'))} AS leaf, {_LEAF.format(text=_field(_CUT))} AS shown FROM documents),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM docs),
{_tree('t', 'SELECT tree, i, leaf AS d, n FROM placed', _UP)},
{_tree('w', f"SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, d, count(*) OVER () AS n, tree AS source FROM t{_UP}", _UP_FOREST)},
{_folds('f', 't', "SELECT rid, tree, i, shown AS f, '' AS proof FROM placed", _UP)},
{_folds('g', 'w', f"SELECT f.rid, '' AS tree, w.i, f.f, f.proof FROM f{_UP} f JOIN w0 w ON w.source = f.tree", _UP_FOREST)}
SELECT p.doc_id, p.leaf, t.d AS subroot, w.d AS root, sha256(g.proof) AS proof_sha256, g.f AS folded_root, g.f = w.d AS verified
FROM placed p JOIN t{_UP} t ON t.tree = p.tree JOIN g{_UP_FOREST} g ON g.rid = p.rid, w{_UP_FOREST} w"""
