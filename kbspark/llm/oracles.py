"""DuckDB SQL of the queries that SQL can express, over the same whole tables."""

from __future__ import annotations

from kbspark.llm import mixing, quality_rules

_WORDS = r"'[^\x20\x09-\x0D]+'"


def url_filters(rules: list[tuple[str, str, str]]) -> str:
    values = ", ".join(f"('{h}', '{p}', '{v}', '{h}{p}')" for h, p, v in rules)
    return f"""WITH r(rhost, rpath, rverdict, rule) AS (VALUES {values}), u AS (SELECT page_id, coalesce(CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END, '') AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u), p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict FROM p LEFT JOIN r ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath) QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) = 1"""


def quality(least: int = 200, width: int = 4) -> str:
    measures = ", ".join(f"('{m}', {m}, {spread})" for m, spread in quality_rules.MEASURES.items())

    def blended(name: str, keys: str, coarser: str, same: str) -> str:
        n = f"(SELECT {keys}, measure, edge, sum(n) AS n FROM fine GROUP BY ALL)"
        running = f"sum(coalesce(f.n, 0)) OVER (PARTITION BY {', '.join(f't.{k}' for k in keys.split(', '))}, t.measure ORDER BY c.edge)"
        on = " AND ".join(f"f.{k} IS NOT DISTINCT FROM t.{k}" for k in keys.split(", "))
        return f"""{name} AS (SELECT {', '.join(f't.{k}' for k in keys.split(', '))}, t.measure, c.edge, ({running}::DOUBLE + {least} * c.share) / (t.total + {least})::DOUBLE AS share FROM (SELECT {keys}, measure, sum(n) AS total FROM fine GROUP BY ALL) t
JOIN {coarser} c ON t.measure = c.measure{same} LEFT JOIN {n} f ON {on} AND f.measure = t.measure AND f.edge = c.edge)"""

    return f"""WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORDS})) AS l FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2))),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, source, len(w) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_capitals, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
v AS (SELECT *, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS symbol_pm, CASE WHEN word_chars > 0 THEN n_capitals * 1000 // word_chars ELSE 0 END AS capital_pm, CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS repeat_pm, CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS line_pm, CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS word_length_pm FROM m),
e AS (SELECT lang, source, measure, CAST(value AS BIGINT) AS value, spread FROM v, LATERAL (VALUES {measures}) AS x(measure, value, spread)),
fine AS (SELECT lang, source, measure, (value >> greatest(length(bin(value)) - 5, 0)) << greatest(length(bin(value)) - 5, 0) AS edge, count(*) AS n FROM e GROUP BY ALL),
whole AS (SELECT measure, edge, (sum(n) OVER (PARTITION BY measure ORDER BY edge))::DOUBLE / (sum(n) OVER (PARTITION BY measure))::DOUBLE AS share FROM (SELECT measure, edge, sum(n) AS n FROM fine GROUP BY ALL)),
{blended('bylang', 'lang', 'whole', '')}, {blended('own', 'lang, source', 'bylang', ' AND t.lang IS NOT DISTINCT FROM c.lang')},
t AS (SELECT lang, source, measure, min(CASE WHEN share * 100 >= 10 THEN edge END) AS q10, min(CASE WHEN share * 100 >= 50 THEN edge END) AS q50 FROM own GROUP BY ALL),
s AS (SELECT DISTINCT measure, spread FROM e), high AS (SELECT lang, source, t.measure, q50 + {width} * greatest(q50 - q10, spread) AS high FROM t JOIN s ON t.measure = s.measure),
o AS (SELECT v.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {' OR '.join(f"{m} > (SELECT high FROM high WHERE high.lang IS NOT DISTINCT FROM v.lang AND high.source IS NOT DISTINCT FROM v.source AND high.measure = '{m}')" for m in quality_rules.MEASURES)} AS over FROM v)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT over AS kept FROM o"""


def mixing_sql(shares: dict[str, int], other: int, block_chars: int = 100_000) -> str:
    weights = dict(shares) | {"*": other}
    slots = ", ".join(f"('{s}', {weights[s]}, {k}, {slot})" for s, k, slot in mixing.schedule(dict(shares) | {"\0other": other}) for s in ["*" if s[0] == "\0" else s])
    named = ", ".join(f"'{s}'" for s in shares)
    order = "ORDER BY h, doc_id NULLS FIRST, n, d"
    return f"""WITH plan(name, weight, k, slot) AS (VALUES {slots}), d AS (SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '*' END AS name, md5(coalesce(doc_id::VARCHAR, '') || ' ' || md5(coalesce(text, ''))) AS h, length(coalesce(text, '')) AS n, md5(coalesce(text, '')) AS d FROM documents),
b AS (SELECT *, CAST(coalesce(sum(n) OVER (PARTITION BY name {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // {block_chars} AS BIGINT) AS mix_block, row_number() OVER (PARTITION BY name, substr(h, 1, 3) {order}) AS i FROM d),
c AS (SELECT *, list_sum(list_transform([1, 2, 3], lambda j: (instr('0123456789abcdef', h[j]) - 1) * CASE j WHEN 1 THEN 256 WHEN 2 THEN 16 ELSE 1 END)) AS r FROM b)
SELECT doc_id, source, mix_block, CAST(mix_block // weight * {sum(weights.values())} + slot AS BIGINT) AS mix_slot, CAST(r * 1099511627776 + i AS BIGINT) AS mix_seq FROM c JOIN plan ON c.name = plan.name AND c.mix_block % plan.weight = plan.k"""


def components(nodes: str, links: str, key: str, columns: str) -> str:
    return f"WITH RECURSIVE {links}, reach(id, r) AS (SELECT a, a FROM l UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a), c AS (SELECT id, min(r) AS component FROM reach GROUP BY id) SELECT {columns} FROM {nodes} n LEFT JOIN c ON n.{key} = c.id"


EMBEDDINGS = components(
    "v",
    "v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.95)",
    "vec_id",
    "n.vec_id, (SELECT count(*) FROM l WHERE l.a = n.vec_id) AS n_links, coalesce(component, n.vec_id) AS component_id, coalesce(component, n.vec_id) = n.vec_id AS kept",
)
JACCARD = components(
    "z",
    rf"""w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, x FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM w)),
k AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), z AS (SELECT w.doc_id, coalesce(k.n, 0) AS n FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL), l AS (SELECT a, b FROM o JOIN k ka ON a = ka.doc_id JOIN k kb ON b = kb.doc_id WHERE 100 * o.n >= 75 * (ka.n + kb.n - o.n))""",
    "doc_id",
    "n.doc_id, n.n AS n_shingles, coalesce(component, n.doc_id) AS component_id",
)
#: Sequences are told apart by the MD5 of each turn's role and text in a row; CRC-32 bit by bit over the digits.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT), lambda crc, b: list_reduce([xor(crc, b)] || range(8), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
EXACT_SEARCH = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""
PREFIX_TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS turn, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h FROM t),
r AS (SELECT c.conv_id, t.i AS place, 0 AS own, turn, n_bytes FROM c JOIN t ON c.base = t.conv_id AND t.i <= c.h UNION ALL SELECT c.conv_id, t.i, 1, turn, n_bytes FROM c JOIN t ON c.conv_id = t.conv_id AND t.i > c.h),
m AS (SELECT conv_id, row_number() OVER w AS depth, md5(string_agg(turn, '') OVER w) AS node, n_bytes FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS UNBOUNDED PRECEDING) UNION ALL SELECT conv_id, 0, '', 0 FROM c),
l AS (SELECT conv_id, max(depth) AS depth FROM m GROUP BY conv_id),
e AS (SELECT m.node, m.depth, string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) AS ids FROM m JOIN l ON m.conv_id = l.conv_id AND m.depth = l.depth GROUP BY ALL),
n AS (SELECT node, m.depth, min(m.conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, max(l.depth) = m.depth AS leaf FROM m JOIN l ON m.conv_id = l.conv_id GROUP BY node, m.depth),
u AS (SELECT n.node, n.depth, p.node AS parent FROM n JOIN m p ON n.conv_id = p.conv_id AND p.depth = n.depth - 1),
k AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
s AS (SELECT a.node, a.depth, count(*) FILTER (WHERE n.leaf) AS n_leaves, CAST(sum((n.n_convs - 1) * n.n_bytes) AS BIGINT) AS saved_tokens FROM n JOIN m a ON n.conv_id = a.conv_id AND a.depth <= n.depth GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256 FROM n JOIN s ON n.node = s.node AND n.depth = s.depth LEFT JOIN k ON n.node = k.node AND n.depth = k.depth LEFT JOIN e ON n.node = e.node AND n.depth = e.depth LEFT JOIN u ON n.node = u.node AND n.depth = u.depth LEFT JOIN n p ON u.parent = p.node AND p.depth = n.depth - 1"""
