"""DuckDB SQL for the registered queries that SQL can express, on whole tables."""

from __future__ import annotations

from . import queries
from .sharding import JUMP_MULTIPLIER

WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rules() -> str:
    return ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in queries.URL_RULES)


URL_FILTER = f"""WITH parts AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS after FROM pages),
split AS (SELECT row_number() OVER () AS n, page_id, coalesce(translate(regexp_extract(after, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(after, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
rules AS (SELECT * FROM (VALUES {_rules()}) v(rule_host, rule_path, decision)),
fit AS (SELECT s.*, rule_host || rule_path AS rule, decision, row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS place
FROM split s LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(decision, 'allow') AS verdict FROM fit WHERE place = 1"""


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)  # the standard reflected polynomial
        out.append(n)
    return out


_DIGITS = "'0123456789ABCDEF'"

SHARDING = f"""WITH RECURSIVE tab AS (SELECT {_crc_table()}::BIGINT[] AS t),
rows AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS body FROM documents),
octets AS (SELECT n, doc_id, octet_length(encode(body)) + 1 AS size, list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: ((instr({_DIGITS}, x[1]) - 1) * 16 + instr({_DIGITS}, x[2]) - 1)::BIGINT) AS b FROM rows),
sums AS (SELECT n, doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda acc, x: xor(acc >> 8, tab.t[(xor(acc, x) & 255) + 1])), 4294967295::BIGINT) AS crc FROM octets, tab),
jumps AS (
  SELECT n, m, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END) AS k, -1::BIGINT AS b, 0::BIGINT AS j FROM rows, (VALUES ({queries.SHARDS}), ({queries.SHARDS + 1})) v(m)
  UNION ALL
  SELECT n, m, k2, j, floor((j + 1)::DOUBLE * (2147483648::DOUBLE / ((k2 // 8589934592::HUGEINT) + 1)::DOUBLE))::BIGINT
  FROM (SELECT n, m, j, (k * {JUMP_MULTIPLIER}::HUGEINT + 1) % 18446744073709551616::HUGEINT AS k2 FROM jumps WHERE j < m)),
ends AS (SELECT n, max(b) FILTER (WHERE m = {queries.SHARDS}) AS shard, max(b) FILTER (WHERE m = {queries.SHARDS + 1}) AS grown FROM jumps GROUP BY n)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size, n) - 1 AS BIGINT) AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM sums JOIN ends USING (n)"""

SUBSTRING_DEDUP = f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
windows AS (SELECT n, doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT n, doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k),
repeats AS (SELECT n, i FROM windows JOIN firsts USING (k) WHERE doc_id > first),
covered AS (SELECT DISTINCT n, p FROM (SELECT n, unnest(generate_series(i, i + 12)) AS p FROM repeats)),
removed AS (SELECT n, count(*) AS c FROM covered GROUP BY n),
kept AS (SELECT n, string_agg(word, ' ' ORDER BY p) AS body FROM (SELECT n, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs) a ANTI JOIN covered USING (n, p) GROUP BY n)
SELECT doc_id, len(w) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM docs LEFT JOIN removed USING (n) LEFT JOIN kept USING (n)"""

TOP_K = """WITH v AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM ranked WHERE place <= 5"""

QUALITY_RULES = f"""WITH docs AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS body FROM documents),
words AS (SELECT *, regexp_extract_all(body, '{WORD}') AS w, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM docs),
windows AS (SELECT n, i, list_slice(w, i, i + 4) AS five FROM (SELECT n, w, unnest(generate_series(1, len(w) - 4)) AS i FROM words WHERE len(w) >= 5)),
again AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, five) AS c FROM windows) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT p) AS n_repeat FROM (SELECT n, unnest(generate_series(i, i + 4)) AS p FROM again) GROUP BY n),
stats AS (SELECT n, doc_id, source, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, len(regexp_extract_all(body, '[#*$%&|<>]')) AS n_symbols,
len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words FROM words LEFT JOIN covered USING (n)),
judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM stats),
hosts AS (SELECT source, count(*)::DOUBLE AS c, sum(base_failed::INT)::DOUBLE AS f FROM judged GROUP BY source),
total AS (SELECT sum(c) AS c, sum(f) / sum(c) AS r, count(*) AS h, sum(c * c) AS c2 FROM hosts),
spread AS (SELECT r, r * (1 - r) AS noise, CASE WHEN any_value(t.c - c2 / t.c) > 0 THEN greatest(0, (sum(hosts.c * (f / hosts.c - r) ** 2) - r * (1 - r) * (any_value(h) - 1)) / any_value(t.c - c2 / t.c)) ELSE 0 END AS between_hosts FROM hosts, total t GROUP BY r),
prior AS (SELECT least(greatest(r, 1e-6), 1 - 1e-6) AS r, CASE WHEN between_hosts > 0 AND noise > 0 THEN least(1e6, greatest(1, noise / between_hosts - 1)) WHEN noise > 0 THEN 1e6 ELSE 1 END AS strength FROM spread),
verdicts AS (SELECT source, (f + r * strength) / (c + strength) <= 0.5 AS stands FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND stands AS kept FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source"""


def _share(name: str, parent: str, parent_key: str, children: str, child_key: str, weight: str) -> str:
    """CTE of each child's budget: filled up in the order of supply by weight until the even share is below a child's supply."""
    by = f"PARTITION BY {parent_key}"
    order = f"{by} ORDER BY supply::DOUBLE / weight, {child_key}"
    return f"""{name}_in AS (SELECT c.*, budget FROM (SELECT *, {weight} AS weight FROM {children}) c JOIN {parent} USING ({parent_key})),
{name}_run AS (SELECT *, budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_in),
{name}_full AS (SELECT *, before * weight >= supply * rest AS filled FROM {name}_run),
{name}_left AS (SELECT {parent_key}, any_value(budget) - coalesce(sum(supply) FILTER (WHERE filled), 0) AS left_over, sum(weight) FILTER (WHERE NOT filled) AS open_weight FROM {name}_full GROUP BY {parent_key}),
{name} AS (SELECT f.* EXCLUDE (budget, before, rest, weight, filled), CAST(CASE WHEN filled THEN supply ELSE (left_over * weight) // open_weight END AS BIGINT) AS budget FROM {name}_full f JOIN {name}_left USING ({parent_key}))"""


def _weight(level: int) -> str:
    cases = " ".join(f"WHEN {' AND '.join(f'{c} = {v!r}' for c, v in zip(('domain', 'lang', 'source'), path))} THEN {w}" for path, w in queries.WEIGHTS.items() if len(path) == level)  # noqa: B905
    return f"(CASE {cases} ELSE 1 END)::HUGEINT" if cases else "1::HUGEINT"


MIXING = f"""WITH docs AS (SELECT doc_id, lang, source, CASE WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 10 THEN 'web' WHEN TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT) < 15 THEN 'reference' ELSE 'other' END AS domain,
len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS tokens FROM documents),
leaves AS (SELECT 0 AS root, domain, domain || '/' || lang AS family, lang, source, sum(tokens)::HUGEINT AS tokens, 4 * sum(tokens)::HUGEINT AS supply FROM docs GROUP BY ALL),
top AS (SELECT 0 AS root, (sum(tokens) * 4) // 5 AS budget FROM leaves),
d AS (SELECT root, domain, sum(supply)::HUGEINT AS supply FROM leaves GROUP BY ALL),
l AS (SELECT domain, family, lang, sum(supply)::HUGEINT AS supply FROM leaves GROUP BY ALL),
{_share("db", "top", "root", "d", "domain", _weight(1))},
{_share("lb", "(SELECT domain, budget FROM db)", "domain", "l", "family", _weight(2))},
{_share("sb", "(SELECT family, budget FROM lb)", "family", "leaves", "source", _weight(3))},
plan AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 1 ELSE budget // tokens END AS whole, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS rest FROM sb),
placed AS (SELECT doc_id, tokens, whole, rest, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11:' || whole || ':' || doc_id), doc_id) AS upto FROM docs JOIN plan USING (domain, lang, source)),
times AS (SELECT doc_id, whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM placed)
SELECT doc_id, CAST(unnest(range(CAST(n AS BIGINT))) AS INTEGER) AS epoch FROM times WHERE n > 0"""

ORACLES = {"op4_url_filter": URL_FILTER, "op5_sharding": SHARDING, "op6_substring_dedup": SUBSTRING_DEDUP, "op7_topk": TOP_K, "op9_quality_rules": QUALITY_RULES, "op10_mixing": MIXING}
