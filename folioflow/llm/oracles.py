"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab"
_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"


def _hilbert() -> str:
    """The curve place of (x0, x1, x2, x3), of 4 bits each, one step of the transposed-axes method a subquery."""
    sql = "SELECT *, c0 AS x0, c1 AS x1, c2 AS x2, c3 AS x3 FROM cells"
    for q in (8, 4, 2):
        for i in range(4):
            p = q - 1
            swap = f"(xor(x0, x{i}) & {p})"
            first = f"CASE WHEN x{i} & {q} <> 0 THEN xor(x0, {p}) ELSE xor(x0, {swap}) END"
            if i:
                sql = f"SELECT * REPLACE ({first} AS x0, CASE WHEN x{i} & {q} <> 0 THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}) FROM ({sql})"
            else:
                sql = f"SELECT * REPLACE ({first} AS x0) FROM ({sql})"
    sql = f"SELECT *, x0 AS g0, xor(x0, x1) AS g1, xor(xor(x0, x1), x2) AS g2, xor(xor(xor(x0, x1), x2), x3) AS g3 FROM ({sql})"
    turn = "xor(xor(CASE WHEN g3 & 8 <> 0 THEN 7 ELSE 0 END, CASE WHEN g3 & 4 <> 0 THEN 3 ELSE 0 END), CASE WHEN g3 & 2 <> 0 THEN 1 ELSE 0 END)"
    bits = " + ".join(f"(((xor(g{k}, {turn})) >> {b}) & 1) * {1 << (4 * b + 3 - k)}" for b in range(4) for k in range(4))
    return f"SELECT *, {bits} AS curve FROM ({sql})"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _jaccard(percent: int, columns: str) -> str:
    """Components of exact Jaccard links over all pairs that share a shingle."""
    return rf"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT r, hash(array_to_string(w[i : i + 4], ' ')) AS sh
  FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS MATERIALIZED (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.r < b.r GROUP BY ALL),
link AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * c >= {percent} * (a.n + b.n - c)),
both_ways AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT r AS x, r AS y FROM d UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON b.x = reach.y),
least AS (SELECT reach.x AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON o.r = reach.y GROUP BY ALL)
SELECT {columns} FROM d LEFT JOIN n USING (r) JOIN least USING (r)"""


def _product_codes(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Rounds of assignment and update as one step each, over rows of (vector, part, position)."""
    near = lambda k: f"""
a{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, e := e)) AS m FROM (
  SELECT r, x.part, e, sum((x.v - c.v) * (x.v - c.v)) AS d FROM x JOIN c{k} c USING (part, pos) GROUP BY ALL) GROUP BY ALL)"""  # noqa: E731
    step = lambda k: f"""
c{k + 1} AS MATERIALIZED (SELECT part, e, pos, coalesce(u.v, c.v) AS v FROM c{k} c LEFT JOIN (
  SELECT part, a.m.e AS e, pos, (sum(v) - (sum(v) % count(*) + count(*)) % count(*)) // count(*) AS v FROM x JOIN a{k} a USING (r, part) GROUP BY ALL) u USING (part, e, pos))"""  # noqa: E731
    body = ",".join(near(k) + "," + step(k) for k in range(rounds)) + "," + near(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS r, vec_id, label, embedding FROM embeddings
  WHERE len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS MATERIALIZED (
  SELECT r, (i // (len(embedding) // {parts}))::INTEGER AS part, (i % (len(embedding) // {parts}))::INTEGER AS pos, floor({1024} * embedding[i + 1]::DOUBLE)::HUGEINT AS v
  FROM kept, unnest(range(len(embedding))) AS u(i)),
c0 AS MATERIALIZED (SELECT part, r AS e, pos, v FROM x WHERE r < {entries}),{body},
done AS MATERIALIZED (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY part) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, e, pos)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN done USING (r), book"""


_COLLOCATIONS = rf"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w, count(*) AS times FROM piece GROUP BY ALL),
g AS MATERIALIZED ({" UNION ALL ".join(f"""
  SELECT lang, {k} AS k, phrase, sum(times)::BIGINT AS f FROM (
    SELECT lang, times, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i : i + {k - 1}], ' '))) AS phrase FROM w) GROUP BY ALL""" for k in (1, 2, 3, 4))}),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE k = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 30),
part AS MATERIALIZED (SELECT lang || chr(9) || phrase AS key, f FROM g WHERE f >= 30),
cut AS (SELECT lang, phrase, a, j, lang || chr(9) || array_to_string(w[1 : j], ' ') AS p1, lang || chr(9) || array_to_string(w[j + 1 :], ' ') AS p2 FROM c, unnest(range(1, c.k)) AS u(j)),
scored AS (
  SELECT lang, phrase, a, min(struct_pack(score := ((2000000::HUGEINT * a) // (g1.f::HUGEINT + g2.f))::BIGINT, j := j, l := g1.f, r := g2.f)) AS b
  FROM cut JOIN part g1 ON g1.key = p1 JOIN part g2 ON g2.key = p2 GROUP BY ALL),
held AS (SELECT lang, array_to_string(w[i : i + s.k - 1], ' ') AS phrase, max(a) AS longer FROM c, unnest([2, 3]) AS s(k), unnest(range(1, c.k - s.k + 2)) AS u(i) WHERE s.k < c.k GROUP BY ALL),
kept AS (SELECT scored.* FROM scored LEFT JOIN held USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, b.l AS l, b.r AS r, n, b.score AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY b.score DESC, a DESC, phrase) AS rank FROM kept) JOIN total USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    hexdigit = lambda x: f"('0x' || substr(md5(coalesce({x}, '')), 1, 1))::INTEGER"
    n = "greatest(coalesce(n_chars, 0), 0)"
    return {
        "op2_hilbert_sharding": f"""
WITH crc AS ({_CRC_TABLE}),
ends AS (SELECT min(doc_id) AS low, max(doc_id) AS high FROM documents),
cells AS (
  SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size,
    xor(list_reduce(list_prepend(4294967295, {_BYTES}), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32,
    {hexdigit('lang')} AS c0, {hexdigit('source')} AS c1,
    CASE WHEN {n} = 0 THEN 0 ELSE least(length(bin({n})), 15) END AS c2,
    floor((coalesce(doc_id, low) - low) * 16 / (high - low + 1))::INTEGER AS c3,
    substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS salt
  FROM documents, ends, crc),
placed AS (
  SELECT doc_id, size, text_crc32, row_number() OVER (ORDER BY curve, salt, doc_id, size, text_crc32) - 1 AS r, count(*) OVER () AS n
  FROM ({_hilbert()})),
cut AS (SELECT *, (r * 24) // n AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (r - (shard * n + 23) // 24)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut""",
        "op8_suffix_automaton_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM benchmark),
item AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS win
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item),
win AS (
  SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(i)),
hit AS (SELECT r, win.n, i, item_id FROM win JOIN item USING (n, win)),
word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, n, i FROM hit), unnest(range(i, i + n)) AS u(p) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN ids USING (r)""",
        "op10_size_aware_jaccard": _jaccard(80, "doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id"),
        "op11_va_file_product_codes": _product_codes(),
        "op12_one_permutation_minhash": _jaccard(85, "doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept"),
        "op13_phrase_collocations": _COLLOCATIONS,
    }
