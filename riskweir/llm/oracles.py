"""DuckDB counterparts of the text queries that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(str_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), worded AS (SELECT lang, row_number() OVER () AS p, list_filter(str_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
), words AS (SELECT lang, p, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM worded
), totals AS (SELECT lang, count(*) AS n FROM words GROUP BY lang
), windows AS (SELECT lang, w1, lead(w1, 1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4 FROM words WINDOW o AS (PARTITION BY p ORDER BY i)
), counts AS (
  SELECT lang, [w1] AS ph, 1 AS size, count(*) AS f FROM windows GROUP BY lang, w1 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2], 2, count(*) FROM windows WHERE w2 IS NOT NULL GROUP BY lang, w1, w2 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3], 3, count(*) FROM windows WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3 HAVING count(*) >= 30
  UNION ALL SELECT lang, [w1, w2, w3, w4], 4, count(*) FROM windows WHERE w4 IS NOT NULL GROUP BY lang, w1, w2, w3, w4 HAVING count(*) >= 30
), longer AS (
  SELECT c.lang, c.ph[i:i + size_of_part - 1] AS ph, max(c.f) AS f
  FROM counts c, range(2, 4) AS s(size_of_part), range(1, 4) AS t(i) WHERE size_of_part < c.size AND i + size_of_part - 1 <= c.size GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.ph, c.f AS a, k, l.f AS l, r.f AS r, (2000000::HUGEINT * c.f) // (l.f + r.f) AS score
  FROM counts c JOIN range(1, 4) AS s(k) ON k < c.size JOIN counts l ON l.lang = c.lang AND l.ph = c.ph[1:k] JOIN counts r ON r.lang = c.lang AND r.ph = c.ph[k + 1:c.size]
), best AS (SELECT *, row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) AS place FROM cuts
), ranked AS (
  SELECT b.lang, array_to_string(b.ph, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, array_to_string(b.ph, ' ')) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.ph = b.ph WHERE place = 1 AND NOT coalesce(100 * g.f >= 80 * a, false)
)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

#: Levels of each tree in SQL: 8^7 documents of a language, 8^3 languages.
_DEEP, _WIDE = 7, 3


def _field(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


def _tree(name: str, leaves: str, deep: int) -> list[str]:
    """Levels of a tree over a table (t, pos, h, n): {name}0 and up; {name}s0 and up have the siblings of each node in its run."""
    out = [f"{name}0 AS (SELECT t, pos, h, count(*) OVER (PARTITION BY t) AS n FROM {leaves})"]
    for k in range(deep):
        out.append(
            f"{name}s{k} AS (SELECT a.t, a.pos, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS before, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS after "
            f"FROM {name}{k} a JOIN {name}{k} b ON a.t = b.t AND a.pos // 8 = b.pos // 8 WHERE a.n > 1 GROUP BY a.t, a.pos)"
        )
        out.append(f"{name}{k + 1} AS (SELECT t, pos // 8 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, (max(n) + 7) // 8 AS n FROM {name}{k} WHERE n > 1 GROUP BY t, pos // 8)")
    out.append(f"{name}top AS ({' UNION ALL '.join(f'SELECT t, h FROM {name}{k} WHERE n = 1' for k in range(deep + 1))})")
    return out


def _merkle() -> str:
    crc = (
        "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda crc, b: "
        "list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(crc, b)), 4294967295::BIGINT), 4294967295)"
    )
    head = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
    ctes = [
        f"leafed AS (SELECT doc_id, coalesce('=' || lang, '') AS t, sha256({head} || {_field('text')}) AS leaf, "
        f"CASE WHEN doc_id IS NOT NULL AND {crc} % 3 = 0 THEN sha256({head} || {_field(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS other FROM documents)",
        "placed AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leafed)",
        "leaves AS (SELECT t, pos, leaf AS h FROM placed)",
        *_tree("d", "leaves", _DEEP),
        "langs AS (SELECT 'all' AS t, row_number() OVER (ORDER BY t) - 1 AS pos, h, t AS lang FROM dtop)",
        *_tree("l", "langs", _WIDE),
    ]
    joins, steps = [], []
    for k in range(_DEEP):
        joins.append(f"LEFT JOIN ds{k} ON ds{k}.t = p.t AND ds{k}.pos = p.pos // {8 ** k}")
        steps.append(f"ds{k}")
    joins.append("JOIN langs g ON g.lang = p.t")
    for k in range(_WIDE):
        joins.append(f"LEFT JOIN ls{k} ON ls{k}.pos = g.pos // {8 ** k}")
        steps.append(f"ls{k}")
    proof = " || ".join(f"coalesce({s}.before || {s}.after, '')" for s in steps)
    columns = ", ".join(f"{s}.before AS b{i}, {s}.after AS a{i}" for i, s in enumerate(steps))
    ctes.append(f"f0 AS (SELECT doc_id, leaf, coalesce(other, leaf) AS f, g.h AS subroot, (SELECT h FROM ltop) AS root, sha256({proof}) AS proof_sha256, {columns} FROM placed p {' '.join(joins)})")
    for i in range(len(steps)):
        ctes.append(f"f{i + 1} AS (SELECT * REPLACE (CASE WHEN b{i} IS NULL THEN f ELSE sha256(b{i} || f || a{i}) END AS f) FROM f{i})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, proof_sha256, f AS folded_root, f = root AS verified FROM f{len(steps)}"


ORACLES: dict[str, str] = {"op11_phrase_mining": PHRASES, "op12_merkle_manifest": _merkle()}
