"""DuckDB SQL of the operators whose SQL is built from steps."""

from __future__ import annotations


def _crc(column: str) -> str:
    """CRC-32 of a text's UTF-8 bytes; `tab`, the values of single bytes, must be in scope."""
    h = f"hex(encode({column}))"
    data = f"list_transform(range(0, strlen({column})), lambda i: ('0x' || substr({h}, 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def spelling(slips: int = 199, points: int = 6, often: int = 5, dominance: int = 5) -> str:
    step = "SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END AS c FROM"
    byte = "(SELECT range AS b, range AS c FROM range(256))"
    for _ in range(8):
        byte = f"({step} {byte})"
    # levenshtein() counts bytes, so each letter beyond ASCII gets a byte that no word has
    letters = "".join(chr(c) for c in range(0xC0, 0x100))
    single = "".join(chr(c) for c in range(33, 97)).replace("'", "''")
    return f"""
        WITH RECURSIVE crc AS MATERIALIZED (SELECT list(c ORDER BY b) AS tab FROM {byte}),
        r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all(text, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w FROM documents),
        o AS (SELECT d, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS n FROM r GROUP BY ALL),
        k AS MATERIALIZED (SELECT w, n, d || ':' || w AS key FROM o),
        h AS (SELECT w, n, {_crc('key')} AS h FROM k, crc),
        s AS (SELECT CASE WHEN h % {slips} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, n FROM h),
        v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n, length(word) AS l, translate(word, '{letters}', '{single}') AS e
                           FROM s GROUP BY word HAVING length(word) >= {points} AND sum(n) >= {often}),
        p AS (SELECT a.word, b.word AS other, b.n AS theirs FROM v a JOIN v b ON a.l BETWEEN b.l - 1 AND b.l + 1 AND levenshtein(a.e, b.e) = 1),
        g AS (SELECT word, count(*) AS n_near, min({{'less': -theirs, 'w': other}}) AS best FROM p GROUP BY word),
        f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.less >= {dominance} * n THEN best.w END AS form,
                                  CASE WHEN -best.less >= {dominance} * n THEN -best.less END::BIGINT AS form_n FROM v LEFT JOIN g USING (word)),
        walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON f.word = walk.at WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
        FROM f JOIN walk USING (word) JOIN f e ON e.word = walk.at WHERE e.form IS NULL"""


def codes(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    far = "list_sum(list_transform(range(1, len(p.y) + 1), lambda i: (p.y[i] - b.c[i]) * (p.y[i] - b.c[i])))"
    ctes = [
        f"""k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
             WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""p AS MATERIALIZED (SELECT vec_id, label, q AS part, x[q * len(x) // {parts} + 1 : (q + 1) * len(x) // {parts}] AS y,
             row_number() OVER (PARTITION BY q ORDER BY vec_id) - 1 AS r FROM k, range({parts}) t(q))""",
        f"b0 AS MATERIALIZED (SELECT part, r AS entry, y AS c FROM p WHERE r < {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""a{i} AS MATERIALIZED (SELECT p.vec_id, p.label, p.part, p.y, min({{'far': {far}::BIGINT, 'entry': b.entry}}) AS best
             FROM p JOIN b{i} b USING (part) GROUP BY ALL)""")
        if i < rounds:
            ctes.append(f"""m{i} AS (SELECT part, best.entry AS entry, j, sum(y[j])::BIGINT AS s, count(*) AS n FROM a{i}, range(1, (SELECT max(len(y)) FROM p) + 1) t(j) GROUP BY ALL)""")
            ctes.append(f"b{i + 1} AS MATERIALIZED (SELECT part, entry, coalesce(any_value(m.c), any_value(b{i}.c)) AS c FROM b{i} LEFT JOIN (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY j) AS c FROM m{i} GROUP BY ALL) m USING (part, entry) GROUP BY ALL)")
    return f"""
        WITH {", ".join(ctes)},
        h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds}),
        e AS (SELECT vec_id, label, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.far)::BIGINT AS error FROM a{rounds} GROUP BY ALL)
        SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM e, h"""
