"""Oracles of the training-data operators that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

#: A table ``crc`` of the 256 steps of the checksum; ``_crc`` is the checksum of a list of bytes beside it.
_STEPS = "crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM range(256) r(b))"


def _crc(codes: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', n_chars, 'text')))})"


_STRUCK = f"{_crc('''list_transform(regexp_extract_all(doc_id::VARCHAR, '.'), lambda x: ord(x)::BIGINT)''')} % 7 = 0 AND n_chars IS NOT NULL"
#: A step up a level of trees t(g, level, i, h, n): group, level, place, hash and width.
_UP = "SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (n + 1) // 2 FROM {0} WHERE n > 1 GROUP BY g, level, i // 2, n"
_STEP_OF_FOLD = "SELECT f.g, f.place, f.i // 2, f.level + 1, sha256(CASE WHEN f.i % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), (f.n + 1) // 2 FROM {0} f LEFT JOIN {1} s ON s.g = f.g AND s.level = f.level AND s.i = xor(f.i, 1) WHERE f.n > 1"

MERKLE = (
    f"WITH RECURSIVE {_STEPS}, d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_STRUCK} THEN {_leaf('(n_chars + 1)')} END AS changed FROM documents, crc),"
    " p AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),"
    f" lv(g, level, i, h, n) AS (SELECT g, 0::BIGINT, i, leaf, n FROM p UNION ALL {_UP.format('lv')}),"
    " subs AS (SELECT g, h FROM lv WHERE n = 1),"
    f" up(g, level, i, h, n) AS (SELECT 0::BIGINT, 0::BIGINT, g, h, (SELECT count(*) FROM subs) FROM subs UNION ALL {_UP.format('up')}),"
    " beside AS (SELECT p.g, p.i, string_agg(h, '' ORDER BY top, level) AS proof FROM p, LATERAL (SELECT 0 AS top, s.level, s.h FROM lv s WHERE s.g = p.g AND s.n > 1 AND s.i = xor(p.i >> s.level, 1) UNION ALL SELECT 1, s.level, s.h FROM up s WHERE s.n > 1 AND s.i = xor(p.g >> s.level, 1)) GROUP BY p.g, p.i),"
    f" low(g, place, i, level, h, n) AS (SELECT g, i, i, 0::BIGINT, coalesce(changed, leaf), n FROM p UNION ALL {_STEP_OF_FOLD.format('low', 'lv')}),"
    f" high(g, place, i, level, h, n) AS (SELECT 0::BIGINT, g * 1000000000 + place, g, 0::BIGINT, h, (SELECT count(*) FROM subs) FROM low WHERE n = 1 UNION ALL {_STEP_OF_FOLD.format('high', 'up')}),"
    " root AS (SELECT h FROM up WHERE n = 1)"
    " SELECT p.doc_id, p.leaf, subs.h AS subroot, root.h AS root, sha256(coalesce(beside.proof, '')) AS proof_sha256, high.h AS folded_root, high.h = root.h AS verified"
    " FROM p JOIN subs USING (g) JOIN high ON high.place = p.g * 1000000000 + p.i AND high.n = 1 LEFT JOIN beside ON beside.g = p.g AND beside.i = p.i, root"
)

_RUN_BYTES = "flatten(list_transform(regexp_extract_all(coalesce(doc_id::VARCHAR, '') || ':' || run, '.'), lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192 | (ord(x) >> 6)::BIGINT, 128 | (ord(x) & 63)::BIGINT] END))"

SPELLING = (
    f"WITH RECURSIVE {_STEPS}, runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),"
    " per AS (SELECT doc_id, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),"
    f" hashed AS (SELECT run, c, {_crc(_RUN_BYTES)} AS h FROM per, crc),"
    " w AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(c)::BIGINT AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(c) >= 2),"
    " cut AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),"
    " pairs AS (SELECT DISTINCT a.word, b.word AS near FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word UNION SELECT word, rest FROM cut JOIN (SELECT word AS rest FROM w) USING (rest) UNION SELECT rest, word FROM cut JOIN (SELECT word AS rest FROM w) USING (rest)),"
    " ranked AS (SELECT p.word, near, f.n AS near_n, row_number() OVER (PARTITION BY p.word ORDER BY f.n DESC, near) AS k, count(*) OVER (PARTITION BY p.word) AS n_near FROM pairs p JOIN w f ON f.word = near),"
    " forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n FROM w LEFT JOIN ranked r ON r.word = w.word AND k = 1),"
    " chain AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)"
    " SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word JOIN forms e ON e.word = c.root AND e.form IS NULL"
)

_TEXT_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
_TWO64 = "18446744073709551616::HUGEINT"


def _times(x: str, factor: int) -> str:
    """A product modulo 2**64, by halves, as 128 bits wouldn't hold it."""
    return f"((({x}) // 4294967296 * {factor}::HUGEINT) % 4294967296 * 4294967296 + ({x}) % 4294967296 * {factor}::HUGEINT) % {_TWO64}"


def sharding(keys: list[int], shards: int) -> str:
    """The ``rows`` law: rows in order, their numbers under a Feistel network of these round keys with cycle walking."""
    first = f"xor(z, z // {1 << 30})"
    second = f"xor(y, y // {1 << 27})"
    third = f"xor(x, x // {1 << 31})"
    return (
        f"WITH RECURSIVE {_STEPS}, d AS (SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size, {_crc(_TEXT_BYTES)} AS text_crc32 FROM documents, crc),"
        " o AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS row_no FROM d),"
        " c AS (SELECT count(*)::HUGEINT AS n, (2 ** greatest(1, (length(bin(greatest(count(*), 2) - 1)) + 1) // 2))::HUGEINT AS half FROM d),"
        f" k AS (SELECT unnest({list(range(len(keys)))}) AS r, unnest([{', '.join(f'{v}::HUGEINT' for v in keys)}]) AS v),"
        " f(row_no, r, a, b) AS (SELECT row_no, 0, row_no::HUGEINT // half, row_no::HUGEINT % half FROM o, c"
        f" UNION ALL SELECT row_no, CASE WHEN r = {len(keys)} THEN 0 ELSE r + 1 END, CASE WHEN r = {len(keys)} THEN a ELSE b END, CASE WHEN r = {len(keys)} THEN b ELSE xor(a, m % half) END FROM ("
        f"SELECT *, {third} AS m FROM (SELECT *, {_times(second, 0x94D049BB133111EB)} AS x FROM (SELECT *, {_times(first, 0xBF58476D1CE4E5B9)} AS y FROM ("
        f"SELECT f.*, half, (b + coalesce(v, 0)) % {_TWO64} AS z FROM f LEFT JOIN k USING (r), c WHERE NOT (r = {len(keys)} AND a * half + b < n))))))"
        f" SELECT doc_id, size, text_crc32, 'rows' AS law, (place % {shards})::INT AS shard, (place // {shards})::BIGINT AS slot, NULL::INT AS grown_shard, row_no"
        f" FROM o JOIN (SELECT row_no, a * half + b AS place FROM f, c WHERE r = {len(keys)} AND a * half + b < n) USING (row_no)"
    )
