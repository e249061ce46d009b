"""SQL texts of the operators that need more than a page of it."""


def crc32_sql(of: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, beside ``crc_table``, whose list is looked up byte by byte."""
    byte = f"list_transform(range(strlen({of})), lambda i: ('0x' || substr(hex(encode({of})), 2 * i + 1, 2))::BIGINT)"
    return (f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda c, b: "
            f"xor(c >> 8, crc_t[xor(c & 255, b) + 1])), 4294967295)")


CRC_TABLE_SQL = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k:
    CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_t)"""


def manifest_sql(levels: int = 8) -> str:
    """Trees of up to 8 ** levels leaves, level by level; a tree of one node stays as it is."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}, '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    ctes = [CRC_TABLE_SQL, f"""d AS (
  SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 3 = 0 THEN {leaf(
      "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other
  FROM documents, crc_table)""", """l0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY lang) AS n FROM d)""", "a0 AS (SELECT lang, i, n, leaf AS d FROM l0)"]

    def tree(name: str, part: str) -> None:
        for k in range(levels):
            ctes.append(f"{name}r{k} AS (SELECT {part}, i // 8 AS r, n, list(d ORDER BY i) AS ds FROM {name}{k} GROUP BY ALL)")
            ctes.append(f"{name}{k + 1} AS (SELECT {part}, r AS i, (n + 7) // 8 AS n, CASE WHEN n = 1 THEN ds[1] "
                        f"ELSE sha256(array_to_string(ds, '')) END AS d FROM {name}r{k})")

    tree("a", "lang")
    ctes.append(f"""t0 AS (
  SELECT 0 AS one, lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n, d
  FROM a{levels})""")
    ctes.append("b0 AS (SELECT one, i, n, d FROM t0)")
    tree("b", "one")
    ctes.append("""f0 AS (
  SELECT l0.doc_id, l0.lang, l0.leaf, l0.i, t0.i AS j, t0.d AS subroot, '' AS proof, coalesce(other, leaf) AS fold
  FROM l0 JOIN t0 ON l0.lang IS NOT DISTINCT FROM t0.lang)""")

    def fold(at: int, name: str, k: int, where: str, idx: str) -> None:
        place = f"(f.{idx} // {8 ** k})"
        left = f"array_to_string(r.ds[:{place} % 8], '')"
        right = f"array_to_string(r.ds[{place} % 8 + 2:], '')"
        ctes.append(f"""f{at + 1} AS (
  SELECT f.* EXCLUDE (proof, fold), CASE WHEN r.n = 1 THEN proof ELSE proof || {left} || {right} END AS proof,
         CASE WHEN r.n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold
  FROM f{at} f JOIN {name}r{k} r ON {where} AND {place} // 8 = r.r)""")

    for k in range(levels):
        fold(k, "a", k, "f.lang IS NOT DISTINCT FROM r.lang", "i")
    for k in range(levels):
        fold(levels + k, "b", k, "r.one = 0", "j")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = b.d AS verified
FROM f{2 * levels} JOIN b{levels} b ON true"""


MANIFEST_SQL = manifest_sql()


RATIO_SQL = r"""
WITH """ + CRC_TABLE_SQL + r""",
d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT k, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT k, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT k, g FROM windows GROUP BY ALL HAVING count(*) > 1),
repeats AS (
  SELECT k, count(DISTINCT word_at) AS n_repeat_words
  FROM (SELECT k, unnest(range(i, i + 3)) AS word_at FROM windows SEMI JOIN twice USING (k, g)) GROUP BY k),
lines AS (
  SELECT k, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k),
base AS (
  SELECT k, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed
  FROM d LEFT JOIN repeats USING (k) LEFT JOIN lines USING (k)),
grams AS (
  SELECT k, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: right(w[i], 3) || ' ' || right(w[i + 1], 3)))) AS g
  FROM d),
hashed AS (SELECT g, """ + crc32_sql("g") + r""" % 16384 AS b FROM (SELECT DISTINCT g FROM grams), crc_table),
counts AS (SELECT k, doc_id, b, count(*) AS n FROM grams JOIN hashed USING (g) GROUP BY ALL),
known AS (
  SELECT doc_id, q, """ + crc32_sql("doc_id::VARCHAR") + r""" % 4 = 3 AS spared
  FROM (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1), crc_table),
raw AS (SELECT b, sum(n) AS r FROM counts GROUP BY b),
target AS (SELECT b, sum(n) AS t FROM counts JOIN known USING (doc_id) WHERE q = 1 AND NOT spared GROUP BY b),
listed AS (
  SELECT b, coalesce(t, 0)::BIGINT AS t, coalesce(r, 0)::BIGINT AS r
  FROM (SELECT unnest(range(16384)) AS b) LEFT JOIN raw USING (b) LEFT JOIN target USING (b)),
weights AS (
  SELECT b, round(ln((t + 4) / ((r * sum(t) OVER ()::BIGINT)::DOUBLE / greatest(sum(r) OVER (), 1)::BIGINT + 4)) * 1000000)::BIGINT AS w
  FROM listed),
scores AS (SELECT k, sum(n * w)::BIGINT / (sum(n)::BIGINT * 1000000) AS score FROM counts JOIN weights USING (b) GROUP BY k),
scored AS (SELECT base.*, coalesce(score, 0.0) AS score FROM base LEFT JOIN scores USING (k)),
bins AS (
  SELECT greatest(-8192, least(8192, floor(score * 1000)))::BIGINT AS bin, count(*) FILTER (WHERE q = 1) AS good,
         count(*) FILTER (WHERE q <> 1) AS bad
  FROM scored JOIN known USING (doc_id) WHERE NOT base_failed AND (q <> 1 OR spared) GROUP BY 1),
cuts AS (
  SELECT (bin + lag(bin) OVER (ORDER BY bin) + 1) / 2000 AS cut,
         (sum(bad) OVER b * sum(good) OVER () - sum(good) OVER b * sum(bad) OVER ()) AS merit
  FROM bins WINDOW b AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT cut FROM cuts WHERE merit > 0 ORDER BY merit DESC, cut LIMIT 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(score >= (SELECT cut FROM best), true) AS kept, score
FROM scored"""


NEGATIVES_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, s.other_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INT AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
