"""The corpus operators bound to the driver's tables: one query an operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.minhash import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.linededup import dedup_lines

    out = dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.substrings import repeat_report

    return repeat_report(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.toxicity import toxicity_report

    return toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.packing import pack

    return pack(_table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.langid import identify, train_text_model

    return identify(_table(spark, sf_dir, "pages"), train_text_model(_table(spark, sf_dir, "documents")))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.pieces import piece_report

    return piece_report(_table(spark, sf_dir, "documents"))


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.topk import exact_top_k, integer_vectors

    return exact_top_k(integer_vectors(_table(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0, k=10)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.pii import span_report

    return span_report(_table(spark, sf_dir, "documents"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.media import text_media_report

    return text_media_report(_table(spark, sf_dir, "documents"))


def op11_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.lm import remainder, score_texts

    out = score_texts(_table(spark, sf_dir, "documents"), remainder("doc_id", 5) == 1)
    return out.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.divergence import source_divergence

    return source_divergence(_table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnwork.llm.repair import repair_report

    return repair_report(_table(spark, sf_dir, "conversations"))


QUERIES = {"op1_minhash": op1_minhash, "op2_line_dedup": op2_line_dedup, "op3_suffix_array": op3_suffix_array, "op4_packing": op4_packing, "op5_toxicity": op5_toxicity, "op6_language_id": op6_language_id, "op7_sentencepiece": op7_sentencepiece, "op8_exact_topk": op8_exact_topk, "op9_pii": op9_pii, "op10_media": op10_media, "op11_lm_scoring": op11_lm_scoring, "op12_source_divergence": op12_source_divergence, "op13_conversation_repair": op13_conversation_repair}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op2_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, n, line, lower_ascii AS k FROM (
    SELECT doc_id, n, line,
           translate(trim(line, e' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents))
), refs AS (
  SELECT k, max(doc_id) AS last_doc FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT l.doc_id, l.n, l.line, coalesce(l.doc_id <> r.last_doc, false) AS gone FROM lines l LEFT JOIN refs r ON l.k = r.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

ORACLE_SQL["op8_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id % 100 = 0 AND d.vec_id <> q.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# All pairs of documents that share a shingle, and the smallest document reachable over links.
ORACLE_SQL["op1_minhash"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s
  FROM words
), prints AS (
  SELECT doc_id, len(s)::BIGINT AS n, CASE WHEN len(s) > 0 THEN md5(array_to_string(list_sort(s), chr(10))) END AS fp FROM sets
), reps AS (
  SELECT fp, min(doc_id) AS rep, any_value(n) AS n FROM prints WHERE fp IS NOT NULL GROUP BY fp
), grams AS (
  SELECT rep, n, unnest(s) AS g FROM reps JOIN sets ON rep = doc_id
), met AS (
  SELECT a.rep AS a, b.rep AS b, a.n AS na, b.n AS nb, count(*) AS common FROM grams a JOIN grams b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY ALL
), links AS (
  SELECT a, b FROM met WHERE 100 * common >= 75 * (na + nb - common)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (
  SELECT rep AS node, rep AS seen FROM reps UNION SELECT w.b, r.seen FROM reach r JOIN ways w ON w.a = r.node
), roots AS (
  SELECT node, min(seen) AS root FROM reach GROUP BY node
)
SELECT p.doc_id, p.n AS n_shingles, coalesce(root, p.doc_id) AS component_id, p.doc_id = coalesce(root, p.doc_id) AS kept
FROM prints p LEFT JOIN reps ON p.fp = reps.fp LEFT JOIN roots ON reps.rep = roots.node
"""

# Every string of 100 bytes, numbered by where it starts; bytes are pairs of hexadecimal digits.
ORACLE_SQL["op3_suffix_array"] = r"""
WITH t AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT doc_id, n, substr(h, 2 * n + 1, 200) AS s
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS n FROM t WHERE length(h) >= 200)
), later AS (
  SELECT doc_id, n FROM (SELECT doc_id, n, row_number() OVER (PARTITION BY s ORDER BY doc_id, n) AS turn FROM strings) WHERE turn > 1
), marked AS (
  SELECT doc_id, n, coalesce(n > lag(n) OVER (PARTITION BY doc_id ORDER BY n) + 100, true)::INT AS opens FROM later
), grouped AS (
  SELECT doc_id, n, sum(opens) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM marked
), runs AS (
  SELECT doc_id, min(n) AS a, max(n) + 100 AS b FROM grouped GROUP BY doc_id, run
), cuts AS (
  SELECT r.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0) + 1, 2 * (a - coalesce(lag(b) OVER (PARTITION BY r.doc_id ORDER BY a), 0))) AS piece
  FROM runs r JOIN t USING (doc_id)
), gone AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS head, max(b) AS tail FROM cuts GROUP BY doc_id
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM t LEFT JOIN gone USING (doc_id)
"""

# CRC-32 of an ASCII string, byte by byte over the usual table.
_CRC = """crc_table AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t
)"""


def _crc(text: str) -> str:
    """SQL of the CRC-32 of ``text``, where ``crc_table`` is in reach."""
    codes = f"list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


# The lattice as a plain recursion over the rows: of each state its best (cost, audit), all edits tried.
ORACLE_SQL["op13_conversation_repair"] = rf"""
WITH RECURSIVE {_CRC}, given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS kind FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) FROM given WHERE kind <> 0)
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged
), marked AS (
  SELECT *, left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS before,
         CASE WHEN trim(text, e' 	

') = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
              WHEN right(trim(text, e' 	

'), 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM numbered
), costs AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000 WHEN fault = 'truncated' THEN 1 ELSE 0 END AS stay,
         CASE WHEN initial = 's' THEN 0 ELSE 1000000 END AS no_s, CASE WHEN initial = 'u' THEN 0 ELSE 1000000 END AS no_u, CASE WHEN initial = 'a' THEN 0 ELSE 1000000 END AS no_a FROM marked
), steps AS (
  SELECT conv_id, 0::BIGINT AS n, {{c: 0, a: ''}} AS b, {{c: 1000000, a: ''}} AS s, {{c: 2, a: 'I'}} AS u, {{c: 4, a: 'II'}} AS a FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, b, s, u, list_min([a, {{c: u.c + 2, a: u.a || 'I'}}]) FROM (
    SELECT conv_id, n, b, s, a, list_min([u, {{c: b.c + 2, a: b.a || 'I'}}, {{c: s.c + 2, a: s.a || 'I'}}, {{c: a.c + 2, a: a.a || 'I'}}]) AS u FROM (
      SELECT d.conv_id, r.n, {{c: b.c + 3, a: b.a || 'D'}} AS b, list_min([{{c: s.c + 3, a: s.a || 'D'}}, {{c: b.c + stay + no_s, a: b.a || 'K'}}]) AS s,
             list_min([{{c: u.c + 3, a: u.a || 'D'}}, {{c: b.c + 2 + stay, a: b.a || 'R'}}, {{c: s.c + 2 + stay, a: s.a || 'R'}}, {{c: a.c + 2 + stay, a: a.a || 'R'}},
                       {{c: b.c + stay + no_u, a: b.a || 'K'}}, {{c: s.c + stay + no_u, a: s.a || 'K'}}, {{c: a.c + stay + no_u, a: a.a || 'K'}}]) AS u,
             list_min([{{c: a.c + 3, a: a.a || 'D'}}, {{c: u.c + 2 + stay, a: u.a || 'R'}}, {{c: u.c + stay + no_a, a: u.a || 'K'}}]) AS a
      FROM steps d JOIN costs r ON r.conv_id = d.conv_id AND r.n = d.n + 1
    )
  )
), best AS (
  SELECT conv_id, list_min([b, a]) AS e FROM steps QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1
), letters AS (
  SELECT conv_id, j, e.a[j] AS l, len(regexp_replace(e.a[1:j], 'I', '', 'g')) AS n FROM (SELECT *, unnest(range(1, len(e.a) + 1)) AS j FROM best)
), lines AS (
  SELECT l.conv_id, j, l, initial, role, text, row_number() OVER (PARTITION BY l.conv_id ORDER BY j) AS k
  FROM letters l LEFT JOIN marked m ON m.conv_id = l.conv_id AND m.n = l.n AND l.l <> 'I' WHERE l <> 'D'
), turns AS (
  SELECT *, (k - max(CASE WHEN k = 1 AND l = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id)) % 2 AS odd FROM lines
), repaired AS (
  SELECT conv_id, string_agg(CASE WHEN l = 'K' THEN role WHEN odd = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS t FROM turns GROUP BY conv_id
), stats AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
         count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, e.c::BIGINT AS cost, e.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM best b LEFT JOIN stats USING (conv_id) LEFT JOIN repaired USING (conv_id)
"""

# Every kept term of a language against every group and every two groups, without shortcuts.
ORACLE_SQL["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), occurrences AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT r) >= 3
), counts AS (
  SELECT o.lang, o.source, o.term, count(*) AS n FROM occurrences o JOIN kept k ON o.lang = k.lang AND o.term = k.term GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce((SELECT sum(n) FROM counts c WHERE c.lang = g.lang AND c.source = g.source), 0)::HUGEINT AS total,
         (SELECT count(*) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS v, (SELECT sum(n) FROM kept k WHERE k.lang = g.lang)::HUGEINT AS lang_total
  FROM (SELECT DISTINCT lang, source FROM d) g
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (total + v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 1)) // (lang_total + v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""

# Two words at a time, from plain counts; every document has one beginning and one end token.
ORACLE_SQL["op11_lm_scoring"] = rf"""
WITH {_CRC}, d AS (
  SELECT doc_id, {_crc("coalesce(doc_id::VARCHAR, '')")} % 5 = 1 AS held_out,
         list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0b\x0c\r]+'), lambda w: w <> '') AS w
  FROM documents, crc_table
), tokens AS (
  SELECT doc_id, held_out, unnest(list_append(w, '')) AS w, unnest(list_prepend(' ', w)) AS h FROM d
), words AS (
  SELECT w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY w
), histories AS (
  SELECT h, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h
), pairs AS (
  SELECT h, w, count(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w
), sizes AS (
  SELECT sum(c) AS n, count(*) AS v FROM words
), based AS (
  SELECT t.*, coalesce(words.c, 0) AS c, (coalesce(words.c, 0) + 0.5) / (n + 0.5 * (v + 1)) AS p FROM tokens t CROSS JOIN sizes LEFT JOIN words USING (w)
), scored AS (
  SELECT b.*, CASE WHEN o.c IS NULL THEN p ELSE (coalesce(x.c, 0) + 128 * p) / (o.c + 128) END AS smooth
  FROM based b LEFT JOIN histories o USING (h) LEFT JOIN pairs x ON x.h = b.h AND x.w = b.w
)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, (SELECT n FROM sizes)::BIGINT AS train_tokens,
       round(fsum(log10(p)), 6) AS base_score, round(fsum(log10(smooth)), 6) AS score
FROM scored GROUP BY doc_id, held_out
"""
