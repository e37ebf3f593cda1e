"""Queries over the provided tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from ..session import table
from . import (
    bpe, chat, decontaminate, jaccard, language, license_scan, line_dedup, neighbours, pii, prefix_trie, quality, spelling, toxicity,
)

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_license_scan")
def license_query(spark, sf):
    found = license_scan.scan(table(spark, sf, "documents"))
    starts = F.flatten("places")
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"), F.col("phrase_labels").alias("base_labels"), "labels", "score")


@query("op2_language_id")
def language_query(spark, sf):
    return language.identify(table(spark, sf, "documents"))


LINE_SQL = r"""
WITH split AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS MATERIALIZED (
  SELECT rid, doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split, unnest(range(1, len(lines) + 1)) AS u(pos)),
frequent AS (
  SELECT key, max(doc_id) AS owner FROM line WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT l.rid, l.doc_id, l.pos, l.line, coalesce(l.doc_id <> f.owner, false) AS dropped
  FROM line l LEFT JOIN frequent f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY rid, doc_id
"""


@query("op3_line_dedup", LINE_SQL)
def line_query(spark, sf):
    return line_dedup.deduplicate_lines(table(spark, sf, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op4_chat_format")
def chat_query(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digests(chat.format_chat(turns.unionByName(more)))


@query("op5_toxicity")
def toxicity_query(spark, sf):
    return toxicity.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op6_decontamination")
def decontamination_query(spark, sf):
    return decontaminate.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op7_bpe")
def bpe_query(spark, sf):
    return bpe.round_trip(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUALITY_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (
  SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
again AS (
  SELECT rid, i FROM (SELECT rid, i, words[i:i + 4] AS five FROM w, unnest(range(1, len(words) - 3)) AS u(i))
  QUALIFY count(*) OVER (PARTITION BY rid, five) > 1),
covered AS (
  SELECT rid, sum(n) AS n FROM (
    SELECT rid, least(5, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5)) AS n FROM again) GROUP BY rid),
line AS MATERIALIZED (
  SELECT rid, doc_id, source, len(lw) AS n, translate(array_to_string(lw, ' '),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT rid, doc_id, source, list_filter(string_split_regex(l, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS lw
        FROM w, unnest(lines) AS u(l))),
host AS (SELECT source, count(*) AS docs FROM d GROUP BY source),
frequent AS (
  SELECT f.source, f.key FROM (SELECT source, key, count(DISTINCT rid) AS n FROM line GROUP BY source, key) f
  JOIN host h ON h.source IS NOT DISTINCT FROM f.source WHERE f.n > 10 AND (f.n > CAST(0.01 AS DOUBLE) * docs OR f.n > 1000)),
lost AS (
  SELECT l.rid, sum(l.n) AS n FROM line l JOIN frequent f ON f.key = l.key AND f.source IS NOT DISTINCT FROM l.source
  GROUP BY l.rid),
base AS (
  SELECT w.rid, w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered c USING (rid)),
judged AS (
  SELECT base.*, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_lost, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM base LEFT JOIN lost USING (rid))
SELECT * EXCLUDE (rid), NOT base_failed AND n_words - n_lost >= 10 AND n_words - n_lost >= CAST(0.3 AS DOUBLE) * n_words AS kept
FROM judged
"""


@query("op8_quality_rules", QUALITY_SQL)
def quality_query(spark, sf):
    return quality.quality_rules(table(spark, sf, "documents"))


@query("op9_pii")
def pii_query(spark, sf):
    return pii.find(table(spark, sf, "documents"))


JACCARD_SQL = r"""
WITH RECURSIVE word AS (
  SELECT CAST(doc_id AS BIGINT) AS id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
doc AS MATERIALIZED (
  SELECT id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS grams FROM word),
sets AS MATERIALIZED (
  SELECT grams, min(id) AS rep, count(*) AS weight, len(grams) AS size FROM doc WHERE len(grams) > 0 GROUP BY grams),
gram AS MATERIALIZED (SELECT rep, size, unnest(grams) AS gram FROM sets),
often AS (SELECT gram, count(*) AS n FROM gram GROUP BY gram),
-- similar sets share one of their rarest grams
rare AS MATERIALIZED (
  SELECT rep, size, gram FROM gram JOIN often USING (gram)
  QUALIFY row_number() OVER (PARTITION BY rep ORDER BY n, gram) <= size - (4 * size + 4) // 5 + 1),
pair AS MATERIALIZED (
  SELECT DISTINCT a.rep AS a, b.rep AS b FROM rare a JOIN rare b ON a.gram = b.gram AND a.rep < b.rep
    AND 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)),
common AS (
  SELECT a, b, len(list_intersect(x.grams, y.grams)) AS shared, x.size + y.size AS total
  FROM pair JOIN sets x ON x.rep = a JOIN sets y ON y.rep = b),
near AS MATERIALIZED (SELECT a, b FROM common WHERE 5 * shared >= 4 * (total - shared)),
edge AS MATERIALIZED (SELECT a, b FROM near UNION ALL SELECT b, a FROM near),
reach(id, root) AS (
  SELECT rep, rep FROM sets UNION SELECT e.b, r.root FROM reach r JOIN edge e ON e.a = r.id WHERE e.b > r.root),
class AS (SELECT id AS rep, min(root) AS root FROM reach GROUP BY id),
link AS (SELECT a AS rep, sum(weight) AS n FROM edge JOIN sets ON rep = b GROUP BY a)
SELECT doc.id AS doc_id, coalesce(root, doc.id) AS class_id, CAST(coalesce(weight - 1, 0) + coalesce(n, 0) AS BIGINT) AS n_links
FROM doc LEFT JOIN sets USING (grams) LEFT JOIN class USING (rep) LEFT JOIN link USING (rep)
"""


@query("op10_jaccard_join", JACCARD_SQL)
def jaccard_query(spark, sf):
    return jaccard.similarity_classes(table(spark, sf, "documents"))


@query("op11_nearest_neighbours")
def neighbour_query(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


# the register of a byte-wise CRC-32, as unsigned numbers
CRC_TABLE = """
crc_table AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, i) ORDER BY i) AS steps
  FROM unnest(range(256)) AS u(i))"""


def crc_sql(codes: str) -> str:
    """CRC-32 of a list of bytes."""
    return f"xor(list_reduce({codes}, lambda v, b: xor(v >> 8, steps[xor(v, b) % 256 + 1]), 4294967295), 4294967295)"


TRIE_SQL = f"""
WITH {CRC_TABLE},
turns AS (
  SELECT CAST(conv_id AS BIGINT) AS c, turn, coalesce(text, '') AS text,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS said
  FROM conversations WHERE conv_id IS NOT NULL),
own AS MATERIALIZED (
  SELECT c, list({{'said': said, 'chars': length(text)}} ORDER BY turn NULLS FIRST, said) AS own FROM turns GROUP BY c),
plan AS (
  SELECT c, own, c - c % 100 AS g, {crc_sql("list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 6 AS h
  FROM own, crc_table),
whole AS MATERIALIZED (
  SELECT p.c, coalesce(list_slice(d.own, 1, h), []) || coalesce(list_slice(p.own, h + 1, len(p.own)), []) AS path
  FROM plan p LEFT JOIN own d ON d.c = p.g),
step AS MATERIALIZED (
  SELECT c, d, array_to_string(list_transform(list_slice(path, 1, d), lambda x: x.said), ' ') AS key,
    array_to_string(list_transform(list_slice(path, 1, d - 1), lambda x: x.said), ' ') AS above,
    CASE WHEN d > 0 THEN path[d].chars ELSE 0 END AS chars, d = len(path) AS ends
  FROM whole, unnest(range(0, len(path) + 1)) AS u(d)),
node AS MATERIALIZED (
  SELECT d, key, min(above) AS above, min(c) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM step GROUP BY d, key),
child AS (SELECT d - 1 AS d, above AS key, count(*) AS n FROM node WHERE d > 0 GROUP BY d, above),
figure AS MATERIALIZED (
  SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child USING (d, key)),
under AS (
  SELECT k AS d, array_to_string(list_slice(string_split(f.key, ' '), 1, k), ' ') AS key,
    CAST(f.n_children = 0 AS BIGINT) AS leaf, (f.n_convs - 1) * f.chars AS saved
  FROM figure f, unnest(range(0, f.d + 1)) AS u(k)),
tree AS (SELECT d, key, sum(leaf) AS leaves, sum(saved) AS saved FROM under GROUP BY d, key)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(t.leaves AS BIGINT) AS n_leaves,
  CAST(t.saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM figure f JOIN tree t ON t.d = f.d AND t.key = f.key LEFT JOIN figure p ON f.d > 0 AND p.d = f.d - 1 AND p.key = f.above
"""


@query("op12_prefix_trie", TRIE_SQL)
def trie_query(spark, sf):
    return prefix_trie.prefix_trie(table(spark, sf, "conversations"))


BYTES = """flatten(list_transform(string_split(whole, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
      ELSE [CAST(192 + (unicode(x) >> 6) AS BIGINT), CAST(128 + unicode(x) % 64 AS BIGINT)] END))"""

SPELLING_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
run AS MATERIALIZED (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS whole, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\u00C0-\u00FF]+')) AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, {crc_sql(BYTES)} AS h FROM run, crc_table),
made AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2)
    ELSE run END AS word, n FROM hashed),
vocabulary AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
less AS MATERIALIZED (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
  FROM vocabulary, unnest(range(1, length(word) + 1)) AS u(i)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN vocabulary b ON b.word = a.rest
  UNION SELECT b.word, a.word, a.n FROM less a JOIN vocabulary b ON b.word = a.rest),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS form, max(n) AS form_n FROM near GROUP BY word),
judged AS MATERIALIZED (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * v.n THEN form END AS form,
    CASE WHEN form_n >= 10 * v.n THEN form_n END AS form_n FROM vocabulary v LEFT JOIN best USING (word)),
chain(word, reached) AS (
  SELECT word, word FROM judged UNION ALL
  SELECT c.word, j.form FROM chain c JOIN judged j ON j.word = c.reached WHERE j.form IS NOT NULL),
ends AS (SELECT c.word, c.reached AS root FROM chain c JOIN judged j ON j.word = c.reached WHERE j.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN ends USING (word)
"""


@query("op13_spelling_variants", SPELLING_SQL)
def spelling_query(spark, sf):
    return spelling.variants(table(spark, sf, "documents"))
