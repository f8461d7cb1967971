"""Registered queries of this package next to the SQL that restates them, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bagspark.llm.chat_format import CONTROL, digests, segments
from bagspark.llm.decontamination import contaminated
from bagspark.llm.hard_negatives import hard_negatives
from bagspark.llm.html_extraction import main_text
from bagspark.llm.jaccard_join import jaccard_components
from bagspark.llm.language_id import predict, train
from bagspark.llm.lm_scoring import lm_scores
from bagspark.llm.mixing import training_passes
from bagspark.llm.quality_classifier import held_out, quality_scores
from bagspark.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from bagspark.llm.spelling import spelling_variants
from bagspark.llm.substring_dedup import substring_dedup
from bagspark.llm.warc import read_archive, write_archive
from bagspark.session import scratch_path

QUALITY_FROM = 0.3

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS_SQL = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"


@query("op1_substring_dedup", f"""
WITH w AS (SELECT doc_id, {WORDS_SQL} AS l FROM documents),
placed AS (SELECT doc_id, l, unnest(range(1, len(l) - 11)) AS i FROM w),
runs AS (SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS run FROM placed),
earliest AS (SELECT run, min(doc_id) AS m FROM runs GROUP BY run),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM runs JOIN earliest USING (run) WHERE m < doc_id),
every AS (SELECT doc_id, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""")
def op1(spark, sf_dir):
    out = substring_dedup(table(spark, sf_dir, "documents"), length=13)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


@query("op3_warc_archive", """
WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
held AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS holder FROM p)
SELECT page_id, payload_bytes, sha1(t) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM held""")
def op3(spark, sf_dir):
    path = scratch_path(spark, "warc")
    write_archive(table(spark, sf_dir, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUALITY_RULES_SQL = f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS_SQL} AS l,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
placed AS (SELECT doc_id, l, unnest(range(1, len(l) - 6)) AS i FROM w),
runs AS (SELECT doc_id, i, array_to_string(l[i:i + 7], ' ') AS run FROM placed),
again AS (SELECT doc_id, run FROM runs GROUP BY doc_id, run HAVING count(*) > 1),
inside AS (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM runs JOIN again USING (doc_id, run)),
repeats AS (SELECT doc_id, count(*) AS n FROM inside GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(length(array_to_string(l, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(list_filter(l, lambda x: x IN ({", ".join(f"'{s}'" for s in STOP_WORDS)}))) AS BIGINT) AS n_stop_words, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '^ *[-*•]'))) AS BIGINT) AS n_bullet_lines,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS BIGINT) AS n_ellipsis_lines
  FROM w LEFT JOIN repeats USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {" AND ".join(
    f"(n_words < {r.from_words} OR 100 * {r.part} BETWEEN {r.low} * {r.whole} AND {r.high} * {r.whole})" for r in RULES)} AS kept
FROM f"""


@query("op4_quality_rules", QUALITY_RULES_SQL)
def op4(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"))


def chat_escape_sql(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for s in CONTROL:
        out = f"replace({out}, '{s}', '{s[0]}\\{s[1:]}')"
    return out


@query("op7_chat_format", f"""
WITH c AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, '<|im_start|>' || role || chr(10) || {chat_escape_sql("text")} || '<|im_end|>' || chr(10) AS segment FROM c),
r AS (SELECT *, sum(length(segment)) OVER (PARTITION BY conv_id ORDER BY turn, segment ROWS UNBOUNDED PRECEDING) AS reach FROM s),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, segment)) AS turns_sha256,
             coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, segment), '') AS lost,
             CAST(sum(length(segment)) AS BIGINT) AS formatted_chars, count(CASE WHEN role = 'assistant' THEN 1 END) AS n_examples,
             CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN reach END), 0) AS BIGINT) AS example_chars
      FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(length(lost) AS BIGINT) AS loss_chars, sha256(lost) AS loss_sha256, formatted_chars, n_examples, example_chars FROM g""")
def op7(spark, sf_dir):
    given = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digests(segments(given.unionByName(planted)))


@query("op8_mixing", f"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS_SQL}) AS BIGINT) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
o AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS weight FROM s),
l AS (SELECT *, ((SELECT sum(source_size) FROM o) - coalesce(sum(3 * source_size) OVER before, 0))
                / ((SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER before, 0)) AS level
      FROM o WINDOW before AS (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source AS s, source_size, least(CAST(3 * source_size AS DOUBLE), weight * (
        SELECT level FROM l WHERE level * weight <= 3 * source_size ORDER BY 3 * source_size / weight, source NULLS LAST LIMIT 1)) AS target FROM l),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
       CAST(coalesce(list_sum([greatest(0, least(size, floor(target + 0.5) - start - source_size * k)) FOR k IN [0, 1, 2]]), 0) AS BIGINT) AS taken
FROM p JOIN t ON source IS NOT DISTINCT FROM s""")
def op8(spark, sf_dir):
    return training_passes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op5_quality_classifier")
def op5(spark, sf_dir):
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scores.withColumn("predicted", (F.col("score") >= QUALITY_FROM).cast("int"))


@query("op9_decontamination")
def op9(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_language_id")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = held_out(folds=4, fold=2)
    model = train(docs.where(~held))
    return predict(docs, model).select("doc_id", held_out(folds=4, fold=2).alias("held_out"), "lang_pred", "score", "rejected")


@query("op2_jaccard_join", f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS l FROM documents),
g AS (SELECT doc_id, unnest([array_to_string(l[i:i + 4], ' ') FOR i IN range(1, greatest(len(l) - 4, 1) + 1)]) AS shingle FROM w WHERE len(l) > 0),
s AS (SELECT DISTINCT doc_id, shingle FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents LEFT JOIN n USING (doc_id) JOIN least ON a = doc_id""")
def op2(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


LOWER_WORDS_SQL = WORDS_SQL.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")


@query("op6_lm_scoring")
def op6(spark, sf_dir):
    held = held_out(folds=10, fold=0)
    scores = lm_scores(table(spark, sf_dir, "documents"), ~held, order=3)
    return scores.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_hard_negatives", """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
       other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10""")
def op11(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), anchor_every=100, positives=5, negatives=10, low=30, high=90, label=moved)


@query("op12_spelling_variants", r"""
WITH RECURSIVE byte(k, v, step) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT k, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM byte WHERE step < 8),
crc AS (SELECT list(v ORDER BY k) AS t FROM byte WHERE step = 8),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
each AS (SELECT d, run, count(*) AS times FROM runs WHERE length(run) >= 5 GROUP BY ALL),
coded AS (SELECT run, times, list_transform(string_split(d || ':' || run, ''), lambda c: ord(c)) AS points FROM each),
bytes AS (SELECT run, times, flatten(list_transform(points, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 + p // 64, 128 + p % 64] END)) AS b FROM coded),
hashed AS (SELECT run, times, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(b AS BIGINT[])),
             lambda a, x: xor(a >> 8, t[1 + (xor(a, x) & 255)]))) AS h FROM bytes, crc),
seen AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM seen WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3),
open_ AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM open_),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b USING (i, rest) WHERE a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT less.word, rest, w.n FROM less JOIN words w ON w.word = rest
  UNION SELECT rest, less.word, less.n FROM less JOIN words w ON w.word = rest),
near AS (SELECT a AS word, count(DISTINCT b) AS n_near, first(b ORDER BY n DESC, b) AS best, max(n) AS best_n FROM pairs GROUP BY a),
known AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * n THEN best END AS form, CASE WHEN best_n >= 2 * n THEN best_n END AS form_n
          FROM words LEFT JOIN near USING (word)),
walk AS (SELECT word, word AS reached, 0 AS hops FROM known UNION ALL SELECT walk.word, known.form, hops + 1 FROM walk JOIN known ON known.word = walk.reached WHERE known.form IS NOT NULL)
SELECT word, form, (SELECT arg_max(reached, hops) FROM walk WHERE walk.word = known.word) AS root, n, n_near, form_n FROM known""")
def op12(spark, sf_dir):
    return spelling_variants(table(spark, sf_dir, "documents"), min_chars=5, min_count=3, ratio=2, drop_every=97)


# wrappers cannot be put in SQL; this reads what they find on pages whose article is the one ``article`` element, as on all given pages
@query("op13_html_extraction", r"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?b>', '', 'g'), '<[a-z/][^>]*>', ' ', 'g') AS t FROM a),
c AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'),
             '&gt;?', '>', 'g'), '&#(x27|39);', chr(39), 'g'), '&amp;?', '&', 'g') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\p{Z}\x{0B}\x{1C}-\x{1F}\x{85}]+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d""")
def op13(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
