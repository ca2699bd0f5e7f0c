"""Queries over the whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, collocations, decontamination, ecoc, html_crf, kneser_ney, merkle, mixing, nnpu, simhash_ball, surrogates, url_lm, weak_supervision
from .common import fold_remainder, table


def op1_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = weak_supervision.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 10).alias("posterior"))


def op3_toxicity_nnpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    remainder = fold_remainder(F.col("doc_id"), 5)
    model = nnpu.train(docs.where(remainder != 0), labels.where(remainder != 0))
    scored = nnpu.score(docs, model)
    return scored.select("doc_id", (remainder == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"), count="n_mentions").select("doc_id", "text", "n_chars", "n_mentions")


def op5_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lm.judge(table(spark, sf_dir, "pages"))


def op6_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op7_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_ball.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("keeper.id").alias("component_id"))


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = kneser_ney.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id", "lang"])
    return judged.select("row.doc_id", "row.lang", "perplexity", "threshold", "kept")


def op9_language_ecoc(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    remainder = fold_remainder(F.col("doc_id"), 3)
    predicted = ecoc.predict(docs, ecoc.train(docs.where(remainder != 1)))
    return predicted.select("doc_id", (remainder == 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op10_systematic_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_copies(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return planned.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"])
    return made.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = {"text": F.translate("text", string.ascii_uppercase, string.ascii_lowercase)}
    tampered = merkle.leaf(*[lowered.get(c, F.col(c)) for c in columns])
    docs = table(spark, sf_dir, "documents").withColumn("tampered", F.when(fold_remainder(F.col("doc_id"), 3) == 0, tampered))
    made = merkle.manifest(docs, columns, group="lang", order="doc_id", keep=["doc_id", "tampered"])
    judged = made.select("row.doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"), merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return judged.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE
docs AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
read AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs),
windows AS (
  SELECT row, i, array_to_string(words[i : i + 7], ' ') AS part
  FROM (SELECT row, words, unnest(range(1, len(words) - 6)) AS i FROM read)),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, part) > 1),
spans AS (SELECT row, least(8, coalesce(lead(i) OVER (PARTITION BY row ORDER BY i) - i, 8)) AS n FROM twice),
repeats AS (SELECT row, CAST(sum(n) AS BIGINT) AS n FROM spans GROUP BY row),
counted AS (
  SELECT read.row, doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(text) - length(regexp_replace(text, '[^\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         coalesce(repeats.n, 0) AS n_repeat_words,
         len(lines) AS n_lines,
         len(list_filter(words, lambda w: NOT regexp_matches(w, '[\p{L}\p{N}]'))) AS n_bare_words,
         length(text) - length(replace(text, '!', '')) AS n_exclaim,
         length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper,
         length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) AS n_letters
  FROM read LEFT JOIN repeats ON read.row = repeats.row),
ratios AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols / nullif(n_words, 0) AS r1, n_bare_words / nullif(n_words, 0) AS r2, n_repeat_words / nullif(n_words, 0) AS r3,
         n_dup_lines / nullif(n_lines, 0) AS r4, n_exclaim / nullif(n_words, 0) AS r5, n_upper / nullif(n_letters, 0) AS r6,
         n_letters / nullif(word_chars, 0) AS r7, word_chars / nullif(n_words, 0) AS r8
  FROM counted),
voted AS ( -- places: of each rule, the one of its vote -1, 0 or 1 among 24
  SELECT *, [
      CASE WHEN r1 < 0.1 THEN 3 WHEN r1 > 0.3 THEN 1 ELSE 2 END,
      CASE WHEN r2 < 0.05 THEN 6 WHEN r2 > 0.2 THEN 4 ELSE 5 END,
      CASE WHEN r3 < 0.05 THEN 9 WHEN r3 > 0.2 THEN 7 ELSE 8 END,
      CASE WHEN r4 < 0.1 THEN 12 WHEN r4 > 0.3 THEN 10 ELSE 11 END,
      CASE WHEN r5 < 0.05 THEN 15 WHEN r5 > 0.2 THEN 13 ELSE 14 END,
      CASE WHEN r6 < 0.15 THEN 18 WHEN r6 > 0.4 THEN 16 ELSE 17 END,
      CASE WHEN r7 > 0.85 THEN 21 WHEN r7 < 0.7 THEN 19 ELSE 20 END,
      CASE WHEN r8 BETWEEN 3 AND 9 THEN 24 WHEN r8 < 2 OR r8 > 14 THEN 22 ELSE 23 END] AS places
  FROM ratios),
patterns AS (SELECT places, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY places),
counts AS (SELECT list({'places': places, 'n': n} ORDER BY places) AS held, sum(n) AS total FROM patterns),
start AS (
  SELECT list_transform(range(24), lambda k: CAST([0.005, 0.045, 0.95][k % 3 + 1] AS DOUBLE)) AS good,
         list_transform(range(24), lambda k: CAST([0.25, 0.15, 0.60][k % 3 + 1] AS DOUBLE)) AS bad),
fitted AS (
  SELECT 0 AS round, false AS done, CAST(0.8 AS DOUBLE) AS prior, good, bad FROM start
  UNION ALL
  SELECT round + 1, abs(prior - least(0.99, greatest(0.01, sure / total))) < 1e-9, least(0.99, greatest(0.01, sure / total)),
         list_transform(range(1, 25), lambda m:
           (total / 50 * good0[m] + list_sum(list_transform(list_zip(held, p), lambda x: CASE WHEN list_contains(x[1]['places'], m) THEN x[1]['n'] * x[2] ELSE 0 END))) / (total / 50 + sure)),
         list_transform(range(1, 25), lambda m:
           (total / 50 * bad0[m] + list_sum(list_transform(list_zip(held, p), lambda x: CASE WHEN list_contains(x[1]['places'], m) THEN x[1]['n'] * (1 - x[2]) ELSE 0 END))) / (total / 50 + total - sure))
  FROM (SELECT *, list_sum(list_transform(list_zip(held, p), lambda x: x[1]['n'] * x[2])) AS sure
        FROM (SELECT fitted.*, held, total, start.good AS good0, start.bad AS bad0,
                     list_transform(held, lambda x: 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(x['places'], lambda m: ln(fitted.good[m] / fitted.bad[m]))))))) AS p
              FROM fitted, counts, start WHERE NOT done AND round < 100))),
model AS (SELECT * FROM fitted ORDER BY round DESC LIMIT 1),
judged AS (
  SELECT voted.*, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(places, lambda m: ln(good[m] / bad[m])))))) AS posterior
  FROM voted, model)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND posterior >= 0.5 AS kept, round(posterior, 10) AS posterior
FROM judged
"""

OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
classed AS (
  SELECT *, length(bin(size)) * 8 + CASE substr(rpad(bin(size), 3, '0'), 1, 3)
           WHEN '000' THEN 0 WHEN '100' THEN 4 WHEN '101' THEN 5 WHEN '110' THEN 6 ELSE 7 END AS class,
         CAST('0x' || substr(md5(name || '|' || size), 1, 8) AS BIGINT) % 64 AS bucket
  FROM base),
sources AS (SELECT key, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY key),
weighted AS (
  SELECT *, CASE (row_number() OVER (ORDER BY key) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight,
         2 * source_size AS cap FROM sources),
ranked AS (SELECT *, cap / weight AS ratio FROM weighted),
levels AS (
  SELECT *, row_number() OVER (ORDER BY ratio, key) AS rank,
         (CAST(1.5 AS DOUBLE) * (SELECT sum(source_size) FROM sources)
          - coalesce(sum(cap) OVER (ORDER BY ratio, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY ratio, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ranked),
chosen AS (SELECT level FROM levels WHERE level <= ratio ORDER BY rank LIMIT 1),
targets AS (
  SELECT key, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT level FROM chosen) * weight, CAST(cap AS DOUBLE))) AS target,
         CAST('0x' || substr(md5('mix-1|' || key), 1, 5) AS BIGINT) / 1048576 AS offset_
  FROM levels),
placed AS (
  SELECT c.*, t.source_size, t.target, t.offset_, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY key ORDER BY class, bucket, size, name) AS position
  FROM classed c JOIN targets t USING (key))
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(position * rate + offset_) - floor((position - 1) * rate + offset_)) AS BIGINT) AS taken
FROM placed
"""

OP12_SQL = r"""
WITH RECURSIVE
docs AS (
  SELECT *, CASE WHEN lang IS NULL THEN '0' ELSE '1' || lang END AS grp, coalesce(CAST(doc_id AS VARCHAR), '') AS name,
         '' || coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents),
hashed AS (
  SELECT grp, doc_id, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) AS lowered,
         xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(list_filter(string_split(name, ''), lambda c: c <> ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda crc, b: list_reduce(list_concat([xor(crc, b)], CAST(range(8) AS BIGINT[])), lambda v, i: xor(v >> 1, (v & 1) * 3988292384)))) AS crc
  FROM docs),
leaves AS (
  SELECT *, CASE WHEN crc % 3 = 0 THEN lowered ELSE leaf END AS shown, row_number() OVER w - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
  FROM hashed WINDOW w AS (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf)),
nodes AS (
  SELECT grp, 0 AS level, idx, n, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY grp, level, idx // 8, n),
subroots AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
  SELECT 0 AS level, idx, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE n > 1 GROUP BY level, idx // 8, n),
runs AS (
  SELECT grp, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL
  SELECT '', level, idx // 8, list(h ORDER BY idx) FROM upper WHERE n > 1 GROUP BY ALL),
low AS (
  SELECT row_number() OVER () AS id, grp, 0 AS level, idx, n, shown AS h, '' AS others FROM leaves
  UNION ALL
  SELECT id, low.grp, low.level + 1, idx // 8, (n + 7) // 8,
         sha256(array_to_string(hs[1 : idx % 8], '') || h || array_to_string(hs[idx % 8 + 2 :], '')),
         others || array_to_string(hs[1 : idx % 8], '') || array_to_string(hs[idx % 8 + 2 :], '')
  FROM low JOIN runs ON runs.grp = low.grp AND runs.level = low.level AND run = idx // 8 WHERE n > 1),
high AS (
  SELECT id, 0 AS level, subroots.idx, subroots.n, h, others FROM low JOIN subroots USING (grp) WHERE low.n = 1
  UNION ALL
  SELECT id, high.level + 1, idx // 8, (n + 7) // 8,
         sha256(array_to_string(hs[1 : idx % 8], '') || h || array_to_string(hs[idx % 8 + 2 :], '')),
         others || array_to_string(hs[1 : idx % 8], '') || array_to_string(hs[idx % 8 + 2 :], '')
  FROM high JOIN runs ON runs.grp = '' AND runs.level = high.level AND run = idx // 8 WHERE n > 1),
root AS (SELECT h AS root FROM upper WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, high.h AS folded_root, high.h = root AS verified
FROM (SELECT row_number() OVER () AS id, grp, doc_id, leaf FROM leaves) JOIN high USING (id) JOIN subroots USING (grp), root WHERE high.n = 1
"""

OP13_SQL = r"""
WITH
pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
parted AS (SELECT lang, row_number() OVER () AS piece, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
words AS (SELECT lang, piece, unnest(w) AS w1, generate_subscripts(w, 1) AS i FROM parted),
led AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3, lead(w1, 3) OVER x AS w4 FROM words WINDOW x AS (PARTITION BY piece ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM led
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM led WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM led WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM led WHERE w4 IS NOT NULL),
counted AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY lang),
found AS MATERIALIZED (SELECT lang, phrase, string_split(phrase, ' ') AS w, k, f AS a FROM counted WHERE k > 1 AND f >= 30),
cuts AS (SELECT *, array_to_string(w[1 : cut], ' ') AS left_part, array_to_string(w[cut + 1 :], ' ') AS right_part FROM (SELECT *, unnest(range(1, k)) AS cut FROM found)),
measured AS (
  SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = c.left_part JOIN counted y ON y.lang = c.lang AND y.phrase = c.right_part),
scored AS (SELECT * FROM measured QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
within AS (
  SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM found)) GROUP BY 1, 2),
ranked AS (
  SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM scored s LEFT JOIN within ON within.lang = s.lang AND within.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT ranked.lang, rank, phrase, a, l, r, n, score FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bm25_leaks": op1_bm25_leaks,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity_nnpu": op3_toxicity_nnpu,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_url_markov": op5_url_markov,
    "op6_html_crf": op6_html_crf,
    "op7_simhash_ball": op7_simhash_ball,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_language_ecoc": op9_language_ecoc,
    "op10_systematic_mixing": op10_systematic_mixing,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collocations": op13_collocations,
}
ORACLES: dict[str, str] = {"op2_quality_rules": OP2_SQL, "op10_systematic_mixing": OP10_SQL, "op12_merkle_manifest": OP12_SQL, "op13_collocations": OP13_SQL}
