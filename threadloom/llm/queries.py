"""The registered queries of the numbered operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm import collocations, decontamination, kneser_ney, language_id, lexical_search, line_dedup, mixing, near_dup, quality_rules, sharding, token_counts, toxicity, vector_search


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality_rules.assess_quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "quality_report.*")
    return r.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_chars", "kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op6_minhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), n=2)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = toxicity.learn_grammar(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, grammar).select("doc_id", "held_out", "score", "predicted")


#: The declared domains of the sources, and the target weights: domains 4:3:2:1, and within each English three
#: times any other language. A source that is not named belongs to the domain 'other', with weight 1.
MIX_DOMAINS = {f"src{i}": ("web", "news", "books", "forums")[i // 5] for i in range(20)}
MIX_WEIGHTS = [("web", 4), ("news", 3), ("books", 2), ("forums", 1)] + [(f"{d}/en", 3) for d in ("web", "news", "books", "forums", mixing.OTHER)]


def mix_weights(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MIX_WEIGHTS, "path string, weight long")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mixing.mix_sources(docs, mixing.domain_of(F.col("source"), MIX_DOMAINS), mix_weights(spark))
    return mixed.select("doc_id", "mix.domain", "mix.lang", "mix.source", "mix.epoch", "mix.n_tokens", "mix.budget")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    p = F.col("placement")
    return placed.select("doc_id", p["size"].alias("size"), p["text_crc32"].alias("text_crc32"), F.lit("bytes").alias("law"), p["shard"].alias("shard"), p["slot"].alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("clean_text", 256).alias("clean_sha256"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return kneser_ney.classify_quality(table(spark, sf_dir, "documents"), trusted)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.top_products(table(spark, sf_dir, "embeddings"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collocations.collocations(table(spark, sf_dir, "documents"))
    return found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP1_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iwin AS (
  SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, greatest(len(w) - m + 2, 1))) AS i FROM dw, (SELECT DISTINCT m FROM iwin))),
hit AS (SELECT d.doc_id, d.i, d.m, b.item FROM dwin d JOIN iwin b USING (m, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY 1)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP3_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, string_split(t, chr(10)) AS lines FROM d),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 6, 1))) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY 1),
ln AS (SELECT doc_id, unnest(lines) AS line FROM w),
lt AS (SELECT doc_id, line, trim(line, ' ') AS s FROM ln),
lv AS (SELECT doc_id, line, s, length(s) > 0 AND (
    length(s) - length(replace(s, '|', '')) >= 3
    OR (length(s) - length(translate(s, '#*$%&|<>', ''))) * 100 > 10 * length(s)
    OR (length(s) - length(replace(s, ' ', '')) + 1 >= 4 AND NOT regexp_matches(s, '\p{Ll}') AND regexp_matches(s, '\p{Lu}'))
    OR (length(s) - length(replace(s, ' ', '')) + 1 >= 12 AND NOT regexp_matches(s, '[.!?:;,…·؟؛،۔।॥։።፣。！？：；，、]') AND NOT regexp_matches(s, '[\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]'))
    OR (length(s) <= 200 AND (contains(lower(s), 'cookie policy') OR contains(lower(s), 'privacy policy') OR contains(lower(s), 'terms of use') OR contains(lower(s), 'terms of service') OR contains(lower(s), 'all rights reserved') OR contains(lower(s), 'click here') OR contains(lower(s), 'sign in') OR contains(lower(s), 'log in') OR contains(lower(s), 'subscribe now') OR contains(lower(s), 'enable javascript') OR contains(lower(s), 'skip to content') OR contains(lower(s), 'skip to main content') OR contains(lower(s), 'share this') OR contains(lower(s), 'read more') OR contains(lower(s), 'alle rechte vorbehalten') OR contains(lower(s), 'datenschutzerklärung') OR contains(lower(s), 'nutzungsbedingungen') OR contains(lower(s), 'hier klicken') OR contains(lower(s), 'weiterlesen') OR contains(lower(s), 'zum inhalt springen') OR contains(lower(s), 'tous droits réservés') OR contains(lower(s), 'politique de confidentialité') OR contains(lower(s), 'conditions d''utilisation') OR contains(lower(s), 'cliquez ici') OR contains(lower(s), 'lire la suite') OR contains(lower(s), 'aller au contenu') OR contains(lower(s), 'todos los derechos reservados') OR contains(lower(s), 'política de privacidad') OR contains(lower(s), 'términos de uso') OR contains(lower(s), 'haga clic aquí') OR contains(lower(s), 'leer más') OR contains(lower(s), 'saltar al contenido')))
  ) AS bad FROM lt),
la AS (SELECT doc_id, CAST(coalesce(sum(length(line)) FILTER (bad), 0) AS BIGINT) AS lost_chars,
  count(*) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) - count(DISTINCT line) FILTER (regexp_matches(line, '[^\x20\x09-\x0D]')) AS n_dup_lines FROM lv GROUP BY 1),
b AS (SELECT w.doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, lost_chars
  FROM w JOIN la USING (doc_id) LEFT JOIN cov USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, lost_chars,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND lost_chars * 100 <= length(t) * 50 AS kept
FROM b
"""

OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
sh AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM sh JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS c FROM w UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.c AS component_id, w.doc_id = m.c AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(c) AS c FROM r GROUP BY 1) m ON m.id = w.doc_id
"""

OP4_SQL = r"""
WITH w(path, weight) AS (VALUES ('web', 4), ('news', 3), ('books', 2), ('forums', 1), ('web/en', 3), ('news/en', 3), ('books/en', 3), ('forums/en', 3), ('other/en', 3)),
d AS (SELECT doc_id, CASE WHEN regexp_full_match(coalesce(source, ''), 'src[0-4]') THEN 'web' WHEN regexp_full_match(coalesce(source, ''), 'src[5-9]') THEN 'news'
    WHEN regexp_full_match(coalesce(source, ''), 'src1[0-4]') THEN 'books' WHEN regexp_full_match(coalesce(source, ''), 'src1[5-9]') THEN 'forums' ELSE 'other' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n_tokens, text FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY 1, 2, 3),
t AS (SELECT CAST(sum(tokens) * 50 // 100 AS BIGINT) AS total FROM leaf),
l1 AS (SELECT domain, CAST(sum(tokens) * 4 AS BIGINT) AS cap, any_value(coalesce(w.weight, 1)) AS wt FROM leaf LEFT JOIN w ON w.path = domain GROUP BY 1),
l1o AS (SELECT *, (SELECT total FROM t) - coalesce(sum(cap) OVER (ORDER BY cap / wt, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(wt) OVER (ORDER BY cap / wt, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sh FROM l1),
l1r AS (SELECT arg_min(lft, cap / wt) AS lft, arg_min(sh, cap / wt) AS sh FROM l1o WHERE NOT cap * sh <= lft * wt),
b1 AS (SELECT domain, CAST(CASE WHEN cap * l1o.sh <= l1o.lft * wt THEN cap ELSE wt * l1r.lft // l1r.sh END AS BIGINT) AS given FROM l1o LEFT JOIN l1r ON true),
l2 AS (SELECT domain, lang, CAST(sum(tokens) * 4 AS BIGINT) AS cap, any_value(coalesce(w.weight, 1)) AS wt FROM leaf LEFT JOIN w ON w.path = domain || '/' || lang GROUP BY 1, 2),
l2o AS (SELECT l2.*, given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / wt, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(wt) OVER (PARTITION BY domain ORDER BY cap / wt, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sh FROM l2 JOIN b1 USING (domain)),
l2r AS (SELECT domain, arg_min(lft, cap / wt) AS lft, arg_min(sh, cap / wt) AS sh FROM l2o WHERE NOT cap * sh <= lft * wt GROUP BY 1),
b2 AS (SELECT domain, lang, CAST(CASE WHEN cap * l2o.sh <= l2o.lft * wt THEN cap ELSE wt * l2r.lft // l2r.sh END AS BIGINT) AS given FROM l2o LEFT JOIN l2r USING (domain)),
l3 AS (SELECT domain, lang, source, tokens, tokens * 4 AS cap, 1 AS wt FROM leaf),
l3o AS (SELECT l3.*, given - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / wt, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft, sum(wt) OVER (PARTITION BY domain, lang ORDER BY cap / wt, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sh FROM l3 JOIN b2 USING (domain, lang)),
l3r AS (SELECT domain, lang, arg_min(lft, cap / wt) AS lft, arg_min(sh, cap / wt) AS sh FROM l3o WHERE NOT cap * sh <= lft * wt GROUP BY 1, 2),
b3 AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN cap * l3o.sh <= l3o.lft * wt THEN cap ELSE wt * l3r.lft // l3r.sh END AS BIGINT) AS budget FROM l3o LEFT JOIN l3r USING (domain, lang)),
p AS (SELECT d.*, budget, CAST(budget // tokens AS BIGINT) AS whole, budget % tokens AS rest,
  md5('mix-1:' || (budget // tokens) || ':' || doc_id || ':' || md5(coalesce(text, ''))) AS spot FROM d JOIN b3 USING (domain, lang, source))
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n_tokens, budget FROM (
  SELECT *, unnest(range(0, whole + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY spot) <= rest THEN 1 ELSE 0 END)) AS e FROM p)
"""

OP9_SQL = r"""
WITH l AS (SELECT doc_id, source, g.i AS i, string_split(text, chr(10))[g.i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i) g WHERE text IS NOT NULL),
b AS (SELECT trim(line, ' ') AS s FROM l WHERE length(trim(line, ' ')) >= 1 GROUP BY 1 HAVING count(DISTINCT source) >= 10),
m AS (SELECT l.*, b.s IS NOT NULL AS gone FROM l LEFT JOIN b ON b.s = trim(line, ' '))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_sha256 FROM m GROUP BY 1
"""

OP11_SQL = r"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
d AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
c AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT item_id, term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w FROM q JOIN df USING (term), c),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * nd) // nt)))) AS BIGINT) AS score FROM w JOIN tf USING (term) JOIN d USING (doc_id), c GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP12_SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
u AS (SELECT vec_id, unnest(e) AS x, unnest(range(1, len(e) + 1)) AS i FROM v),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score FROM u q JOIN u c ON c.i = q.i AND c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
c AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY 1),
s AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, m FROM s, (SELECT unnest(range(1, 6)) AS m) WHERE i + m - 1 <= len(w)),
f AS (SELECT lang, g, m, CAST(count(*) AS HUGEINT) AS a, string_split(g, ' ') AS ws FROM g GROUP BY 1, 2, 3 HAVING count(*) >= 100),
sub AS (SELECT DISTINCT lang, array_to_string(ws[i:i + k - 1], ' ') AS g, a FROM (SELECT lang, ws, m, a, unnest(range(2, m)) AS k FROM f WHERE m > 2), (SELECT unnest(range(1, 5)) AS i) WHERE i + k - 1 <= m),
top AS (SELECT lang, g, max(a) AS longer FROM sub GROUP BY 1, 2),
cand AS (SELECT f.* FROM f LEFT JOIN top USING (lang, g) WHERE m > 1 AND NOT coalesce(100 * longer >= 100 * a, false)),
cut AS (SELECT lang, g, a, k, array_to_string(ws[1:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM cand)),
sc AS (SELECT cut.lang, cut.g, cut.a, k, l.a AS l, r.a AS r, n, (1000 * cut.a * n) // (l.a * r.a) AS score
  FROM cut JOIN f l ON l.lang = cut.lang AND l.g = x JOIN f r ON r.lang = cut.lang AND r.g = y JOIN c ON c.lang = cut.lang),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(g)) AS rank, g AS phrase, a, l, r, n, score FROM best)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM o WHERE rank <= 2000
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_toxicity": op2_toxicity,
    "op3_quality_rules": op3_quality_rules,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_minhash_near_dup": op6_minhash_near_dup,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_line_dedup": op9_line_dedup,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_lexical_search": op11_lexical_search,
    "op12_vector_search": op12_vector_search,
    "op13_collocations": op13_collocations,
}
SQL = {
    "op1_decontamination": OP1_SQL,
    "op3_quality_rules": OP3_SQL,
    "op4_mixing": OP4_SQL,
    "op6_minhash_near_dup": OP6_SQL,
    "op9_line_dedup": OP9_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_vector_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
