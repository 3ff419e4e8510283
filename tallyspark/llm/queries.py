"""Queries of the training-data operators, each over its whole table, and
their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import (
    crosstoken,
    decontam,
    divergence,
    exact,
    html,
    langid,
    minhash,
    mixing,
    pii,
    subspace,
    suffix,
    tokens,
    toxicity,
)
from tallyspark.llm.common import LOWER, UPPER, read, scratch_path

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return register


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return str(public_tokenizers.path(name))


@query("op1_pii")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(read(spark, sf_dir, "documents"))
    return found.select("doc_id", *(f"n_{b}" for b in pii.KINDS), F.size("spans").cast("long").alias("n_spans"),
                        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans"))


@query("op2_repeated_bytes")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(toxicity.binary_grades(docs, read(spark, sf_dir, "labels")))
    return toxicity.severity(docs, model)


@query("op4_near_dedup", sql=rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'),
                             lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w
         ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
one AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
link AS (SELECT a, b FROM one UNION ALL SELECT b, a FROM one),
reach(doc_id, seen) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.seen)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(seen) AS component_id, min(seen) = doc_id AS kept
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as its contract fixes them."""
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), shingle=2)


@query("op5_exact_dedup", sql="""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS points,
                  sha256(translate(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS text_sha256
           FROM documents),
g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact.exact_dedup(read(spark, sf_dir, "documents"), every_hash=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op6_language_id")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    model = langid.fit(docs.filter(~held))
    out = langid.identify(docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op7_token_blocks")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(read(spark, sf_dir, "documents"), path, tokenizer_path())
    return tokens.token_digest(spark, path)


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.render_pages(read(spark, sf_dir, "pages"))


#: Targets by filling up, then quotas and words taken, seat by seat.
MIX_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents),
c AS (SELECT greatest(1, CAST(floor(sqrt(count(*))) AS BIGINT) // 10) AS shards, CAST(sum(size) AS BIGINT) AS total FROM d),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, (SELECT total FROM c) - coalesce(sum(cap) OVER b, 0) AS rest, sum(weight) OVER a AS free,
         row_number() OVER (ORDER BY cap / weight, source IS NULL, source) AS place FROM s1
       WINDOW b AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              a AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lv AS (SELECT arg_min(rest / free, place) AS level FROM s2 WHERE rest / free * weight <= cap),
s3 AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), level * weight) AS target,
         CAST(round((SELECT total FROM c) / {mixing.BLOCK}) AS BIGINT) AS seats FROM s2, lv),
q1 AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source IS NULL, source, k) AS r
       FROM (SELECT *, unnest(range(0, CAST(target / {mixing.BLOCK} AS BIGINT) + 1000)) AS k FROM s3 WHERE target > 0)),
s4 AS (SELECT s3.source, source_size, target, coalesce(held, 0) AS blocks FROM s3 LEFT JOIN
         (SELECT source, count(*) AS held FROM q1 WHERE r <= seats GROUP BY source) h ON h.source IS NOT DISTINCT FROM s3.source),
e AS (SELECT d.*, CAST('0x' || substr(md5('{mixing.SEED}:shard:' || doc_id), 1, 15) AS BIGINT)
          % least((SELECT shards FROM c), greatest(1, source_size // {mixing.SHARD_WORDS})) AS shard,
        CAST('0x' || substr(md5('{mixing.SEED}:draw:' || doc_id), 1, 15) AS BIGINT) AS draw
      FROM d JOIN s0 ON d.source IS NOT DISTINCT FROM s0.source),
f AS (SELECT e.source, shard, sum(size) AS held, any_value(blocks) AS blocks, any_value(source_size) AS source_size,
        any_value(target) AS target FROM e JOIN s4 ON e.source IS NOT DISTINCT FROM s4.source GROUP BY e.source, shard),
q2 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY held / (2 * k + 1) DESC, shard, k) AS r
       FROM (SELECT *, unnest(range(0, CAST(blocks AS BIGINT) + 1)) AS k FROM f WHERE held > 0)),
g AS (SELECT f.source, f.shard, f.held, source_size, target, least(coalesce(h.n, 0) * {mixing.BLOCK}, 3 * f.held) AS words FROM f LEFT JOIN
        (SELECT source, shard, count(*) AS n FROM q2 WHERE r <= blocks GROUP BY source, shard) h
        ON h.source IS NOT DISTINCT FROM f.source AND h.shard = f.shard),
t AS (SELECT e.doc_id, e.size, source_size, target, words, held,
        sum(e.size) OVER (PARTITION BY e.source, e.shard ORDER BY draw, doc_id) - e.size AS before
      FROM e JOIN g ON g.source IS NOT DISTINCT FROM e.source AND g.shard = e.shard)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN held = 0 THEN 0 ELSE (words // held) * size
  + greatest(0, least(words - (words // held) * held - before, size)) END AS BIGINT) AS taken FROM t"""


@query("op9_mix_sources", sql=MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents")).drop("source")


def _terms_sql(text: str) -> str:
    return (f"list_filter(regexp_split_to_array(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), "
            r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')")


@query("op10_decontaminate", sql=f"""
WITH d AS (SELECT doc_id, {_terms_sql('text')} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_terms_sql('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(list_slice(w, p, p + least(13, len(w)) - 1), ' ') AS phrase
        FROM (SELECT *, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
g AS (SELECT doc_id, p, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS phrase
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win))),
occ AS (SELECT doc_id, p, g.n, item FROM g JOIN win USING (phrase)),
hits AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM occ) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
          FROM (SELECT DISTINCT doc_id, item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = crosstoken.align_tokens(read(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path("piece_bpe_32k.model"),
                                       keep_groups=False)
    return found.withColumnRenamed("groups", "groups_sha256")


@query("op12_source_divergence", sql=rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'),
                                               '[\x00-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
c AS (SELECT g.lang, g.source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN n USING (lang, source, term)),
p AS (SELECT *, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
q AS (SELECT lang, term, 1 + 1000000000 * (n + 5) // (sum(n) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS q
      FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY ALL)),
two AS (SELECT a.lang, a.source, b.source AS item FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS v FROM p a JOIN p b
          ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
rows AS (SELECT lang, source, 'pair' AS part, item, CAST(coalesce(v, 0) AS BIGINT) AS value FROM two LEFT JOIN apart USING (lang, source, item)
         UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM rows)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP}""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(read(spark, sf_dir, "documents"))


@query("op13_near_vectors", sql=f"""
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
v AS (SELECT * FROM e WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
         WHERE list_cosine_similarity(a.e, b.e) >= {subspace.COSINE}),
reach(vec_id, seen) AS (SELECT vec_id, vec_id FROM e UNION SELECT r.vec_id, l.b FROM reach r JOIN link l ON l.a = r.seen),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(seen) AS component_id, min(seen) = vec_id AS kept
FROM reach LEFT JOIN n USING (vec_id) GROUP BY vec_id""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subspace.near_vectors(read(spark, sf_dir, "embeddings"))
