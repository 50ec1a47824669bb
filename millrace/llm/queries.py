"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import collocations, compaction, embed_dedup, licenses, mixing, packing, quality_model, quality_rules, secrets, sharding, simhash, suffix, topk
from millrace.llm.scratch import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, links at 3 bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op1"))
    return found.select("doc_id", simhash.hex64("fp").alias("fingerprint"), "component_id")


@query
def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of repeated 400-byte strings, removed from every document; words in
    repeated passages of over 50 words, whatever their bytes, counted beside them."""
    return suffix.drop_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op2"), threshold=400, passage_words=51)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), Scratch(spark, "op3"), tokenizer_path(), size=2048)


@query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base statistics and line-first verdict of all documents."""
    found = quality_rules.quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"), Scratch(spark, "op10"), shards=40)


@query
def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all embeddings at cosine 0.9."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), Scratch(spark, "op7"), threshold=0.9)


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality_model.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


#: Token shares of the mix, by language.
MIX_TARGETS = {"en": 0.58, "fr": 0.18, "de": 0.16, "es": 0.08}


@query
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain posteriors and sampling rates of all documents."""
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), Scratch(spark, "op4"), MIX_TARGETS)


@query
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of all documents with the forest's verdict; values as digests."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("line").cast("long").alias("line"), F.sha2("candidate", 256).alias("candidate_sha256"), F.length("candidate").cast("long").alias("n_chars"), F.round("score", 6).alias("score"), "is_secret")


@query
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence match of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op11_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final files of all clicks after compaction."""
    done = compaction.compact(table(spark, sf_dir, "clicks"), Scratch(spark, "op11"))
    return compaction.report(done, spark).withColumnsRenamed({"min_key": "min_click_id", "max_key": "max_click_id"})


@query
def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every 20th embedding with all others."""
    return topk.search(table(spark, sf_dir, "embeddings"), Scratch(spark, "op12"), F.col("vec_id") % 20 == 0, k=20, scale=64)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of each language of all documents."""
    return collocations.mine(table(spark, sf_dir, "documents"), Scratch(spark, "op13"))


# ---- SQL of the operators that SQL can express ---------------------------------------


def _quality_sql(max_lost: float = 0.5, min_words: int = 50, max_repeat: int = 50) -> str:
    count = lambda p: f"len(regexp_extract_all(l, '{p}'))"
    phrases = "|".join(quality_rules.BOILERPLATE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS x FROM d),
w AS (SELECT doc_id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM x),
g AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM g WHERE w3 IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
m AS (SELECT doc_id, l, length(regexp_replace(l, '[\\x20\\x09-\\x0D]', '', 'g')) AS chars FROM l),
b AS (SELECT doc_id, l, chars, CASE WHEN chars = 0 THEN false WHEN {count(" [|>»·•] ")} >= 3 THEN true
  WHEN {count("[#*$%&|<>{}\\\\^~=_]")} > 0.1 * chars OR {count("!!")} * 10 > chars THEN true
  ELSE regexp_matches(lower(l), '{phrases}') AND {count("[^\\x20\\x09-\\x0D]+")} <= 12 END AS bad FROM m),
q AS (SELECT doc_id, sum(length(l)) AS total, coalesce(sum(length(l)) FILTER (WHERE bad), 0) AS lost, count(*) FILTER (WHERE chars > 0) - count(DISTINCT l) FILTER (WHERE chars > 0) AS n_dup_lines FROM b GROUP BY doc_id),
z AS (SELECT d.doc_id, coalesce(s.n_words, 0)::BIGINT AS n_words, coalesce(s.word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  q.n_dup_lines::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words, q.total, q.lost
  FROM d JOIN q USING (doc_id) LEFT JOIN s USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words AS base_failed,
  NOT (n_words < {min_words} OR 100 * n_repeat_words > {max_repeat} * n_words) AND lost <= {max_lost} * total AS kept FROM z"""


def _license_sql(threshold: float = 0.8) -> str:
    grams, sizes = [], []
    for i, t in enumerate(licenses.templates(threshold)):
        grams += [f"({i}, '{g}')" for g in t["grams"]]
        sizes.append(f"({i}, '{t['name']}', {len(t['grams'])})")
    sentence, paragraph = licenses.SENTENCE, licenses.PARAGRAPH
    return f"""
WITH tg(i, g) AS (VALUES {", ".join(grams)}), ts(i, name, n) AS (VALUES {", ".join(sizes)}),
l AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents),
u AS (SELECT * FROM l UNION SELECT doc_id, unnest(string_split_regex(u, '{sentence}')) FROM l UNION SELECT doc_id, unnest(string_split_regex(text, '{paragraph}')) FROM documents),
x AS (SELECT doc_id, row_number() OVER () AS u, x FROM (SELECT DISTINCT doc_id, regexp_extract_all(lower(u), '[a-z0-9]+') AS x FROM u)),
w AS (SELECT doc_id, u, len(x) AS n, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM x),
p AS (SELECT doc_id, u, n, w, lead(w) OVER (PARTITION BY doc_id, u ORDER BY i) AS v FROM w),
g AS (SELECT DISTINCT doc_id, u, CASE WHEN n = 1 THEN w ELSE w || ' ' || v END AS g FROM p WHERE n = 1 OR v IS NOT NULL),
k AS (SELECT doc_id, u, count(*) AS n FROM g GROUP BY doc_id, u),
m AS (SELECT g.doc_id, g.u, tg.i, count(*) AS c FROM g JOIN tg USING (g) GROUP BY g.doc_id, g.u, tg.i),
s AS (SELECT m.doc_id, m.u, ts.name, 2.0::DOUBLE * m.c / (k.n + ts.n) AS dice FROM m JOIN k ON k.doc_id = m.doc_id AND k.u = m.u JOIN ts USING (i)),
b AS (SELECT doc_id, u, name, dice FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, u ORDER BY dice DESC, name) AS r FROM s WHERE dice >= {threshold}) WHERE r = 1),
o AS (SELECT doc_id, name, dice, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r FROM b),
a AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM b GROUP BY doc_id)
SELECT d.doc_id, o.name AS license, coalesce(o.dice, 0.0::DOUBLE) AS dice, coalesce(a.n, 0)::BIGINT AS n_license_units, coalesce(a.names, '') AS licenses
FROM documents d LEFT JOIN o ON o.doc_id = d.doc_id AND o.r = 1 LEFT JOIN a ON a.doc_id = d.doc_id"""


ORACLE["op5_quality_rules"] = _quality_sql()
ORACLE["op9_licenses"] = _license_sql()


def _topk_sql(k: int = 20, scale: int = 64) -> str:
    return f"""
WITH x AS (SELECT vec_id, row_number() OVER () AS node, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT q.node, q.vec_id AS query_id, c.vec_id, c.node AS other, list_inner_product(q.v, c.v)::BIGINT AS score FROM x q JOIN x c ON q.node <> c.node WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""


def _collocations_sql(support: int = 100, top: int = 2000) -> str:
    lead = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(1, 5))
    phrase = lambda m: " || ' ' || ".join(["w", *(f"w{k}" for k in range(1, m))])
    sizes = " UNION ALL ".join(f"SELECT lang, {m} AS m, {phrase(m)} AS p FROM g{f' WHERE w{m - 1} IS NOT NULL' if m > 1 else ''}" for m in range(1, 6))
    return rf"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang, string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]') AS x FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, x FROM (SELECT lang, unnest(x) AS x FROM t)),
x AS (SELECT lang, id, regexp_extract_all(x, '[^ 	]+') AS x FROM p),
w AS (SELECT lang, id, unnest(x) AS w, generate_subscripts(x, 1) AS i FROM x),
n AS (SELECT lang, count(*)::HUGEINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, w, {lead} FROM w WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, m, p, count(*)::HUGEINT AS a FROM ({sizes}) GROUP BY lang, m, p HAVING count(*) >= {support}),
k AS (SELECT f.*, string_split(p, ' ') AS x, unnest(range(1, m)) AS k FROM f WHERE m > 1),
c AS (SELECT lang, p, a, k, array_to_string(x[:k], ' ') AS lp, array_to_string(x[k + 1:], ' ') AS rp FROM k),
s AS (SELECT c.lang, c.p, c.a, c.k, l.a AS l, r.a AS r, n.n, (1000 * c.a * n.n) // (l.a * r.a) AS score FROM c JOIN f l ON l.lang = c.lang AND l.p = c.lp JOIN f r ON r.lang = c.lang AND r.p = c.rp JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS z FROM s) WHERE z = 1),
u AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND len(f.p) > len(b.p) AND contains(' ' || f.p || ' ', ' ' || b.p || ' ') AND 100 * f.a >= 100 * b.a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p)::INT AS rank FROM u)
SELECT lang, rank, p AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o WHERE rank <= {top}"""


ORACLE["op12_topk"] = _topk_sql()
ORACLE["op13_collocations"] = _collocations_sql()
