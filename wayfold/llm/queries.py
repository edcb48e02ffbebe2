"""Registered queries of the training-data operators, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import ann, bpe, conversations, html_text, importance, langid, licenses, mixing, packing, pii, quality, recipe, simhash, toxicity
from wayfold.llm.common import crc_mod


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; docstring of simhash defines the edge cases."""
    rows, _ = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    got = quality.assess(docs, model)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return got.select("doc_id", *(F.col(f"__quality.{n}").alias(n) for n in names), F.round("__quality.ratio", 6).alias("mean_log_ratio"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken for the target weights, with epochs and tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    got = mixing.mix(docs, recipe.domain_of(F.col("source")), recipe.WEIGHTS, recipe.FRACTION, recipe.MAX_EPOCHS, recipe.SEED, columns=("doc_id", "lang", "source"))
    return got.select("doc_id", F.col("__domain").alias("domain"), "lang", "source", F.col("__tokens").alias("n_tokens"), F.col("__epochs").alias("epochs"), F.col("__taken").alias("taken_tokens"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), recipe.tokenizer_file())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside the held-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = crc_mod(F.col("doc_id"), 3)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), part != 1)
    got = toxicity.classify(docs, model)
    return got.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families confirmed in every document, and the best unconfirmed evidence."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = licenses.scan(docs, licenses.train(licenses.corpus_statements(docs)))
    hits = F.filter("__licences", lambda r: r["confirmed"])
    return got.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda r: r["family"]))), ",").alias("families"),
        F.size("__licences").cast("long").alias("n_predicted"),
        F.size(hits).cast("long").alias("n_confirmed"),
        F.array_max(F.transform(hits, lambda r: r["probability"])).alias("best_probability"),
        F.array_max(F.transform(hits, lambda r: r["overlap"])).alias("best_overlap"),
    )


def op7_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities replaced in every document and a digest of the new text."""
    got = pii.replace_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), recipe.surrogate_key(spark), with_entities=True)
    kinds = F.array_sort(F.array_distinct(F.col("__entities.kind")))
    return got.select("doc_id", F.size("__entities").cast("long").alias("n_entities"), F.array_join(kinds, ",").alias("kinds"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = crc_mod(F.col("doc_id"), 4)
    model = langid.fit(docs, part != 2)
    got = langid.identify(docs, model)
    return got.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page."""
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every vector whose id is divisible by 20."""
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), recipe.tokenizer_file())


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and hash of every conversation after damage."""
    every = table(spark, sf_dir, "conversations")
    report, _ = conversations.repair(conversations.damage(every), every)
    return report


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document towards the benchmark's words."""
    got = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_simhash_near_dedup, op2_quality_rules, op3_mix_sources, op4_bpe, op5_toxicity, op6_licence_scan, op7_pii_surrogates, op8_language_id, op9_html_extraction, op10_nearest_neighbours, op11_minimum_bin_slack, op12_conversation_repair, op13_importance_resampling, pipeline)
}


def _weight_case(depth: int, columns: tuple[str, ...]) -> str:
    rows = [(k, w) for k, w in recipe.WEIGHTS.items() if len(k) == depth]
    cases = "".join(" WHEN " + " AND ".join(f"{c} = '{v}'" for c, v in zip(columns, k, strict=False)) + f" THEN {float(w)}" for k, w in rows)
    return f"CASE{cases} ELSE 1.0 END" if cases else "1.0"


def _filled(name: str, source: str, parent: str, own: str, depth: int, columns: tuple[str, ...]) -> str:
    """Water-filling of one level by testing every possible cut of the sorted children."""
    order = f"PARTITION BY {parent} ORDER BY cap / w, {own} NULLS FIRST"
    return f"""
{name}_w AS (SELECT *, CAST({_weight_case(depth, columns)} AS DOUBLE) AS w FROM {source}),
{name}_r AS (SELECT *, row_number() OVER ({order}) AS k,
    coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    sum(w) OVER (PARTITION BY {parent}) - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_open FROM {name}_w),
{name}_l AS (SELECT *, cap * w_open <= (given - cap_before) * w * (1 + 1e-12) AS is_full FROM {name}_r),
{name}_m AS (SELECT *, min(CASE WHEN NOT is_full THEN k END) OVER (PARTITION BY {parent}) AS first_open FROM {name}_l),
{name}_e AS (SELECT *, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
    w * max(CASE WHEN k = first_open THEN (given - cap_before) / w_open END) OVER (PARTITION BY {parent}) END AS exact FROM {name}_m),
{name}_u AS (SELECT *, CAST(floor(sum(exact) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + 1e-6) AS BIGINT) AS upto FROM {name}_e),
{name} AS (SELECT *, least(cap, upto - coalesce(lag(upto) OVER ({order}), 0)) AS budget FROM {name}_u)"""


OP3_SQL = f"""
WITH t AS (SELECT doc_id, lang, source,
    CASE WHEN regexp_matches(source, '^src[0-9]+$') THEN 'd' || CAST(CAST(substr(source, 4) AS BIGINT) % 4 AS VARCHAR) ELSE 'other' END AS domain,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens,
    md5(coalesce(text, '')) AS digest
  FROM documents),
d AS (SELECT * FROM t WHERE n_tokens > 0),
leaf0 AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS supply, CAST(sum(n_tokens) * {recipe.MAX_EPOCHS} AS BIGINT) AS cap FROM d GROUP BY ALL),
lang0 AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap FROM leaf0 GROUP BY ALL),
dom0 AS (SELECT 1 AS one, domain, CAST(sum(cap) AS BIGINT) AS cap FROM leaf0 GROUP BY ALL),
dom1 AS (SELECT dom0.*, (SELECT CAST(floor(CAST(sum(cap) // {recipe.MAX_EPOCHS} AS DOUBLE) * {recipe.FRACTION}) AS BIGINT) FROM dom0) AS given FROM dom0),
{_filled("dom", "dom1", "one", "domain", 1, ("domain",))},
lang1 AS (SELECT l.*, p.budget AS given FROM lang0 l JOIN dom p ON l.domain IS NOT DISTINCT FROM p.domain),
{_filled("lng", "lang1", "domain", "lang", 2, ("domain", "lang"))},
leaf1 AS (SELECT l.*, p.budget AS given FROM leaf0 l JOIN lng p ON l.domain IS NOT DISTINCT FROM p.domain AND l.lang IS NOT DISTINCT FROM p.lang),
{_filled("lef", "leaf1", "domain, lang", "source", 3, ("domain", "lang", "source"))},
budgeted AS (SELECT d.*, budget // supply AS whole, budget % supply AS rest
  FROM d JOIN lef ON d.domain IS NOT DISTINCT FROM lef.domain AND d.lang IS NOT DISTINCT FROM lef.lang AND d.source IS NOT DISTINCT FROM lef.source),
keyed AS (SELECT *, CAST('0x' || substr(md5('{recipe.SEED}-' || CAST(whole + 1 AS VARCHAR) || '-' || coalesce(CAST(doc_id AS VARCHAR), '') || '-' || digest), 1, 15) AS BIGINT) AS pos FROM budgeted),
placed AS (SELECT *,
    coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY pos, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at
  FROM keyed),
part AS (SELECT *, greatest(0, least(n_tokens, rest - start_at)) AS part FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(whole + CASE WHEN part > 0 THEN 1 ELSE 0 END AS INTEGER) AS epochs,
  CAST(whole * n_tokens + part AS BIGINT) AS taken_tokens
FROM part WHERE whole + CASE WHEN part > 0 THEN 1 ELSE 0 END > 0
"""

OP10_SQL = """
WITH v AS (SELECT vec_id, max(CAST(embedding AS DOUBLE[])) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND NOT list_contains(list_transform(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x)), true)
      AND list_contains(list_transform(embedding, lambda x: x <> 0), true) GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

#: crc32 of a text's bytes: the table of remainders, then a fold over the bytes.
CRC_SQL = """
crc_t AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, CAST(b AS BIGINT))) AS t)"""


def _crc(text: str) -> str:
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS BIGINT)"
    folded = f"list_reduce(list_transform(range(CAST(octet_length(encode({text})) AS BIGINT)), lambda i: {byte}), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1]), 4294967295)"
    return f"xor({folded}, 4294967295)"


_ALIKE = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FEATURES = rf"regexp_extract_all({_ALIKE}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH {CRC_SQL},
d AS (SELECT row_number() OVER () AS r, doc_id, {_FEATURES} AS words FROM documents),
dw AS (SELECT r, unnest(words) AS w FROM d),
bw AS (SELECT unnest({_FEATURES}) AS w FROM benchmark),
vocabulary AS (SELECT w, {_crc("w")} % 10000 AS b FROM (SELECT w FROM dw UNION SELECT w FROM bw), crc_t),
s AS (SELECT b, count(*) AS s FROM dw JOIN vocabulary USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS t FROM bw JOIN vocabulary USING (w) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS g
  FROM s FULL JOIN t USING (b)),
w AS (SELECT r, CAST(sum(g) AS BIGINT) AS g FROM dw JOIN vocabulary USING (w) JOIN gain USING (b) GROUP BY r),
h AS (SELECT d.r, doc_id, CAST(len(words) AS BIGINT) AS n_features, CASE WHEN len(words) = 0 THEN 0 ELSE (g - ((g % len(words)) + len(words)) % len(words)) // len(words) END AS weight,
    CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN w ON d.r = w.r),
sc AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score, n_features >= 20 AS fit FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER (PARTITION BY fit) AS n FROM sc)
SELECT doc_id, n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CASE WHEN fit AND k <= 10 * n // 100 THEN k END AS rank FROM k
"""

#: Cheapest costs of every state, from the last row back (b: nothing yet, s: after a system row, p: after a pair, u: after a user
#: row), then the audit from the first row on: what is least of D, I, K, R among the cheapest.
OP12_SQL = f"""
WITH RECURSIVE {CRC_SQL},
c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
m AS (SELECT *, {_crc("key")} % 20 AS code FROM c, crc_t),
x AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN code = 3 THEN 2 ELSE 1 END)) AS copy FROM m WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, right(regexp_replace(text, '[\x20\x09-\x0D]+$', ''), 1) AS e,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS j FROM x),
f AS (SELECT *, CASE WHEN e = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN e NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(j) OVER (PARTITION BY conv_id ORDER BY i) || j AS pair, count(*) OVER (PARTITION BY conv_id) AS n FROM o),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, CAST(count(*) AS BIGINT) AS n FROM f GROUP BY conv_id),
back AS (
  SELECT conv_id, n + 1 AS i, CAST(0 AS BIGINT) AS b, CAST(4 AS BIGINT) AS s, CAST(0 AS BIGINT) AS p, CAST(2 AS BIGINT) AS u FROM g
  UNION ALL
  SELECT conv_id, i, least(b, u + 2, p + 4), least(s, u + 2, p + 4), least(p, u + 2), least(u, p + 2, u + 4) FROM (
    SELECT f.conv_id, f.i,
      least(k.b + 3, CASE WHEN gone THEN 999999 WHEN j = 's' THEN least(k.s, k.u + 2) + cut WHEN j = 'u' THEN k.u + cut ELSE k.u + 2 + cut END) AS b,
      least(k.s + 3, CASE WHEN gone THEN 999999 WHEN j = 'u' THEN k.u + cut ELSE k.u + 2 + cut END) AS s,
      least(k.p + 3, CASE WHEN gone THEN 999999 WHEN j = 'u' THEN k.u + cut ELSE k.u + 2 + cut END) AS p,
      least(k.u + 3, CASE WHEN gone THEN 999999 WHEN j = 'a' THEN k.p + cut ELSE k.p + 2 + cut END) AS u
    FROM back k JOIN (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut FROM f) f ON f.conv_id IS NOT DISTINCT FROM k.conv_id AND f.i = k.i - 1)),
walk AS (
  SELECT conv_id, n, CAST(1 AS BIGINT) AS i, 'b' AS st, '' AS audit, '' AS body, 0 AS lines, false AS over FROM g
  UNION ALL
  SELECT conv_id, n, CASE WHEN act IN ('D', 'K', 'R') THEN i + 1 ELSE i END,
    CASE WHEN act IN ('D', '') THEN st WHEN act = 'K' AND j = 's' THEN 's' WHEN st = 'u' THEN 'p' ELSE 'u' END, audit || act,
    CASE WHEN act IN ('D', '') THEN body ELSE body || CASE WHEN lines > 0 THEN chr(10) ELSE '' END || CASE WHEN act = 'K' THEN role WHEN st = 'u' THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN act = 'I' THEN '' ELSE text END END,
    lines + CASE WHEN act IN ('D', '') THEN 0 ELSE 1 END, act = ''
  FROM (SELECT q.*, CASE
        WHEN i > n AND now = 0 THEN ''
        WHEN i <= n AND 3 + stay = now THEN 'D'
        WHEN 2 + inserted = now THEN 'I'
        WHEN i <= n AND NOT gone AND (j = CASE WHEN st = 'u' THEN 'a' ELSE 'u' END) AND cut + moved = now THEN 'K'
        WHEN i <= n AND NOT gone AND j = 's' AND st = 'b' AND cut + after_s = now THEN 'K'
        ELSE 'R' END AS act
    FROM (SELECT w.conv_id, w.n, w.i, w.st, w.audit, w.body, w.lines, f.j, f.role, f.text, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS cut,
        CASE st WHEN 'b' THEN h.b WHEN 's' THEN h.s WHEN 'p' THEN h.p ELSE h.u END AS now,
        CASE st WHEN 'b' THEN k.b WHEN 's' THEN k.s WHEN 'p' THEN k.p ELSE k.u END AS stay,
        CASE st WHEN 'u' THEN h.p ELSE h.u END AS inserted, CASE st WHEN 'u' THEN k.p ELSE k.u END AS moved, k.s AS after_s
      FROM walk w JOIN back h ON h.conv_id IS NOT DISTINCT FROM w.conv_id AND h.i = w.i
      LEFT JOIN back k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1
      LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i WHERE NOT w.over) q)),
done AS (SELECT conv_id, audit, sha256(body) AS repaired_sha256 FROM walk WHERE over),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(h.b, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM every e LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN back h ON h.conv_id IS NOT DISTINCT FROM e.conv_id AND h.i = 1
"""

ORACLES = {"op3_mix_sources": OP3_SQL, "op10_nearest_neighbours": OP10_SQL, "op12_conversation_repair": OP12_SQL, "op13_importance_resampling": OP13_SQL}
