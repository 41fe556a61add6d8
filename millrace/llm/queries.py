"""The numbered queries over whole tables, and DuckDB's SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import balls, chat, embeddings, html, jaccard, minhash, mixing, phrases, pieces, quality, suffixes, toxicity, urls
from .common import table

MIX_SEED = 20
PIECE_SEED = 10


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents mixed to equal weights of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents"), seed=MIX_SEED)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.long_repeats(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.segment(table(spark, sf_dir, "documents"), seed=PIECE_SEED)


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.fingerprinted(table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.ball_kmeans(table(spark, sf_dir, "embeddings"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_embedding_near_dedup, op2_html_extraction, op3_url_filters, op4_mixing, op5_quality_rules, op6_suffix_array_dedup, op7_toxicity, op8_ngram_jaccard_join, op9_chat_formatting, op10_sentencepiece)
    return {f.__name__: f for f in (*every, op11_document_fingerprints, op12_centroid_clustering, op13_phrase_mining)}


OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, min(r.b) AS component_id, min(r.b) = e.vec_id AS kept
FROM embeddings e JOIN reach r ON r.a = e.vec_id GROUP BY e.vec_id
"""

OP4 = f"""
WITH per AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM per)) * (SELECT sum(n) FROM per) / n AS rate FROM per),
terms AS (
  SELECT source, k, exp(-rate + k * ln(rate) - CASE WHEN k = 0 THEN 0 ELSE lgamma(k + 1) END) AS p
  FROM rates, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT))) AS t(k)
),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
cdfs AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(cs, lambda x: x <= CAST('0x' || substr(md5('{MIX_SEED}:count:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE)) AS n_copies
  FROM documents d JOIN cdfs ON d.source IS NOT DISTINCT FROM cdfs.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INTEGER) AS n_copies, CAST(c.copy AS INTEGER) AS copy,
  md5('{MIX_SEED}:place:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || c.copy) AS shuffle_key
FROM drawn, unnest(range(1, n_copies + 1)) AS c(copy)
"""

OP6 = r"""
WITH h AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents),
g AS MATERIALIZED (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM h, unnest(range(0, n - 49)) AS u(i)),
m AS (SELECT s, min(doc_id) AS lo FROM g GROUP BY s HAVING min(doc_id) < max(doc_id)),
c AS (SELECT g.doc_id, i FROM g JOIN m ON m.s = g.s WHERE g.doc_id > lo),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM c),
r AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b),
s AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS z FROM r GROUP BY ALL),
k AS (SELECT doc_id, list_append(list_prepend(0, list(z ORDER BY a)), 0) AS zs, list(a ORDER BY a) AS starts, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM s GROUP BY doc_id)
SELECT h.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE array_to_string(list_transform(range(1, len(starts) + 2), lambda j: substr(h, 2 * zs[j] + 1, 2 * (coalesce(list_append(starts, n)[j], n) - zs[j]))), '') END)) AS kept_sha256
FROM h LEFT JOIN k ON k.doc_id = h.doc_id
"""

OP8 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS ws FROM documents
),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(ws) - 3, 2))) AS u(i) WHERE len(ws) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.b) AS component_id FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""

OP9 = """
WITH c AS (
  SELECT conv_id, turn, replace(replace(coalesce(role, 'unknown'), chr(10), ' '), '<|', '< |') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations
),
m AS (SELECT *, (row_number() OVER w - 1) // 1024 AS part, row_number() OVER w AS place FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
parts AS (SELECT DISTINCT conv_id, part FROM m),
told AS (
  SELECT p.conv_id, p.part, max(m.place) AS place FROM parts p JOIN m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.part < p.part AND m.role = 'system' GROUP BY ALL
),
shown AS (
  SELECT conv_id, part, place, role, text FROM m
  UNION ALL SELECT t.conv_id, t.part, t.place, m.role, m.text FROM told t JOIN m ON m.conv_id IS NOT DISTINCT FROM t.conv_id AND m.place = t.place
),
g AS (SELECT conv_id, part, list({'role': role, 'text': text} ORDER BY place) AS ms FROM shown GROUP BY conv_id, part),
speakers AS (SELECT DISTINCT conv_id, role AS speaker FROM m WHERE role <> 'system'),
s AS (SELECT g.conv_id, part, ms, speaker FROM g JOIN speakers u ON u.conv_id IS NOT DISTINCT FROM g.conv_id),
p AS (
  SELECT conv_id, part, speaker, list_transform(ms, lambda m: {
    'head': '<|im_start|>' || CASE WHEN m.role = 'system' THEN 'system' WHEN m.role = speaker THEN 'assistant' ELSE 'user name=' || m.role END || chr(10),
    'body': m.text, 'own': CASE WHEN m.role = speaker THEN 1 ELSE 0 END}) AS parts FROM s
),
l AS (
  SELECT *, list_transform(parts, lambda x: length(x.head)) AS hs, list_transform(parts, lambda x: length(x.body)) AS bs, list_transform(parts, lambda x: length(x.head) + length(x.body) + 11) AS ls FROM p
),
w AS (
  SELECT *, list_transform(range(1, len(parts) + 1), lambda i: coalesce(list_sum(ls[1:i-1]), 0)) AS offs FROM l
)
SELECT conv_id, part, speaker, CAST(len(parts) AS BIGINT) AS n_messages, CAST(list_sum(list_transform(parts, lambda x: x.own)) AS BIGINT) AS n_trained,
  array_to_string(list_transform(parts, lambda x: x.head || x.body || '<|im_end|>' || chr(10)), '') AS rendered,
  list_transform(parts, lambda x: x.own) AS mask,
  array_to_string(list_transform(list_filter(range(1, len(parts) + 1), lambda i: parts[i].own = 1), lambda i: CAST(CAST(offs[i] + hs[i] AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(offs[i] + hs[i] + bs[i] AS BIGINT) AS VARCHAR)), ',') AS spans
FROM w
"""


def op12_sql(k: int = 8, rounds: int = 10, seed: int = 3) -> str:
    """Lloyd's rounds one after another, each against all centroids."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT i, vec_id, v, min(struct_pack(d := d, c := c)) AS s FROM (
    SELECT i, vec_id, v, c, CAST(list_sum(list_transform(range(1, 65), lambda j: (v[j] - m[j]) * (v[j] - m[j]))) AS BIGINT) AS d FROM w CROSS JOIN c{r}
  ) GROUP BY i, vec_id, v
)"""
    moved = """c{n} AS MATERIALIZED (
  SELECT c{r}.c, coalesce(t.m, c{r}.m) AS m FROM c{r} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS m FROM (
      SELECT s.c AS c, j, sum(v[j]) AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS u(j) GROUP BY ALL
    ) GROUP BY c
  ) t ON t.c = c{r}.c
)"""
    steps = [x for r in range(rounds) for x in (nearest.format(r=r), moved.format(r=r, n=r + 1))]
    return f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
w AS MATERIALIZED (
  SELECT row_number() OVER () AS i, vec_id, list_transform(e, lambda x: CAST(floor(1024 * greatest(least(x, 65536), -65536)) AS BIGINT)) AS v FROM e
  WHERE len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m FROM (SELECT v, sha256('{seed}:' || coalesce(CAST(vec_id AS VARCHAR), 'null')) AS h FROM w ORDER BY h, v LIMIT {k})
),
{", ".join(steps)},
{nearest.format(r=rounds)}
SELECT vec_id, CAST(s.c AS INTEGER) AS cluster, s.d AS distance, CAST(sum(s.d) OVER (PARTITION BY s.c) AS BIGINT) AS cluster_inertia, CAST(sum(s.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c = s.c
"""


OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?
-
]')) AS piece FROM d),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ 	]+'), lambda x: x <> '') AS ws FROM p),
n AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM w, unnest(range(1, 5)) AS a(k), unnest(range(1, len(ws) - k + 2)) AS b(i)),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS c FROM g GROUP BY ALL HAVING c >= 30),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, c AS a FROM f WHERE k > 1),
parts AS (
  SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS x, array_to_string(ws[i + 1:], ' ') AS y FROM cand, unnest(range(1, k)) AS t(i)
),
scores AS (
  SELECT parts.lang, parts.phrase, a, i, fx.c AS l, fy.c AS r, CAST(2000000::HUGEINT * a // (fx.c + fy.c) AS BIGINT) AS score
  FROM parts JOIN f fx ON fx.lang = parts.lang AND fx.phrase = x JOIN f fy ON fy.lang = parts.lang AND fy.phrase = y
),
best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1),
inner_ AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longest FROM cand, unnest(range(2, k)) AS t(m), unnest(range(1, k - m + 2)) AS u(i) GROUP BY ALL
),
kept AS (
  SELECT best.* FROM best LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.phrase = best.phrase WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a
)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN n ON n.lang = kept.lang
QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": OP1, "op4_mixing": OP4, "op6_suffix_array_dedup": OP6, "op8_ngram_jaccard_join": OP8, "op9_chat_formatting": OP9, "op12_centroid_clustering": op12_sql(), "op13_phrase_mining": OP13}
