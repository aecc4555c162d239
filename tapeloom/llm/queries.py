"""The registered queries of this subpackage: thin, with production parameters, over whole tables; and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import alignment, bpe, decontam, html, packing, phrases, pii, quality, simhash, substrings, token_count, vectors, warc

TOKENIZER, RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_multi_50k.tiktoken", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def listed(kinds: tuple[str, ...]) -> Column:
        own = F.filter("spans", lambda s: s["kind"].isin(*kinds))
        return F.array_join(F.transform(own, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(listed(pii.BASE), 256).alias("base_sha256"), listed(pii.KINDS).alias("spans"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.octet_length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = public_tokenizers.path(RANKS)
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), file, public_tokenizers.PATTERN), file, public_tokenizers.PATTERN)
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))
    digest = F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_packing, op3_warc, op4_decontam, op5_quality, op6_html, op7_tokens, op8_substrings, op9_vectors, op10_simhash, op11_bpe, op12_alignment, op13_phrases)}


#: Base 32 by hand: 40 bits, ten hexadecimal digits, are eight letters.
OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT *, [CAST('0x' || substr(sha1(html), 1 + 10 * i, 10) AS BIGINT) FOR i IN [0, 1, 2, 3]] AS parts FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((parts[1 + k // 8] >> (35 - 5 * (k % 8))) & 31) AS BIGINT), 1) FOR k IN range(32)], '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""


#: All pairs: for small tables.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT * FROM v WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS id, vec_id AS c FROM v UNION SELECT l.a, r.c FROM r JOIN l ON r.id = l.b),
m AS (SELECT id, min(c) AS component_id FROM r GROUP BY id), k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, CAST(coalesce(k.n, 0) AS BIGINT) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN m ON m.id = v.vec_id LEFT JOIN k ON k.a = v.vec_id
"""


OP13_SQL = r"""
WITH p AS (SELECT lang, row_number() OVER () AS id, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p WHERE len(w) > 0 GROUP BY lang),
o AS (SELECT lang, id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM p),
q AS (SELECT lang, w AS w1, lead(w, 1) OVER x AS w2, lead(w, 2) OVER x AS w3, lead(w, 3) OVER x AS w4 FROM o WINDOW x AS (PARTITION BY id ORDER BY i)),
f AS (SELECT lang, 1 AS k, w1 AS phrase, count(*) AS f FROM q GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 AS phrase, count(*) FROM q WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 AS phrase, count(*) FROM q WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 AS phrase, count(*) FROM q WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score, j.j
  FROM c JOIN (VALUES (1), (2), (3)) AS j(j) ON j.j < c.k
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[:j.j], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j.j + 1:], ' ')),
m AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
t AS (SELECT c.lang, array_to_string(c.w[i.i:i.i + z.z - 1], ' ') AS phrase, max(c.a) AS longer FROM c JOIN (VALUES (2), (3)) AS z(z) ON z.z < c.k JOIN (VALUES (1), (2), (3)) AS i(i) ON i.i + z.z - 1 <= c.k GROUP BY ALL),
b AS (SELECT m.*, row_number() OVER (PARTITION BY m.lang ORDER BY m.score DESC, m.a DESC, m.phrase) AS rank FROM m LEFT JOIN t ON t.lang = m.lang AND t.phrase = m.phrase
  WHERE t.longer IS NULL OR CAST(t.longer AS HUGEINT) * 100 < CAST(m.a AS HUGEINT) * 80)
SELECT b.lang, b.rank, b.phrase, b.a, b.l, b.r, n.n, b.score FROM b JOIN n ON n.lang = b.lang WHERE b.rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the archive, the vectors and the phrases; the other queries need a tokenizer, XXH64, a trained network, HTML or long windows of bytes."""
    return {"op3_warc": OP3_SQL, "op9_vectors": OP9_SQL, "op13_phrases": OP13_SQL}
