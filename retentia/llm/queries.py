"""The registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from ..session import staging_path
from . import balltree, bpe, chat, exact_dedup, hilbert, langid, merkle, minhash, packing, phrases, substring_dedup, token_counts, toxicity
from .frames import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balltree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score  -- exact: far below 2 ** 53
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x20\x09-\x0D]+') if x <> ''] AS l FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(l) > 1 THEN [l[i] || ' ' || l[i + 1] for i in range(1, len(l))] ELSE l END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  WHERE 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT l.v, r.root FROM reach r JOIN link l ON l.u = r.node
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.root) AS component_id, d.doc_id = min(r.root) AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r ON r.node = d.doc_id GROUP BY d.doc_id, n.n
"""


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(own).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.examples(turns))


_ESC = r"regexp_replace(coalesce({0}, ''), '(\\*)(</?s>|\[/?(?:ROLE|INST|SYS)\])', '\\\1\2', 'g')"
OP4_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, coalesce(role = 'assistant', false) AS reply,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k,
         count(*) OVER (PARTITION BY conv_id) AS n,
         length({_ESC.format('role')}) + length({_ESC.format('text')}) + {chat.MARKS} AS chars
  FROM t
), c AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY k) AS upto FROM o
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE reply), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE reply), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (WHERE reply OR k = n) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(cut).withColumn("length", F.col("length").cast("long"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.decisions(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP6_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM n
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(table(spark, sf_dir, "documents"))


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs, window=13).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+') if x <> ''] AS l FROM documents
), p AS (
  SELECT doc_id, unnest(range(1, len(l) - 11)) AS i, l FROM w
), g AS (
  SELECT doc_id, i, array_to_string(l[i:i + 12], ' ') AS t FROM p
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first_id FROM g) WHERE doc_id > first_id
), k AS (
  SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS word FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS t, count(*) AS n FROM k ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id
)
SELECT w.doc_id, len(l) AS n_words, CAST(len(l) - coalesce(kept.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 2 == 0
    made = merkle.manifest(table(spark, sf_dir, "documents"), F.when(even, F.replace("text", F.lit("\n"), F.lit(""))))
    hexed = [merkle.hexed(F.col(c)).alias(n) for c, n in (("leaf", "leaf"), ("subroot", "subroot"), ("root", "root"), ("proof", "proof_sha256"),
                                                          ("folded_root", "folded_root"))]
    return made.select("doc_id", *hexed, "verified")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS p FROM documents
), w AS (
  SELECT lang, [x for x in regexp_split_to_array(p, '[\x20\x09]+') if x <> ''] AS l FROM p
), o AS (
  SELECT lang, l, k, unnest(range(1, len(l) - k + 2)) AS i FROM w, (VALUES (1), (2), (3), (4)) AS v(k) WHERE len(l) >= k
), f AS (
  SELECT lang, l[i:i + k - 1] AS g, count(*) AS f FROM o GROUP BY ALL
), n AS (
  SELECT lang, sum(f) AS n FROM f WHERE len(g) = 1 GROUP BY lang
), c AS (
  SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 30
), inside AS (
  SELECT lang, g[i:j] AS g, max(a) AS most
  FROM (SELECT lang, g, a, i, unnest(range(i + 1, len(g) + 1)) AS j FROM (SELECT *, unnest(range(1, len(g))) AS i FROM c WHERE len(g) > 2))
  WHERE j - i + 1 < len(g) GROUP BY ALL
), kept AS (
  SELECT c.* FROM c LEFT JOIN inside USING (lang, g) WHERE most IS NULL OR 100 * most < 80 * a
), cut AS (
  SELECT x.lang, x.g, a, k, y.f AS l, z.f AS r, (2000000::HUGEINT * a) // (y.f + z.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM kept) x
  JOIN f y ON y.lang = x.lang AND y.g = x.g[1:k] JOIN f z ON z.lang = x.lang AND z.g = x.g[k + 1:len(x.g)]
), low AS (
  SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM low
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

OP11_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS id, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head
  FROM documents
), crc AS (
  -- CRC-32 of the decimal doc_id, bit by bit
  SELECT doc_id, id, 0 AS pos, 4294967295 AS c FROM (SELECT DISTINCT doc_id, id FROM d WHERE id IS NOT NULL)
  UNION ALL
  SELECT doc_id, id, pos + 1,
         list_reduce(list_prepend(xor(c, CAST(ascii(id[pos + 1]) AS BIGINT)), [0, 0, 0, 0, 0, 0, 0, 0]),
                     lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
  FROM crc WHERE pos < strlen(id)
), even AS (
  SELECT doc_id FROM crc WHERE pos = strlen(id) AND xor(c, 4294967295) % 2 = 0
), leaf AS (
  SELECT d.doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN even.doc_id IS NULL THEN leaf ELSE sha256(head || coalesce(strlen(t) || ':' || t, '-')) END AS other
  FROM (SELECT *, replace(text, chr(10), '') AS t FROM d) d LEFT JOIN even ON even.doc_id = d.doc_id
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY source) AS size FROM leaf
), node AS (
  SELECT source, 0 AS level, place, size, leaf AS digest FROM placed
  UNION ALL
  SELECT source, level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM node WHERE size > 1
  GROUP BY source, level, place // 3, size
), sub AS (
  SELECT source, digest AS subroot, max(level) OVER () + 1 AS base, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth, count(*) OVER () AS n
  FROM node WHERE size = 1
), over_node AS (
  SELECT base AS level, nth AS place, n AS size, subroot AS digest FROM sub
  UNION ALL
  SELECT level + 1, place // 3, (size + 2) // 3, sha256(string_agg(digest, '' ORDER BY place)) FROM over_node WHERE size > 1
  GROUP BY level, place // 3, size
), root AS (SELECT digest AS root FROM over_node WHERE size = 1
), lower_steps AS (
  SELECT a.source, a.level, a.place, a.size, string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place) AS l,
         string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place) AS r
  FROM node a JOIN node b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.size > 1 GROUP BY ALL
), upper_steps AS (
  SELECT a.level, a.place, string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place < a.place) AS l,
         string_agg(b.digest, '' ORDER BY b.place) FILTER (WHERE b.place > a.place) AS r
  FROM over_node a JOIN over_node b ON a.level = b.level AND a.place // 3 = b.place // 3
  WHERE a.size > 1 GROUP BY ALL
), climb AS (
  SELECT doc_id, source, leaf, 0 AS level, place, size, other AS acc, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.level + 1, c.place // 3, (c.size + 2) // 3, sha256(coalesce(s.l, '') || c.acc || coalesce(s.r, '')),
         c.proof || coalesce(s.l, '') || coalesce(s.r, '')
  FROM climb c JOIN lower_steps s ON c.source IS NOT DISTINCT FROM s.source AND c.level = s.level AND c.place = s.place
), climb2 AS (
  SELECT doc_id, leaf, subroot, base AS level, nth AS place, n AS size, acc, proof
  FROM climb c JOIN sub ON c.source IS NOT DISTINCT FROM sub.source WHERE c.size = 1
  UNION ALL
  SELECT c.doc_id, c.leaf, c.subroot, c.level + 1, c.place // 3, (c.size + 2) // 3, sha256(coalesce(s.l, '') || c.acc || coalesce(s.r, '')),
         c.proof || coalesce(s.l, '') || coalesce(s.r, '')
  FROM climb2 c JOIN upper_steps s ON c.level = s.level AND c.place = s.place
)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = root AS verified
FROM climb2, root WHERE size = 1
"""


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each run of the query starts a cache of its own, so that its work is that of the given table.
    cache = staging_path(spark, "token_counts")
    return token_counts.count(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache)


QUERIES: dict[str, tuple] = {
    "op1_toxicity": (op1_toxicity, None),
    "op2_ball_tree": (op2_ball_tree, OP2_SQL),
    "op3_minhash": (op3_minhash, OP3_SQL),
    "op4_chat_format": (op4_chat_format, OP4_SQL),
    "op5_pack": (op5_pack, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6_SQL),
    "op7_bpe": (op7_bpe, None),
    "op8_langid": (op8_langid, None),
    "op9_hilbert_shards": (op9_hilbert_shards, None),
    "op10_recompression": (op10_recompression, OP10_SQL),
    "op11_merkle": (op11_merkle, OP11_SQL),
    "op12_phrases": (op12_phrases, OP12_SQL),
    "op13_token_counts": (op13_token_counts, None),
}
