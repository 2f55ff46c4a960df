"""Registered queries of this subpackage; each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import chat, decontam, epsjoin, licenses, merkle, neardup, neural_lm, pagetext, pieces, secret_tags, tokenids, toxicity, whitening
from logquarry.llm.common import Scratch, read_table

TOKENIZER_DIR = "/opt/tokenizers"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.fit(docs.where(~held_out), read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumn("held_out", held_out)


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


ORACLES["op2_decontamination"] = r"""
WITH doc_words AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (
  SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM doc_words),
b AS (SELECT item_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS k FROM item_words),
same AS (SELECT doc_id, item_id, n, i - k AS start, k FROM d JOIN b USING (word)),
runs AS (
  SELECT doc_id, item_id, n, start, k - row_number() OVER (PARTITION BY doc_id, item_id, start ORDER BY k) AS run FROM same),
run_lengths AS (SELECT doc_id, item_id, n, start, run, count(*) AS c FROM runs GROUP BY ALL),
rated AS (
  SELECT doc_id, item_id, n, start, sum(c) AS matched, max(c) AS longest FROM run_lengths
  GROUP BY doc_id, item_id, n, start HAVING sum(c) * 100 >= 80 * n OR max(c) >= 13)
SELECT doc_id, item_id, CAST(n AS BIGINT) AS item_words, CAST(start AS BIGINT) AS start,
       CAST(matched AS BIGINT) AS matched, CAST(longest AS BIGINT) AS longest_run
FROM rated QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY matched DESC, start) = 1
"""


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], table.schema)
    return chat.digests(chat.format_conversations(table.union(probe)))


ORACLES["op3_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked AS (
  SELECT *, len(regexp_extract_all(role || text, '\\|</?s>|\[/?INST\]|\[/?ROLE\]')) AS marks,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM rows)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(role) + length(text) + marks + 20 + CASE WHEN role = 'assistant' THEN 0 ELSE 13 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""


@query
def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Scratch(spark).folder
    tokenids.write_ids(read_table(spark, sf_dir, "documents"), f"{TOKENIZER_DIR}/byte_bpe_50k.json", folder)
    return tokenids.read_ids(spark, folder, with_ids=False)


@query
def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsjoin.near_vectors(read_table(spark, sf_dir, "embeddings"))


ORACLES["op5_embedding_near_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fit AS (
  SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0 AND len(e) = (SELECT max(len(e)) FROM v)),
links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM fit x JOIN fit y ON x.vec_id <> y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
reach AS (SELECT DISTINCT a AS v, a AS r FROM links UNION SELECT b AS v, r FROM reach JOIN links ON v = a),
least_of AS (SELECT v, min(r) AS r FROM reach GROUP BY v),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(r, vec_id) AS component_id, coalesce(r, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id LEFT JOIN least_of ON v = vec_id
"""


@query
def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(f"{TOKENIZER_DIR}/piece_bpe_32k.model")
    return pieces.with_decoded_crc(pieces.encode(read_table(spark, sf_dir, "documents"), model), model)


@query
def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scored = neural_lm.score(read_table(spark, sf_dir, "documents"), ~held_out)
    return scored.withColumn("held_out", held_out)


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(read_table(spark, sf_dir, "documents"))


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = secret_tags.find_secrets(docs, secret_tags.fit(docs))
    names = F.array(*map(F.lit, secret_tags.KINDS))
    line = lambda c: F.array_join(
        F.transform(c, lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("bigint")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{secret_tags.KINDS[k]}") for k in range(3)],
        F.sha2(line("base"), 256).alias("base_sha256"),
        line("spans").alias("spans"),
    )


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"), neardup.Settings(width=2))


ORACLES["op10_minhash_near_dedup"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
  FROM words WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
rare AS (
  SELECT g, count(*) AS df FROM grams GROUP BY g),
prefix AS (
  SELECT doc_id, g, n FROM (
    SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS pos
    FROM grams JOIN sizes USING (doc_id) JOIN rare USING (g))
  WHERE pos <= n - (80 * n + 99) // 100 + 1),
pairs AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b
  FROM prefix x JOIN prefix y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)),
common AS (
  SELECT a, b, count(*) AS c
  FROM pairs JOIN grams x ON x.doc_id = a JOIN grams y ON y.doc_id = b AND x.g = y.g GROUP BY a, b),
links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT a AS v, a AS r FROM both_ways UNION
  SELECT b AS v, r FROM reach JOIN both_ways ON v = a),
least_of AS (SELECT v, min(r) AS r FROM reach GROUP BY v)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(r, doc_id) AS component_id,
       coalesce(r, doc_id) = doc_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_of ON v = doc_id
"""


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    manifest = merkle.build(docs, fields, "lang", "doc_id", {"n_chars": F.col("n_chars") + 1}, tampered)
    return manifest.proofs().withColumnRenamed("id", "doc_id")


def _leaf_sql(n_chars: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text"]
    return "sha256(" + " || ".join(f"coalesce(CAST(strlen({f}) AS VARCHAR) || ':' || {f}, '-')" for f in fields) + ")"


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("(n_chars + 1)")} AS other,
    list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
      lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)) AS crc
  FROM documents),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
         count(*) OVER (PARTITION BY lang) AS n FROM docs),
nodes AS (
  SELECT lang, CAST(0 AS BIGINT) AS level, CAST(pos AS BIGINT) AS pos, leaf AS h, CAST(n AS BIGINT) AS n FROM ranked
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, h AS subroot, CAST(row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS BIGINT) AS lang_pos,
         count(*) OVER () AS langs FROM nodes WHERE n = 1),
uppers AS (
  SELECT CAST(0 AS BIGINT) AS level, lang_pos AS pos, subroot AS h, langs AS n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2
  FROM uppers WHERE n > 1 GROUP BY level, pos // 2, n),
climb AS (
  SELECT lang, pos AS leaf_pos, CAST(0 AS BIGINT) AS level, CAST(pos AS BIGINT) AS pos, CAST(n AS BIGINT) AS n,
         CASE WHEN xor(crc, 4294967295) % 7 = 0 AND other IS NOT NULL THEN other ELSE leaf END AS folded, '' AS proof FROM ranked
  UNION ALL
  SELECT c.lang, leaf_pos, c.level + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 0 THEN folded || coalesce(h, '') ELSE h || folded END), proof || coalesce(h, '')
  FROM climb c LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM c.lang AND s.level = c.level AND s.pos = xor(c.pos, 1)
  WHERE c.n > 1),
upper_climb AS (
  SELECT c.lang, leaf_pos, CAST(0 AS BIGINT) AS level, lang_pos AS pos, langs AS n, folded, proof, subroot
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.n = 1
  UNION ALL
  SELECT c.lang, leaf_pos, c.level + 1, c.pos // 2, (c.n + 1) // 2,
         sha256(CASE WHEN c.pos % 2 = 0 THEN folded || coalesce(h, '') ELSE h || folded END), proof || coalesce(h, ''), subroot
  FROM upper_climb c LEFT JOIN uppers s ON s.level = c.level AND s.pos = xor(c.pos, 1) WHERE c.n > 1)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM ranked r JOIN upper_climb c ON c.lang IS NOT DISTINCT FROM r.lang AND c.leaf_pos = r.pos AND c.n = 1
CROSS JOIN (SELECT h FROM uppers WHERE n = 1)
"""


@query
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


@query
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract(read_table(spark, sf_dir, "pages"))
