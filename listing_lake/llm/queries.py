"""The training-data queries: given tables in, digest columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import uuid

import public_tokenizers

from listing_lake.llm import byte_bpe, collocations, fingerprints, language_id, line_dedup, lm_scoring, merkle, ngram_join, packing, quality_classifier, quality_rules, sharding, warc
from listing_lake.llm.common import as_content, settled
from listing_lake.session import configure, materialize, shared_dir

# Loss-bearing tokens of a packed sequence: the first lines, prompts, are more than a sixteenth of all tokens.
MAX_LOSS = 3_840
MERKLE_FIELDS = ("content_id", "source", "sourceLanguage", "n_chars", "summary")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_content(table(spark, sf_dir, "documents"))


def residue(content_id: str, m: int):
    """crc32 of an id as text, modulo m."""
    return F.pmod(F.crc32(F.col(content_id).cast("string").cast("binary")), F.lit(m))


WORDS_SQL = r"list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

RULES_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, {WORDS_SQL} AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM t
),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i,
    unnest(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) AS k
  FROM w WHERE len(words) >= 5
),
starts AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS at FROM starts) GROUP BY doc_id
),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '\P{{L}}+', '', 'g')) AS n_letters, length(regexp_replace(text, '\P{{Lu}}+', '', 'g')) AS n_upper,
    len(list_filter(range(2, len(words) + 1), lambda i: words[i] = words[i - 1])) AS n_echo_words
  FROM w LEFT JOIN covered c ON w.doc_id = c.doc_id
),
f AS (
  SELECT *,
    (CASE WHEN n_words < 10 THEN 1 ELSE 0 END) + (CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END)
    + (CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END) + (CASE WHEN 2 * n_upper > n_letters THEN 8 ELSE 0 END)
    + (CASE WHEN n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines THEN 16 ELSE 0 END)
    + (CASE WHEN word_chars > 20 * n_words OR word_chars < 2 * n_words THEN 32 ELSE 0 END)
    + (CASE WHEN 100 * n_echo_words > 20 * n_words THEN 64 ELSE 0 END)
    + (CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END) AS failed
  FROM m
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed = 0 AS kept, CAST(failed AS BIGINT) AS failed
FROM f
"""

LINES_SQL = r"""
WITH t AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM t
),
shared AS (
  SELECT key, max(doc_id) AS kept_in FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
),
j AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id <> s.kept_in AS lost FROM k LEFT JOIN shared s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(lost AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM j GROUP BY doc_id
"""


PAGES_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
d AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(hex, CAST(i // 8 * 10 + 1 AS BIGINT), 10) AS BIGINT) >> CAST(35 - i % 8 * 5 AS INT)) & 31 AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> response THEN response END AS refers_to
FROM d
"""


def _framed_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_framed_sql(v) for v in ("doc_id", "source", "lang", n_chars, "text")) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE sums AS (
  SELECT *, list_reduce(
    [4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
  FROM documents
),
leaves AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END AS tree, {_leaf_sql('n_chars')} AS leaf,
    CASE WHEN xor(crc, 4294967295) % 7 = 0 THEN {_leaf_sql('(n_chars + 1)')} ELSE {_leaf_sql('n_chars')} END AS presented
  FROM sums
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves
),
inner_nodes AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM inner_nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
subroots AS (
  SELECT tree, digest, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM inner_nodes WHERE n = 1
),
top_nodes AS (
  SELECT '' AS tree, 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT tree, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
  FROM top_nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
),
nodes AS (SELECT * FROM inner_nodes UNION ALL SELECT * FROM top_nodes),
walk AS (
  SELECT doc_id, tree, 0 AS level, pos, n, presented AS digest, '' AS siblings FROM placed
  UNION ALL
  SELECT w.doc_id, CASE WHEN w.n > 1 THEN w.tree ELSE '' END, CASE WHEN w.n > 1 THEN w.level + 1 ELSE 0 END,
    CASE WHEN w.n > 1 THEN w.pos // 2 ELSE r.pos END, CASE WHEN w.n > 1 THEN (w.n + 1) // 2 ELSE r.n END,
    CASE WHEN w.n = 1 THEN w.digest WHEN w.pos % 2 = 1 THEN sha256(s.digest || w.digest) ELSE sha256(w.digest || coalesce(s.digest, '')) END,
    w.siblings || CASE WHEN w.n > 1 THEN coalesce(s.digest, '') ELSE '' END
  FROM walk w
  LEFT JOIN nodes s ON w.tree = s.tree AND w.level = s.level AND xor(w.pos, 1) = s.pos
  LEFT JOIN subroots r ON w.tree = r.tree
  WHERE w.n > 1 OR w.tree <> ''
)
SELECT p.doc_id, p.leaf, r.digest AS subroot, t.digest AS root, sha256(w.siblings) AS proof_sha256, w.digest AS folded_root,
  w.digest = t.digest AS verified
FROM placed p JOIN subroots r ON p.tree = r.tree
JOIN walk w ON p.doc_id = w.doc_id AND w.tree = '' AND w.n = 1
JOIN top_nodes t ON t.n = 1
"""

PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM p),
sizes AS (SELECT unnest(range(1, 6)) AS size),
g AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM w, sizes WHERE len(words) >= size
),
f AS (SELECT lang, phrase, any_value(size) AS size, count(*) AS a FROM g GROUP BY lang, phrase HAVING count(*) >= 100),
t AS (SELECT lang, sum(len(words)) AS n FROM w GROUP BY lang),
cuts AS (
  SELECT lang, phrase, a, unnest(range(1, size)) AS k, string_split(phrase, ' ') AS words FROM f WHERE size > 1
),
scored AS (
  SELECT c.lang, c.phrase, c.a, h.a AS l, r.a AS r, t.n, k, CAST(1000 * CAST(c.a AS HUGEINT) * t.n // (CAST(h.a AS HUGEINT) * r.a) AS BIGINT) AS score
  FROM cuts c JOIN f h ON c.lang = h.lang AND array_to_string(words[1:k], ' ') = h.phrase
  JOIN f r ON c.lang = r.lang AND array_to_string(words[k + 1:], ' ') = r.phrase
  JOIN t ON c.lang = t.lang
),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(words[i:j], ' ') AS phrase, max(a) AS cover
  FROM (SELECT *, unnest(range(i + 1, len(words) + 1)) AS j FROM (
    SELECT lang, a, words, unnest(range(1, len(words))) AS i FROM (SELECT lang, a, string_split(phrase, ' ') AS words FROM f WHERE size > 2)))
  WHERE j - i + 1 < len(words) GROUP BY 1, 2
),
kept AS (SELECT b.* FROM best b LEFT JOIN inside i ON b.lang = i.lang AND b.phrase = i.phrase WHERE i.cover IS NULL OR 100 * i.cover < 100 * b.a)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) WHERE rank <= 2000
"""


@query("op1_feistel_shards")
def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts."""
    dealt = sharding.shard_content(_content(spark, sf_dir), shards=16)
    return dealt.select(
        F.col("content_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )


@query("op2_rule_ledger", RULES_SQL)
def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the newest policy."""
    rules = quality_rules
    judged = rules.apply_policies(rules.rule_ledger(_content(spark, sf_dir)))
    return judged.select(
        F.col("content_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~rules.passes(rules.BASE)).alias("base_failed"), F.col(f"kept_v{max(rules.POLICIES)}").alias("kept"), "failed",
    )


@query("op3_quadratic_discriminant")
def op3_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labelled rows outside the held-out fold."""
    content = _content(spark, sf_dir)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("content_id"), "quality").where(residue("content_id", 5) != 0)
    model = quality_classifier.fit(quality_classifier.text_statistics(quality_classifier.labelled_sample(content, labels)), labels)
    statistics = quality_classifier.text_statistics(content).select("content_id", "statistics")
    return quality_classifier.score_quality(statistics, model).select(
        F.col("content_id").alias("doc_id"), (residue("content_id", 5) == 0).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


@query("op8_shared_lines", LINES_SQL)
def op8_shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that other documents keep."""
    left = line_dedup.drop_shared_lines(_content(spark, sf_dir), min_chars=20, min_rows=3)
    return left.select(F.col("content_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("summary").cast("binary"), 256).alias("kept_sha256"))


@query("op4_sentencepiece_bytes")
def op4_sentencepiece_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by the byte-level vocabulary, and what they decode to."""
    coded = byte_bpe.digest_content(
        _content(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.withColumnRenamed("content_id", "doc_id")


@query("op9_vector_packing")
def op9_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4,096 tokens, at most `MAX_LOSS` of them beyond the first lines, which are prompts."""
    prompted = packing.with_prompts(_content(spark, sf_dir))
    packed = packing.pack_content(prompted, public_tokenizers.path("word_bpe_49k.json"), max_loss=MAX_LOSS)
    return packed.withColumnRenamed("content_id", "doc_id")


@query("op10_chunked_records", PAGES_SQL)
def op10_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records in chunks, and read back."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(table(spark, sf_dir, "pages"), path, least_bytes=0)
    return warc.resolve(warc.read_records(spark, path))


@query("op6_prefix_join")
def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents."""
    groups = ngram_join.near_duplicates(_content(spark, sf_dir), width=5, percent=80)
    return groups.select(F.col("content_id").alias("doc_id"), "n_shingles", "component_id")


@query("op7_lexicon_fingerprints")
def op7_lexicon_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and how alike they are to those of the edit and of the next document."""
    content = _content(spark, sf_dir)
    spliced = fingerprints.splice_next(content).withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    coded = materialize(fingerprints.fingerprint_columns(spliced, fingerprints.lexicon(content), "summary", "edited"), "coded")
    following = coded.select(F.col("content_id").alias("next_id"), F.col("summary").alias("following"))
    return coded.join(following, "next_id").select(
        F.col("content_id").alias("doc_id"), "n_chars", "edited_sha256",
        fingerprints.as_text(F.col("summary")).alias("fingerprint"), fingerprints.as_text(F.col("edited")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("summary"), F.col("edited")).alias("near_edited"),
        fingerprints.likeness(F.col("summary"), F.col("following")).alias("near_next"),
    )


@query("op5_attention_scores")
def op5_attention_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents, learnt outside the held-out fold."""
    scored = lm_scoring.score_content(
        _content(spark, sf_dir), residue("content_id", 7) != 2, public_tokenizers.path("byte_bpe_50k.json"))
    return scored.select(
        F.col("content_id").alias("doc_id"), (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_forward_manifest", MANIFEST_SQL)
def op11_forward_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of all documents; every seventh by checksum is verified with a changed length."""
    content = table(spark, sf_dir, "documents").withColumnsRenamed({"doc_id": "content_id", "lang": "sourceLanguage", "text": "summary"})
    tampered = merkle.field_hash(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in MERKLE_FIELDS])
    presented = F.when(F.coalesce(residue("content_id", 7) == 0, F.lit(False)), tampered)
    sealed = merkle.manifest(content.withColumn("presented", presented), MERKLE_FIELDS, "sourceLanguage", keep=("presented",))
    return sealed.select(
        F.col("content_id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof_digest(F.col("proof")).alias("proof_sha256"),
        settled(merkle.fold(F.coalesce("presented", "leaf"), F.col("proof"))).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language of all documents."""
    content = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("content_id"), F.col("text").alias("summary"), F.col("lang").alias("sourceLanguage"))
    return collocations.mine_phrases(content, min_count=100, longest=5, share=100, top=2000)


@query("op12_ftrl_language")
def op12_ftrl_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learnt outside the held-out fold."""
    content = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("content_id"), F.col("text").alias("summary"), F.col("lang").alias("sourceLanguage"))
    model = language_id.fit(content.where(residue("content_id", 3) != 1))
    return language_id.predict(content.select("content_id", "summary"), model).select(
        F.col("content_id").alias("doc_id"), (residue("content_id", 3) == 1).alias("held_out"), "lang_pred", "score")
