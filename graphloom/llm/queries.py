"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, jaccard, lexical, licenses, passages, quality_model, quality_rules, sharding, token_counts, token_files, toxicity, vector_codes
from .workspace import new_path, table

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_model.train(docs, table(spark, sf_dir, "labels"))
    held_out = (~quality_model.not_held_out()).alias("held_out")
    return quality_model.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and unigram tokens of every whole text."""
    return token_counts.count(table(spark, sf_dir, "documents"), PIECES)


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each document that an earlier one has."""
    return passages.find(table(spark, sf_dir, "documents"))


def op4_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text and the text decoded from them, as digests."""
    out = bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every whole text."""
    return jaccard.join(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).drop("text")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every whole text and the verdict of the risk-controlled rules."""
    out = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents: one row for each document and item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.flag(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return found.select("doc_id", "leak.item_id", "leak.n_item", "leak.n_shared", (F.col("leak.n_shared") / F.col("leak.n_item")).alias("containment"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all token ids to ORC and read them back."""
    path = new_path(spark, "tokens")
    token_files.write(table(spark, sf_dir, "documents"), path, WORD_BPE)
    return token_files.with_crc32(token_files.read(spark, path))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences and licences of every document that has some."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every kept vector under codebooks of two rounds."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = vector_codes.fit(vectors)
    coded = vector_codes.with_label_error(vector_codes.encode(vectors, books))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight contiguous shards of nearly equal bytes over all documents."""
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", sharding.text_bytes().alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard(sizes, 8).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    items = table(spark, sf_dir, "benchmark")
    found = lexical.index(table(spark, sf_dir, "documents"), items)
    return lexical.search(found, items).withColumnRenamed("key", "doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": op1_quality_model,
    "op2_token_counts": op2_token_counts,
    "op3_passages": op3_passages,
    "op4_bpe_encoding": op4_bpe_encoding,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_toxicity": op6_toxicity,
    "op7_quality_rules": op7_quality_rules,
    "op8_decontamination": op8_decontamination,
    "op9_token_files": op9_token_files,
    "op10_licenses": op10_licenses,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharding": op12_sharding,
    "op13_lexical_search": op13_lexical_search,
}

_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_SHINGLES_SQL = """SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM (SELECT {key}, {words} AS w FROM {table})"""
_DOCS_SQL = _SHINGLES_SQL.format(key="doc_id", words=_WORDS_SQL, table="documents")

_TERMS_SQL = r"""SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(regexp_extract_all(
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM {table}) GROUP BY ALL"""


def _assigned(i: int) -> str:
    """Nearest entry of every part under the codebooks of round i."""
    return f"""a{i} AS MATERIALIZED (SELECT vec_id, p, v, arg_min(e, [d, e]) AS e, min(d) AS d
  FROM (SELECT parts.vec_id, parts.p, parts.v, b.e, list_sum(list_transform(list_zip(parts.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
    FROM parts JOIN b{i} b ON b.p = parts.p) GROUP BY ALL)"""


def _updated(i: int) -> str:
    """Codebooks after round i: floors of means; entries without parts stay."""
    return f"""b{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{i} b LEFT JOIN
  (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY c) AS v FROM (SELECT p, e, c, sum(v[c]) AS s, count(*) AS n FROM a{i}, unnest(range(1, len(v) + 1)) AS u(c) GROUP BY ALL) GROUP BY p, e) m
  ON m.p = b.p AND m.e = b.e)"""


ORACLE_SQL: dict[str, str] = {
    "op11_vector_codes": f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS v FROM kept, unnest(range(16)) AS u(p)),
b0 AS MATERIALIZED (SELECT p, dense_rank() OVER (ORDER BY vec_id) - 1 AS e, v FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_assigned(0)}, {_updated(0)}, {_assigned(1)}, {_updated(1)}, {_assigned(2)},
coded AS MATERIALIZED (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded JOIN kept USING (vec_id), books""",
    "op12_sharding": """WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size,
  xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: CAST('0x' || h AS BIGINT))),
    lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, 3988292384 * (r & 1))))) AS text_crc32 FROM documents),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size AS start, sum(size) OVER () AS total FROM d),
p AS (SELECT *, CAST((2 * start + size) * 8 // (2 * total) AS INTEGER) AS shard FROM s)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM p""",
    "op13_lexical_search": f"""WITH d AS MATERIALIZED ({_TERMS_SQL.format(key="doc_id", table="documents")}), i AS ({_TERMS_SQL.format(key="item_id", table="benchmark")}),
lengths AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths),
w AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM d GROUP BY term), total),
hits AS (SELECT item_id, doc_id, i.tf * w * ((1000000000 * d.tf) // (1000 * d.tf + 8 * (25 + (75 * n * docs) // words))) AS s FROM i JOIN w USING (term) JOIN d USING (term) JOIN lengths USING (doc_id), total),
scores AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM hits GROUP BY ALL HAVING sum(s) > 0)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores QUALIFY rank <= 10""",
    "op5_jaccard_join": f"""WITH RECURSIVE d AS MATERIALIZED ({_DOCS_SQL}),
n AS MATERIALIZED (SELECT documents.doc_id, count(s) AS n FROM documents LEFT JOIN d USING (doc_id) GROUP BY ALL),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM d x JOIN d y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n m ON m.doc_id = p.a JOIN n o ON o.doc_id = p.b WHERE 100 * k >= 80 * (m.n + o.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT links.b, r FROM reach JOIN links ON links.a = reach.doc_id)
SELECT doc_id, any_value(n) AS n_shingles, min(r) AS component_id FROM reach JOIN n USING (doc_id) GROUP BY doc_id""",
    "op8_decontamination": f"""WITH d AS ({_DOCS_SQL}), i AS ({_SHINGLES_SQL.format(key="item_id", words=_WORDS_SQL, table="benchmark")}),
size AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id)
SELECT doc_id, item_id, CAST(any_value(n) AS INTEGER) AS n_item, CAST(count(*) AS INTEGER) AS n_shared, CAST(count(*) AS DOUBLE) / any_value(n) AS containment
FROM d JOIN i USING (s) JOIN size USING (item_id) GROUP BY doc_id, item_id HAVING 100 * count(*) >= 80 * any_value(n)""",
}
