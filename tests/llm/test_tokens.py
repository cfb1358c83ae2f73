import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from graphloom.llm import bpe, token_counts, token_files, wordtable

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def odd_texts(n):
    rng = random.Random(7)
    parts = ["the", "'ll", "'s", " ", "\t", "\x1c", "\x85", " ", "²", "½", "Σ", "İ", "ß", "é", "é", "漢", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|", "_", "##", "don't", "1234", "ﬀ", "Ǆ", "٣", "​"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 20))) for _ in range(n)]


def test_codec_is_the_library(library):
    words = bpe.codec(PATH)
    texts = odd_texts(800)
    flat, sizes = words.encode_batch(texts)
    decoded = words.decode(flat, sizes).to_pylist()
    for text, ids, back in zip(texts, np.split(flat, np.cumsum(sizes)[:-1]), decoded):
        want = ids_of(library, text)
        assert ids.tolist() == want, text
        assert back == library.decode(want, skip_special_tokens=False)


def test_merges_of_random_words_and_of_a_megabyte(library):
    rng, words = random.Random(2), bpe.WordCodec(PATH)
    texts = ["".join(rng.choice("abcdefghijklmnoprstuéß漢") for _ in range(rng.choice([1, 3, 9, 30, 63, 64, 65, 200, 3000]))) for _ in range(300)]
    flat, sizes = words.encode_batch(texts)
    for text, ids in zip(texts, np.split(flat, np.cumsum(sizes)[:-1])):
        assert ids.tolist() == ids_of(library, text)
    began = time.time()
    flat, sizes = words.encode_batch(["abcde" * 200_000])
    assert time.time() - began < 60 and flat[-1] < 49408 and sizes[0] > 100_000
    assert flat[:1000].tolist() == ids_of(library, "abcde" * 10_000)[:1000]


def test_a_full_table_of_words_starts_anew(library, monkeypatch):
    monkeypatch.setattr(wordtable, "MOST_BYTES", 4000)
    words, texts = bpe.WordCodec(PATH), odd_texts(200)
    for at in range(0, 200, 20):
        flat, sizes = words.encode_batch(texts[at : at + 20])
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [ids_of(library, t) for t in texts[at : at + 20]]
        assert words.table.bytes < 40_000


def test_speculation_needs_merging_for_some_words_only():
    words = bpe.WordCodec(PATH)
    vocabulary = [w.removesuffix("</w>") for w in words.vocab if w.isascii() and w.endswith("</w>") and w[:-4].isalpha()][:3000]
    words.encode_words(vocabulary)
    assert 0 <= words.merged < words.proposed == 3000


def test_encode(docs, none, texts, library):
    got = sorted((r["doc_id"] or 0, r["n_tokens"], bytes(r["ids"]), r["decoded"]) for r in bpe.encode(docs, PATH).collect())
    want = []
    for i, t in texts:
        ids = ids_of(library, t)
        want.append((i or 0, len(ids), np.array(ids, "<u4").tobytes(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want)
    assert bpe.encode(none, PATH).count() == 0


def test_files(spark, docs, none, texts, library, tmp_path):
    out = f"file://{tmp_path}/a"
    token_files.write(docs, out, PATH, files=3)
    got = [tuple(r) for r in token_files.with_crc32(token_files.read(spark, out)).orderBy("start").collect()]
    assert [r[0] or 0 for r in got] == sorted(i or 0 for i, _ in texts)
    start, want = 0, {}
    for i, t in texts:
        ids = [*ids_of(library, t), 1]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc, at, n, crc in got:
        assert at == start and (n, crc) in want[doc]
        start += n
    one = token_files.read(spark, out, [7]).collect()
    assert [(r["doc_id"], r["start"]) for r in one] == [(7, next(r[1] for r in got if r[0] == 7))]
    # stripes, row index and Bloom filter are there, and a filter on doc_id reads them
    many = spark.range(20_000).selectExpr("id * 2 as doc_id", "concat('word ', id) as text")
    token_files.write(many, f"file://{tmp_path}/c", PATH, files=2)
    names = [p for p in os.listdir(f"{tmp_path}/c") if p.endswith(".orc")]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    rows = 0
    for name in names:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"{tmp_path}/c/{name}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        rows += reader.getNumberOfRows()
        assert reader.getRowIndexStride() == 5000 and reader.getStripes().size() >= 1 and str(reader.getCompressionKind()) == "ZSTD"
        kinds = {str(x.getKind()) for x in reader.rows().readStripeFooter(reader.getStripes().get(0)).getStreamsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
    assert rows == 20_000 and len(names) == 2
    found = token_files.read(spark, f"file://{tmp_path}/c", [7000, 7001])
    assert [r["doc_id"] for r in found.collect()] == [7000] and "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
    token_files.write(none, f"file://{tmp_path}/b", PATH, files=2)
    assert token_files.read(spark, f"file://{tmp_path}/b").count() == 0


def brute_unigram(model, word):
    best = [(0.0, 0)] + [None] * len(word)
    for j in range(1, len(word) + 1):
        options = [(best[i][0] + model.scores[word[i:j]], best[i][1] - 1) for i in range(j) if word[i:j] in model.scores]
        if word[j - 1] not in model.scores:
            n = len(word[j - 1].encode())
            options.append((best[j - 1][0] + n * model.byte_score, best[j - 1][1] - n))
        best[j] = max(options)
    return -best[-1][1]


def test_token_counts(docs, none, texts):
    model = token_counts.UnigramTrie.load(PIECES)
    short = [(i, t) for i, t in texts if t is None or len(t) < 6000]
    want = sorted((i or 0, len(token_counts.split(t)), sum(brute_unigram(model, "▁" + w) for w in token_counts.split(t))) for i, t in short)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in token_counts.count(docs, PIECES).collect())
    assert [g for g in got if g[0] not in (9, 11)] == [w for w in want if w[0] not in (9, 11)]
    assert token_counts.count(none, PIECES).count() == 0


def test_trie_shares_prefixes_and_agrees_with_a_library():
    model = token_counts.UnigramTrie.load(PIECES)
    words = ["▁in", "▁inter", "▁internal", "▁internet", "▁interval"]
    for w in words:
        model.count(w)
    assert model.made == len({w[:i] for w in words for i in range(1, len(w) + 1)})
    pieces = [("<unk>", -100.0), *model.scores.items()]
    library = Unigram(pieces, 0, False)
    for w in [*words, "▁thandendonwh", "▁erschheiten"]:
        assert model.count(w) == len(library.tokenize(w))


def test_counts_are_near_those_of_the_library():
    import pyarrow.parquet as pq
    import sentencepiece

    model, library = token_counts.UnigramTrie.load(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()[:150]
    got = np.array([sum(model.count("▁" + w) for w in token_counts.split(t)) for t in texts])
    want = np.array([len(library.encode(t or "")) for t in texts])
    long = want > 20
    assert abs(got.sum() / want.sum() - 1) < 0.01 and np.abs(got[long] / want[long] - 1).mean() < 0.03
