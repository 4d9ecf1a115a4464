"""Cross-tokenizer alignment and exact top-k search against brute-force versions."""

import hashlib
import os
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyspark.llm import token_alignment, topk_search
from tallyspark.llm.slices import slices

SF = "/root/testdata/sf0.001"
A_FILE = public_tokenizers.path("byte_bpe_50k.json")
B_FILE = public_tokenizers.path("piece_bpe_32k.model")


def _plain_tokens(text):
    """Token byte ranges of both sides, one token at a time."""
    a = Tokenizer.from_file(A_FILE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B_FILE)
    alphabet = token_alignment._byte_alphabet()
    want = (" " + text).encode()
    a_ids = a.encode(" " + text, add_special_tokens=False).ids
    a_bytes = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in a_ids]
    b_ids = b.encode(text)
    b_bytes = []
    for i in b_ids:
        piece = b.id_to_piece(i)
        b_bytes.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
        return None

    def ranges(parts):
        out, at = [], 0
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    return a_ids, ranges(a_bytes), b_ids, ranges(b_bytes)


def _plain_align(rows):
    docs = []
    for doc_id, text in rows:
        t = _plain_tokens(text or "")
        if t is None:
            docs.append((doc_id, None))
            continue
        a_ids, ra, b_ids, rb = t
        links = [(a_ids[i], b_ids[j]) for i, x in enumerate(ra) for j, y in enumerate(rb) if x[0] < y[1] and y[0] < x[1]]
        common = sorted({e for _, e in ra} & {e for _, e in rb})
        groups = []
        for g, end in enumerate(common):
            lo = common[g - 1] if g else 0
            ga = [str(a_ids[i]) for i, x in enumerate(ra) if lo < x[1] <= end]
            gb = [str(b_ids[j]) for j, y in enumerate(rb) if lo < y[1] <= end]
            groups.append(",".join(ga) + "|" + ",".join(gb))
        docs.append((doc_id, (len(a_ids), len(b_ids), len(common), links, ";".join(groups))))
    count = Counter(p for _, d in docs if d for p in set(d[3]))
    most = Counter()
    for (a, _), c in count.items():
        most[a] = max(most[a], c)
    out = []
    for doc_id, d in docs:
        if d is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_g, links, text = d
        best = sum(1 for p in links if count[p] == most[p[0]])
        out.append((doc_id, n_a, n_b, n_g, len(links), best, sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_alignment_against_brute_force(spark):
    texts = [
        r.text
        for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    ]
    texts += [
        None, "", "<|endoftext|> and <s> are text", "héllo wörld 日本語 テスト", "a\tb\nc  d", "\x01\x7f x",
        "word " * 3000, "<0x41> ▁ literal", " leading space", "the the the",
    ]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the the the")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_row", F.lit("clash"))
    got = token_alignment.align(df, A_FILE, B_FILE).collect()
    assert sorted((tuple(r) for r in got), key=repr) == _plain_align(rows)
    none = [r for r in got if r.doc_id in (40, 41)]
    assert all(r.n_a == 0 and r.groups_sha256 == "" for r in none)


def test_group_strings_are_hashed_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "the the"), (2, None)], "doc_id bigint, text string")
    plan = token_alignment.align(df, A_FILE, B_FILE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sha2(") > plan.index("Join LeftOuter")


def test_alignment_takes_one_thread_and_a_slice_at_a_time(monkeypatch):
    """Threads of the tokenizer bring memory of their own; results do not depend on the slices."""
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    token_alignment._sides.cache_clear()
    texts = ["the the", None, "", "word " * 50, "héllo wörld 日本語", "a\tb\nc  d"]
    batch = pa.RecordBatch.from_pydict({"_row": list(range(6)), "doc_id": list(range(6)), "text": texts})
    whole, small = ([r for b in token_alignment._align(A_FILE, B_FILE, n)([batch]) for r in b.to_pylist()] for n in (1 << 20, 20))
    assert whole == small and [r["doc_id"] for r in whole] == list(range(6))
    assert os.environ["TOKENIZERS_PARALLELISM"] == "false"
    sizes = [sum(len((t or "").encode()) for t in b.column("text").to_pylist()) for b in slices([batch], 20)]
    assert sizes == [7, 250, 23, 8] and sum(b.num_rows for b in slices([batch], 20)) == 6


def test_alignment_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert token_alignment.align(df, A_FILE, B_FILE).count() == 0


def _plain_top(vectors, k):
    ok = {i: np.floor(256 * np.array(v, dtype=np.float64)).astype(np.int64) for i, v in vectors}
    out = []
    for q in sorted(i for i in ok if i % 50 == 0):
        scored = sorted(((-int(ok[q] @ ok[c]), c) for c in ok if c != q))[:k]
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored)]
    return sorted(out)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = [(int(i), [float(x) for x in rng.normal(0, 0.3, 16)]) for i in rng.permutation(1500)]
    vectors += [(1500 + i, vectors[0][1]) for i in range(30)]  # ties: equal vectors
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    vecs = [(r.vec_id, r.embedding) for r in df.collect()]
    bad = [(5000, None), (5050, [1.0, None]), (5100, [float("nan")] * 16), (5150, [float("inf")] * 16), (None, [0.1] * 16)]
    df = df.union(spark.createDataFrame(bad, "vec_id bigint, embedding array<float>")).withColumn("w", F.lit(1))
    ints = topk_search.integer_vectors(df)
    got = topk_search.top_k(ints, F.col("vec_id") % 50 == 0, k=5, block_rows=16, shard_rows=300, query_rows=7)
    assert sorted(tuple(r) for r in got.collect()) == _plain_top(vecs, 5)


def test_top_k_small_and_empty(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.25, 0.25]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = topk_search.top_k(topk_search.integer_vectors(df), F.col("vec_id") % 50 == 0, k=5).collect()
    # Integer vectors: 0 -> (256, 128), 50 -> (64, 64), 7 -> (128, 128).
    assert sorted(tuple(r) for r in got) == [(0, 1, 7, 256 * 128 + 128 * 128), (0, 2, 50, 256 * 64 + 128 * 64),
                                             (50, 1, 0, 64 * 256 + 64 * 128), (50, 2, 7, 64 * 128 * 2)]
    empty = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk_search.top_k(topk_search.integer_vectors(empty), F.col("vec_id") % 50 == 0).count() == 0
