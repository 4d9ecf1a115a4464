"""Compression bands, decontamination, quality, tokens, duplicates, personal data and repeats."""

import collections
import hashlib
import os
import random
import re
import string
import zlib

import numpy as np
import pandas as pd
import pyarrow.orc
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import compression, decontaminate, orc_tokens, pii, probminhash, quality, repeats, suffixes
from tallyspark.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark, rows):
    """Rows of (doc_id, text), with a column whose name an operator might use itself."""
    return spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, node string")


@pytest.fixture(scope="module")
def given(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a"), (5, "a"), (5, "a"), (6, "é" * 3000), (7, "x y " * 40000)]


# --- compression ------------------------------------------------------------


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(given):
    texts = [r.text or "" for r in given] + [t or "" for _, t in ODD] + ["a\x1cb \x85c\xa0d a b c a b c", "l\nl\n \nl\n", "a a a a"]
    for text in texts:
        assert compression.base_counts(text) == plain_counts(text)


def test_bands(spark):
    words = [f"w{i}" for i in range(3000)]
    rng = random.Random(1)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    noise = " ".join(os.urandom(5).hex() + chr(rng.randint(0x4E00, 0x9FFF)) * 3 for _ in range(30))
    rows = [(1, prose), (2, "one two three four five six seven eight " * 200), (3, " ".join(words[:40])), (4, noise)]
    found = {r.doc_id: r for r in compression.judge(documents(spark, rows + [(9, None)])).collect()}
    assert found[1].kept and not found[2].kept and found[2].base_failed and found[3].base_failed
    assert found[4].base_failed and not found[9].kept and found[9].n_words == 0
    long = "the start is fine. " + prose + " ".join(f"{i % 3} same" for i in range(9000))
    assert not compression.judge(documents(spark, [(1, long)])).first().kept
    assert compression.judge(documents(spark, ODD)).count() == len(ODD)
    assert compression.judge(documents(spark, [])).count() == 0


def test_noise_of_many_words_is_not_kept(spark):
    rng = random.Random(3)
    letters = {"base64": string.ascii_letters + string.digits + "+/", "printable": "".join(map(chr, range(33, 127)))}
    rows, noise = [], lambda signs, n: " ".join("".join(rng.choices(signs, k=rng.randint(3, 6))) for _ in range(n // 5))
    for signs in letters.values():
        rows += [(len(rows), noise(signs, size).replace(" ", gap, 1)) for size in (350, 600, 1000, 2500, 5000, 30000) for gap in " \n"]
    found = compression.judge(documents(spark, rows)).collect()
    assert not any(r.kept or r.base_failed for r in found), [(r.doc_id, r.ratio) for r in found]
    prose = [" ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (80, 250, 900)]
    assert all(r.kept for r in compression.judge(documents(spark, list(enumerate(prose)))).collect())


def test_the_end_of_a_text_is_judged(spark):
    rng = random.Random(3)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(900))
    end = " ".join("".join(chr(rng.randint(33, 126)) for _ in range(5)) for _ in range(340))
    found = compression.judge(documents(spark, [(1, prose[:2048] + end), (2, prose[:4000])])).collect()
    assert [r.bad_chunk_share for r in found] == [0.5, 0.0]


# --- decontamination --------------------------------------------------------


def text_of(rng, n):
    return "".join(rng.choice("abcdefghij  ") for _ in range(n))


def least_edits(item, text, n):
    """Fewest edits of any stretch of n of the item anywhere in the text, by plain dynamic programming."""
    best = n
    for s in range(len(item) - n + 1):
        row = [0] * (len(text) + 1)
        for i, c in enumerate(item[s : s + n], 1):
            new = [i]
            for j, d in enumerate(text, 1):
                new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
            row = new
        best = min(best, *row)
    return best


def test_passages_with_edits():
    rng = random.Random(4)
    items = [(i, text_of(rng, 100)) for i in range(4)] + [(9, text_of(rng, 40)), (10, "short"), (11, ""), (12, None)]
    settings = decontaminate.Settings()
    index = decontaminate.Index(items, settings)
    texts = []
    for edits in range(0, 9):
        piece = list(items[edits % 4][1])
        for at in rng.sample(range(10, 90), edits):
            piece[at] = rng.choice(["", "Z", piece[at] + "Z"])
        texts.append(text_of(rng, 60) + "".join(piece) + text_of(rng, 60))
    texts += [text_of(rng, 30) + items[4][1] + text_of(rng, 30), items[0][1][:79] + "Q", "", text_of(rng, 300)]
    found = {(i, item) for i, item, *_ in index.search(texts)}
    for i, text in enumerate(texts):
        for item, whole in items[:5]:
            n = min(len(whole), settings.length)
            k = int(settings.rate * n)
            while n + 1 - settings.q * (k + 1) < 1:
                k -= 1
            assert ((i, item) in found) == (least_edits(whole, text, n) <= k), (i, item)


def test_passages_in_tables(spark, given):
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = benchmark.collect()
    whole = {(d.doc_id, b.item_id) for d in given for b in items if b.text in (d.text or "")}
    found = {(r.doc_id, r.item_id): r for r in QUERIES["op4_qgram_passages"](spark, SF).collect()}
    assert whole <= set(found) and whole
    texts, by_item = {d.doc_id: d.text for d in given}, {b.item_id: b.text for b in items}
    for pair in whole:
        assert texts[pair[0]][found[pair].start : found[pair].end] == by_item[pair[1]]
    small = decontaminate.Settings(block_bytes=500)
    blocks = decontaminate.find_passages(docs, benchmark, small)
    assert {(r.doc_id, r.item_id) for r in blocks.collect()} == set(found)
    kept = decontaminate.drop_contaminated(docs, benchmark, small)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(texts) - {d for d, _ in found}
    assert decontaminate.find_passages(docs, benchmark.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(documents(spark, ODD), benchmark).count() == len(ODD)
    assert decontaminate.find_passages(documents(spark, []), benchmark).count() == 0


def test_passages_in_other_case_and_white_space(spark):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghijß") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    item, other = " ".join(words[:40]), " ".join(words[40:])
    wrapped = "\n    ".join(" ".join(words[i : i + 5]) for i in range(0, 40, 5))
    rows = [(1, f"x  y {item.upper()} z"), (2, f"x {wrapped}  z"), (3, wrapped.upper()), (4, f"x {other} z"), (5, item.title())]
    benchmark = spark.createDataFrame([(7, item), (8, " \t"), (9, "\n\n".join(words[:4]))], "item_id bigint, text string")
    docs = documents(spark, rows)
    found = {r.doc_id: r for r in decontaminate.find_passages(docs, benchmark).where("item_id = 7").collect()}
    assert set(found) == {1, 2, 3, 5}
    for doc, copy in ((1, item.upper()), (2, wrapped), (3, wrapped.upper()), (5, item.title())):
        assert dict(rows)[doc][found[doc].start : found[doc].end] == copy and found[doc].edits == 0
    short = decontaminate.find_passages(docs, benchmark).where("item_id = 9").collect()
    assert {r.doc_id for r in short} == {1, 2, 3, 5}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, benchmark).collect()] == [4]


# --- quality ----------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op5_neighbour_votes"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in found.items())
    apart = [(found[r.doc_id].predicted, r.quality) for r in labels if found[r.doc_id].held_out]
    assert np.mean([p == q for p, q in apart]) > 0.95 and len(found) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found.values())


def test_quality_edges(spark):
    docs = documents(spark, ODD + [(8, "Plain words here. " * 20), (9, "BAD!! " * 60)])
    labels = spark.createDataFrame([(8, 1), (9, 0), (99, 1), (8, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.predicted for r in found}
    assert by_id[8] == 1 and by_id[9] == 0
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and 9 not in {r.doc_id for r in kept.collect()}
    nothing = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).count() == 0


# --- token files ------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(file)
    plain.encode_special_tokens = True
    return file, plain


def test_pieces_give_the_tokenizers_ids(tokenizer, given):
    file, plain = tokenizer
    texts = [r.text or "" for r in given]
    texts += ["", " ", "  ", "a  b", " a", "a ", "a \n b", "don't we're 'll", "x y　z  ", "<|endoftext|> a<|endoftext|>"]
    texts += ["日本 語  テ", "a\t b", "\x1c \x1d x", "é ̀ a", "a   b\n\n  d", "a\n b", "a\nb c\n", "word,.# 12 a1 .x", "  a b"]
    ids, lengths = orc_tokens.Encoder(file).encode(texts, 0)
    found = [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert found == [x.ids + [0] for x in plain.encode_batch(texts, add_special_tokens=False)]


def test_op6_query(spark, tokenizer, given):
    at, want = 0, {}
    for r in sorted(given, key=lambda r: r.doc_id):
        ids = tokenizer[1].encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    found = QUERIES["op6_orc_tokens"](spark, SF).collect()
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in found} == want and len(found) == len(want)


def test_orc_files(spark, tokenizer, tmp_path):
    path = str(tmp_path / "ids")
    docs = documents(spark, ODD + [(i, f"number {i}") for i in range(100, 900)])
    orc_tokens.write_token_ids(docs, path, tokenizer[0], stripe_bytes=1 << 20, rows_per_index=1000)
    files = sorted(f for f in os.listdir(path) if f.endswith(".orc"))
    ids = [i for f in files for i in pyarrow.orc.ORCFile(f"{path}/{f}").read(["doc_id"])["doc_id"].to_pylist()]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(ODD) + 800
    assert all(pyarrow.orc.ORCFile(f"{path}/{f}").nstripes >= 1 for f in files)
    one = spark.read.orc(path).where("doc_id = 500").select("n_tokens")
    assert "EqualTo(doc_id,500)" in one._jdf.queryExecution().toString() and one.count() == 1
    starts = sorted((r.start, r.n_tokens) for r in orc_tokens.token_digest(spark, path).collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    empty = str(tmp_path / "none")
    orc_tokens.write_token_ids(documents(spark, []), empty, tokenizer[0])
    assert not any(f.endswith(".orc") and os.path.getsize(f"{empty}/{f}") > 2000 for f in os.listdir(empty))


def test_file_order_reads_numbers_of_any_width(spark):
    names = [
        "part-100000-ab12-c000.zstd.orc",
        "part-99999-ab12-c001.zstd.orc",
        "part-00002-ab12-c000.zstd.orc",
        "part-99999-ab12-c000.zstd.orc",
        "part-1000000-ab12-c000.orc",
        "part-99999-ab12-c010.zstd.orc",
        "odd.orc",
    ]
    table = spark.createDataFrame([(n,) for n in names], "file string")
    found = [r.file for r in table.orderBy(*orc_tokens.file_order(F.col("file"))).collect()]
    assert found == [
        "odd.orc",
        "part-00002-ab12-c000.zstd.orc",
        "part-99999-ab12-c000.zstd.orc",
        "part-99999-ab12-c001.zstd.orc",
        "part-99999-ab12-c010.zstd.orc",
        "part-100000-ab12-c000.zstd.orc",
        "part-1000000-ab12-c000.orc",
    ]


# --- near-duplicates --------------------------------------------------------


def grams(text):
    words = text.encode().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_classes(rows):
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    sets = [grams(t or "") for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            same = (rows[i][1] or "") == (rows[j][1] or "")
            both = len(sets[i] & sets[j])
            if same or (both and both >= 0.8 * len(sets[i] | sets[j])):
                parent[root(i)] = root(j)
    groups = collections.defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        groups[root(i)].append(doc)
    return sorted(
        ((d, min((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=str
    )


def copies(seed, n):
    """A family of edited copies, some too far from most others, and texts that share half."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(200)], []
    for i in range(n):
        text = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 12])):
            text[rng.randrange(200)] = word()
        rows.append((i, " ".join(text)))
    rows += [(n + i, " ".join(base[:100] + [word() for _ in range(100)])) for i in range(30)]
    return rows


def classes_of(df):
    return sorted(((r.doc_id, r.class_id, r.class_size) for r in probminhash.classes(df).collect()), key=str)


def test_components_of_few_edges_take_no_rounds_and_of_many_are_the_same(spark, monkeypatch):
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(300) if i % 50 < 48] + [(400, 400 + i) for i in range(1, 90)]
    pairs += [(rng.randrange(600, 800), rng.randrange(600, 800)) for _ in range(90)] + [(400, 401), (401, 400), (7, 7)]
    rng.shuffle(pairs)
    least = {n: n for p in pairs for n in p}
    for _ in pairs:
        for a, b in pairs:
            least[a] = least[b] = min(least[a], least[b])
    want = sorted((bytes([n // 256, n % 256]), bytes([c // 256, c % 256])) for n, c in least.items())
    rows = [tuple(bytes([n // 256, n % 256]) for n in p) for p in pairs]
    edges = spark.createDataFrame([(bytearray(a), bytearray(b)) for a, b in rows], "a binary, b binary")
    written, settle = [], probminhash.settle
    monkeypatch.setattr(probminhash, "settle", lambda df, name, *a, **k: written.append(name) or settle(df, name, *a, **k))
    assert sorted((bytes(r.node), bytes(r.comp)) for r in probminhash.components(edges).collect()) == want
    assert len(written) == 2
    monkeypatch.setattr(probminhash, "EDGES", 40)
    assert sorted((bytes(r.node), bytes(r.comp)) for r in probminhash.components(edges).collect()) == want
    assert len(written) > 5


def test_duplicate_classes(spark, monkeypatch):
    rows = copies(2, 120) + [(1000 + i, t) for i, t in enumerate(["a b c", "a  b c", "", None, " ", "x", "x", "a b c d e f"])]
    rows += [(None, "q w e r t y u"), (1005, "x"), (1005, "x"), (2000, copies(2, 5)[3][1])]
    monkeypatch.setattr(probminhash, "BLOCK", 16)
    assert classes_of(documents(spark, rows)) == plain_classes(rows)
    kept = probminhash.keep_one(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "node"]
    want = {(c, n) for _, c, n in plain_classes(rows)}
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((c for c, _ in want), key=str)


def test_duplicates_in_the_tables(spark, given):
    rows = [(r.doc_id, r.text) for r in given]
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in QUERIES["op7_probminhash"](spark, SF).collect()) == plain_classes_of_ids(rows)
    assert probminhash.classes(documents(spark, [])).count() == 0
    assert probminhash.keep_one(documents(spark, [])).count() == 0


def plain_classes_of_ids(rows):
    return sorted(plain_classes(rows))


def test_texts_that_differ_by_repeats_of_a_line(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = []
    for i in range(12):
        body, line = " ".join(word() for _ in range(300)), " ".join(word() for _ in range(12))
        rows += [(10 * i, f"{body}\n{line}"), (10 * i + 1, body + f"\n{line}" * 200), (10 * i + 2, body + f"\n{line}" * 2000)]
    assert classes_of(documents(spark, rows)) == plain_classes(rows)
    # The same where no leader decides: blocks compare every pair of a bucket.
    monkeypatch.setattr(probminhash, "BLOCK", 4)
    assert classes_of(documents(spark, rows)) == plain_classes(rows)


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    common, one, two = (rng.integers(1, 1 << 63, n, dtype=np.uint64) for n in (60, 20, 20))
    a = dict(zip(np.concatenate([common, one]).tolist(), rng.integers(1, 5, 80).tolist(), strict=True))
    b = dict(zip(np.concatenate([common, two]).tolist(), rng.integers(1, 5, 80).tolist(), strict=True))
    every = set(a) | set(b)
    want = sum(1 / sum(max(a.get(e, 0) / a[d], b.get(e, 0) / b[d]) for e in every) for d in set(a) & set(b))
    registers = 4096
    held = [
        probminhash.signatures(np.zeros(len(x), np.int64), np.array(list(x), np.uint64), np.array(list(x.values()), float), 1, registers)
        for x in (a, b)
    ]
    assert abs((held[0] == held[1]).mean() - want) < 4 * (want * (1 - want) / registers) ** 0.5


# --- personal data ----------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and total % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def test_base_spans(given):
    rng = random.Random(6)
    texts = [r.text or "" for r in given]
    texts += ["".join(rng.choice("0123456789.@+-() ab%é") for _ in range(200)) for _ in range(400)]
    texts += ["a@b@c.de.", "a.b@c.d@e.f", "1.2.3.4.5.6.7.8", "0001.000255.1.1", "4111 1111 1111 1111", "@x.y", "+1 (307) 555-5491", "é@b.c x@y.z"]
    for text in texts:
        assert pii.base_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 200_000, "@" * 200_000, "1" * 200_000, "1 " * 100_000, "+1" * 100_000, "a@" * 100_000, "1." * 100_000):
        pii.base_spans(run)


def test_trees_learn_and_thresholds_hold():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(2000, pii.WIDTH))
    x[:, :4] = np.eye(4)[rng.integers(0, 4, 2000)]
    y = ((x[:, 5] > 0) & (x[:, 8] < 0.5)).astype(float)
    apart = rng.random(2000) < 0.3
    model = pii.Model(x, y, apart, pii.Settings())
    assert np.mean((model.probabilities(x[apart]) > 0.5) == y[apart]) > 0.97
    assert all(t is not None and 0.5 <= t <= 1 for t in model.thresholds.values())
    assert pii.Model(x[:0], y[:0], apart[:0], pii.Settings()).trees is None


def test_added_spans_are_learned(spark):
    rng = random.Random(9)

    def card(valid):
        digits = "".join(rng.choice("123456789") for _ in range(15))
        return next(digits + d for d in "0123456789" if pii.luhn(digits + d) == valid)

    rows = [(i, f"paid by card {card(i % 2 == 0)} on day") for i in range(800)]
    hidden = card(True)
    rows += [(5000, f"card {hidden} 20 24"), (5001, "card 1234 5678 and 1"), (5002, None)]
    docs = documents(spark, rows)
    model = pii.fit(docs)
    found = {r.doc_id: r.spans for r in pii.find_pii(docs, model).collect()}
    assert model.thresholds["card"] is not None
    assert [(s.kind, s.start, s.end) for s in found[5000]] == [("card", 5, 21)] and found[5000][0].added
    assert found[5001] == [] and found[5002] == [] and len(found) == 803
    assert pii.redact(rows[800][1], [("card", 5, 21)]) == "card <card> 20 24"


def test_each_kind_adds_a_planted_span(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))

    def planted(i):
        digits = number(15)
        card = next(digits + d for d in "0123456789" if pii.luhn(digits + d))
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        return (
            f"contact {word()}@{word()}.com", f"host {ip}", f"card {card}",
            f"call +1 ({number(3)}) {number(3)}-{number(4)}", f"token {word()}{number(9)}{word()}",
        )[i % 5]

    prose = lambda: " ".join(word() for _ in range(12))
    rows = [(i, f"{prose()} {planted(i)} {prose()}") for i in range(2500)]
    hidden = {
        "email": ("contact ", "jane at fabeg dot com"), "ip": ("host ", "10. 20. 30. 40"),
        "card": ("card ", "4111111111111111"), "phone": ("call ", "1 (826) 555-4381"),
    }
    plants = list(hidden.items())
    rows += [(9000 + i, f"{prose()} {lead}{span}{' 20 24' if kind == 'card' else ''} {prose()}") for i, (kind, (lead, span)) in enumerate(plants)]
    rows += [(9100, f"{prose()} bade at gafe dot chad {prose()}")]
    docs = documents(spark, rows)
    model = pii.fit(docs)
    assert all(model.thresholds[kind] is not None for kind in pii.KINDS), model.thresholds
    found = {r.doc_id: r.spans for r in pii.find_pii(docs.where("doc_id >= 9000"), model).collect()}
    texts = dict(rows)
    for i, (kind, (_, span)) in enumerate(plants):
        at = texts[9000 + i].index(span)
        assert [(s.kind, s.start, s.end, s.added) for s in found[9000 + i]] == [(kind, at, at + len(span), True)]
    assert found[9100] == []


def test_op8_query(spark, given):
    found = {r.doc_id: r for r in QUERIES["op8_boosted_pii"](spark, SF).collect()}
    for r in given:
        base = plain_spans(r.text or "")
        told = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert found[r.doc_id].base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) - {""} <= set(found[r.doc_id].spans.split(","))
        for kind in PATTERNS:
            assert found[r.doc_id][f"n_{kind}"] == sum(s[0] == kind for s in base)
    assert pii.find_pii(documents(spark, []), pii.fit(documents(spark, []))).count() == 0
    assert pii.find_pii(documents(spark, ODD), pii.fit(documents(spark, ODD))).count() == len(ODD)


# --- repeats ----------------------------------------------------------------


@pytest.mark.parametrize("small", [0, 600])
def test_suffix_arrays(monkeypatch, small):
    monkeypatch.setattr(suffixes, "SMALL_ALPHABET", small)
    rng = np.random.default_rng(0)
    for turn in range(600):
        s = rng.integers(0, rng.choice([1, 2, 3, 5, 200, 1000]), rng.integers(0, 60))
        s = np.tile(s, 2) if turn % 3 == 0 else np.repeat(s, rng.integers(1, 6)) if turn % 5 == 0 else s
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        assert suffixes.suffix_array(s).tolist() == want
        if len(s) < 2 or s.max() > 255:
            continue
        n, first = len(s), np.arange(len(s)) == 0
        found = suffixes.common_prefixes(s.astype(np.uint8), np.array(want), n - np.arange(n), first)
        for a, b in zip(want, want[1:], strict=False):
            same = next((k for k in range(n - max(a, b)) if s[a + k] != s[b + k]), n - max(a, b))
            assert found[b] == same


def plain_repeats(rows, length=100):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            window = raw[s : s + length]
            if window in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(window)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_all_windows(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    shared = [" ".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(8)]
    rows = []
    for i in range(120):
        parts = [
            rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 40)))
            for _ in range(rng.randint(0, 6))
        ]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[5][1]), (201, rows[5][1] + "x"), (202, "a" * 1000), (203, "ab" * 300), (204, None), (205, "")]
    rows += [(206, "a" * 99), (207, "a" * 100), (None, rows[7][1]), (300, rows[9][1]), (300, rows[9][1]), (301, "\0" * 150 + "a")]
    found = repeats.remove_repeats(documents(spark, rows), repeats.Settings(block_bytes=3000)).collect()
    told = [
        (r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), hashlib.sha256(r.kept).hexdigest())
        for r in found
    ]
    assert sorted(told, key=str) == plain_repeats(rows)
    assert repeats.remove_repeats(documents(spark, [])).count() == 0


def test_repeats_sort_only_strings_that_may_repeat(monkeypatch):
    """One anchor in different surroundings, as in a short common line, is not worth a suffix sort."""
    rng, sorted_sizes = np.random.default_rng(9), []
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    monkeypatch.setattr(repeats, "suffix_array", lambda s: sorted_sizes.append(len(s)) or suffixes.suffix_array(s))

    def text(n):
        return rng.integers(0, 256, n, dtype=np.uint8).tobytes()

    anchor = text(16)
    segments = [text(60) + anchor + text(60) for _ in range(200)]
    hashes, order = np.ones(200, dtype=np.uint64), np.arange(200)[::-1] * 1000
    assert not any(m.any() for m in repeats.mark_shard(segments, hashes, order, 100))
    assert sorted_sizes == []
    shared = text(47) + anchor + text(47)
    for i, (a, b) in {17: (0, 26), 90: (13, 13), 150: (26, 0)}.items():
        segments[i] = text(a) + shared + text(b)
    segments[151], segments[18] = segments[150][:120] + text(16), text(16) + segments[17][16:]
    want = [np.zeros(len(x) - 99, dtype=bool) for x in segments]
    first = {}
    for i in np.argsort(order).tolist():
        for at in range(len(want[i])):
            want[i][at] = first.setdefault(segments[i][at : at + 100], (i, at)) != (i, at)
    for every in (False, True):  # a hash shared by unequal strings changes nothing
        if every:
            monkeypatch.setattr(repeats, "_twice", lambda hashes: np.ones(len(hashes), dtype=bool))
        found = repeats.mark_shard(segments, hashes, order, 100)
        assert [m.tolist() for m in found] == [w.tolist() for w in want]
        assert sum(m.sum() for m in found) > 20
    assert sorted_sizes[0] < 800 and sorted_sizes[1] == sum(map(len, segments)) + len(segments)


def test_repeats_rows_between_blocks_and_shards(spark):
    """A block sends a row to each shard: blocks hold several times their least size once there are enough of them."""
    docs = documents(spark, [(i, f"{i} " * 2000) for i in range(100)])
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    plan = repeats.remove_repeats(docs, repeats.Settings(block_bytes=total // 200))
    plan = plan._jdf.queryExecution().analyzed().toString()
    blocks = {int(n) for n in re.findall(r"pmod\(xxhash64\([^)]*\), cast\((\d+) as bigint\)\)", plan)}
    assert len(blocks) == 1 and 8 <= min(blocks) <= 51


def test_repeats_answers():
    """Each block hears of its own hashes that another block has."""
    rng = np.random.default_rng(3)
    sent = {n: np.unique(rng.integers(0, 400, rng.integers(0, 60)).astype(np.uint64)) for n in range(40)}
    rows = pd.DataFrame([(0, n, v.astype("<u8").tobytes()) for n, v in sent.items()], columns=["shard", "block", "hashes"])
    found = {r.block: np.frombuffer(r.hashes, "<u8").tolist() for r in repeats._answer(rows).itertuples()}
    for n, v in sent.items():
        others = set().union(*(w.tolist() for m, w in sent.items() if m != n))
        assert found.get(n, []) == [x for x in v.tolist() if x in others]


def test_op9_query(spark, given):
    found = [tuple(r) for r in QUERIES["op9_suffix_repeats"](spark, SF).collect()]
    assert sorted(found, key=str) == plain_repeats([(r.doc_id, r.text) for r in given])


# --- pipeline ---------------------------------------------------------------


def test_pipeline(spark, given, tokenizer):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
    rows = corpus_pipeline.run(spark, SF).collect()
    texts = {r.doc_id: r.text for r in given}
    ids = [r.doc_id for r in rows]
    assert 0 < len(ids) == len(set(ids)) < len(texts)
    classes = {d: c for d, c, _ in plain_classes([(r.doc_id, r.text) for r in given])}
    good = {r.doc_id for r in QUERIES["op5_neighbour_votes"](spark, SF).collect() if r.predicted}
    leaked = {r.doc_id for r in QUERIES["op4_qgram_passages"](spark, SF).collect()}
    assert set(ids) <= good - leaked
    assert len({classes[i] for i in ids}) == len(ids)
    for r in rows:
        assert r.n_tokens == len(tokenizer[1].encode(texts[r.doc_id], add_special_tokens=False).ids) + 1


def test_every_query_runs_over_its_table(spark):
    count = spark.read.parquet(f"{SF}/documents.parquet").agg(F.count("*")).first()[0]
    for name in ("op2_domain_mix", "op3_compression_bands", "op5_neighbour_votes", "op7_probminhash"):
        assert QUERIES[name](spark, SF).count() == count
