"""Source divergence audit against a plain, dense computation."""

from collections import Counter

import regex

from tallyspark.llm import divergence


def _plain(rows, min_docs=3, top_terms=200):
    docs = []
    for text, lang, source in rows:
        text = (text or "").translate(str.maketrans(divergence.UPPER, divergence.LOWER))
        docs.append((lang or "", source or "", regex.findall(divergence.TERM, text)))
    out = []
    for lang in sorted({d[0] for d in docs}):
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        V = len(kept)

        def p_of(counts):
            N = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 1) // (N + V) for t in kept}

        counts = {s: Counter() for s in {d[1] for d in mine}}
        for _, s, terms in mine:
            counts[s].update(terms)
        p = {s: p_of(c) for s, c in counts.items()}
        q = p_of(sum(counts.values(), Counter()))
        for s in counts:
            pairs = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, items, limit in (("pair", pairs, None), ("term", terms, top_terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:limit]
                out += [(lang, s, part, item, value, r + 1) for r, (item, value) in enumerate(ranked)]
    return sorted(out)


def test_audit_against_dense_sums(spark):
    words = ["Alpha", "beta", "GAMMA", "délta", "ZETA", "eta", "theta", "iota", "kappa", "lambda"]
    rows = []
    for i in range(120):
        text = " ".join(words[(i * j) % len(words)] for j in range(1, 2 + i % 9)) + f" x{i}y 123 Été"
        rows.append((text, ["en", "fr"][i % 2], f"s{i % 5}"))
    rows += [(None, "en", "s9"), ("", None, None), ("only once", "de", "a"), ("only once", "de", "b")]
    rows += [("beta beta", "en", "s0")] * 3 + [("AB-cd ef_gh", None, "s1")] * 4
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    df = df.withColumns({"rank": df.source, "value": df.lang})
    got = divergence.audit(df, min_docs=3, top_terms=4)
    assert sorted(tuple(r) for r in got.collect()) == _plain(rows, 3, 4)


def test_audit_small_arity_walk(spark, monkeypatch):
    monkeypatch.setattr(divergence, "ARITY", 2)
    rows = [(" ".join(f"w{chr(97 + (i * k) % 26)}" for k in range(i % 7 + 1)), "en", f"s{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == _plain(rows)


def test_audit_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0


def test_audit_many_tiles_blocks_and_tables(spark, monkeypatch):
    for name, value in {"ARITY": 2, "BLOCK_LEVELS": 2, "TILE": 3, "TABLE": 7, "BATCH": 3}.items():
        monkeypatch.setattr(divergence, name, value)
    texts = [" ".join(f"w{chr(97 + (i * k) % 26)}" for k in range(i % 7 + 1)) for i in range(150)]
    rows = [(text, ["en", "é"][i % 3 > 1], f"s{i % 11}") for i, text in enumerate(texts)]
    rows += [("", "en", "t"), (None, "en", "u"), ("12 ?", "é", "v"), ("alone", "é", "w"), ("a", "xx", "x"), ("a", "xx", "y")]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == _plain(rows)


def test_audit_terms_on_bytes(spark):
    texts = ["Ünder\u00a0Ärger\x85x", "a\x00B\x7fC\x1cD", "中文 ABC中 Ⅷ\u2028z", "ZÄz zÄZ zäz", "_a-b'c[d]e`f{g}h@i0j"]
    rows = [(text, "en", f"s{i % 2}") for i in range(3) for text in texts]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    assert sorted(tuple(r) for r in divergence.audit(df).collect()) == _plain(rows)


def _shuffled(node) -> int:
    """Rows that the executed plan's exchanges wrote."""
    name, metrics = node.nodeName(), node.metrics()
    if name == "AdaptiveSparkPlan":
        return _shuffled(node.executedPlan())
    if name.endswith("QueryStage"):
        return _shuffled(node.plan())
    own = metrics.apply("shuffleRecordsWritten").value() if metrics.contains("shuffleRecordsWritten") else 0
    return own + sum(_shuffled(node.children().apply(i)) for i in range(node.children().size()))


def test_audit_sends_cells_not_leaves_of_pairs(spark, monkeypatch, tmp_path):
    """30 sources of 50 terms each: every cell once to count and once to compare, not 29 times."""
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rows = [(" ".join(words[(s + i) % 60] for i in range(50)), "en", f"s{s}") for s in range(30)]
    at = str(tmp_path / "docs")
    spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1).write.parquet(at)
    sent, scans = [], []

    def collected(df, *_):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("ReadSchema: struct<text:"))
        found = df.collect()
        sent.append(_shuffled(df._jdf.queryExecution().executedPlan()))
        return spark.createDataFrame(found, df.schema)

    monkeypatch.setattr(divergence, "settle", collected)
    out = collected(divergence.audit(spark.read.parquet(at)))
    assert sorted(tuple(r) for r in out.collect()) == _plain(rows)
    assert sum(scans) == 1
    assert sum(sent) < 10 * 30 * 50, sent
