"""Operators 11, 12 and 13 against plain versions of their definitions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldbook.llm import divergence, fill_in_middle, suffix_dedup

from .conftest import SF, documents


def plain_removal(rows, length=50):
    texts = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in texts:
        if i is not None:
            for p in range(len(t) - length + 1):
                s = t[p : p + length]
                least[s] = min(i, least.get(s, i))
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1 if i is not None else 0):
            if least[t[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((i, len(t), int(gone.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~gone])))
    return sorted(out, key=repr)


def removal(df):
    rows = df.collect()
    return sorted(((r.doc_id, r.n_bytes, sum(x.end - x.start for x in r.removed), len(r.removed), bytes(r.kept)) for r in rows), key=repr)


def repeating_rows(seed, n=60):
    rng = random.Random(seed)
    words = ["aa", "ab", "ba", "ünï", "the", "of", " ", "\n", "aaaaaaaa", "日本"]
    passages = ["".join(rng.choice(words) for _ in range(rng.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in rng.sample(range(10 * n), n):
        text = "".join(rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.5 else rng.choice(words) * rng.randint(1, 40) for _ in range(rng.randint(0, 5)))
        rows.append((i, text))
    rows += [(rows[0][0], rows[0][1] + passages[0]), rows[1], (None, passages[1] * 2), (10 * n + 1, None), (10 * n + 2, ""), (10 * n + 3, "a" * 3000), (10 * n + 4, passages[2][:49]), (10 * n + 5, "a" * 700)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "sizes"), [(1, {}), (2, {"bucket": 3000, "part": 900, "slice_bytes": 2000, "step": 700}), (3, {"bucket": 1500, "part": 5000, "slice_bytes": 300, "step": 90})])
def test_removed_bytes_are_those_of_all_50_byte_strings(spark, seed, sizes):
    rows = repeating_rows(seed)
    assert removal(suffix_dedup.deduplicate(documents(spark, rows, extra=True).repartition(5), **sizes)) == plain_removal(rows)


def test_other_lengths_and_hot_splitters(spark, monkeypatch):
    rows = repeating_rows(4, 40) + [(1000 + k, "the same line that all of these rows hold, twice " * 2 + str(k)) for k in range(200)]
    assert removal(suffix_dedup.deduplicate(documents(spark, rows), 33, bucket=2000, slice_bytes=500, step=200)) == plain_removal(rows, 33)
    leading = []
    monkeypatch.setattr(suffix_dedup, "SPARSE", 1)
    found = suffix_dedup.sampled_splitters
    monkeypatch.setattr(suffix_dedup, "sampled_splitters", lambda *a: leading.append(found(*a)) or leading[-1])
    again = [(k, "x" * 60 + str(k) * 3) for k in range(300)]
    assert removal(suffix_dedup.deduplicate(documents(spark, again), bucket=1000, slice_bytes=300, step=100)) == plain_removal(again)
    values, times = np.unique(leading[0], return_counts=True)
    assert times.max() > 1  # the way of leading bytes that fill several buckets was taken


def test_multikey_order_is_that_of_the_bytes():
    rng = np.random.default_rng(5)
    rows = rng.integers(97, 99, (500, 24)).astype(np.uint8)
    rows[:, :18] = 97
    chars = suffix_dedup.words(rows)
    order, same = suffix_dedup.multikey(500, 3, lambda d, at: chars[at, d].astype(np.uint64))
    got = [bytes(r) for r in rows[order]]
    assert got == sorted(bytes(r) for r in rows)
    assert [got.index(x) for x in got] == same.tolist()


def test_removal_of_odd_and_empty_tables(spark, odd, odd_rows):
    assert removal(suffix_dedup.deduplicate(odd)) == plain_removal(odd_rows)
    assert removal(suffix_dedup.deduplicate(odd.limit(0))) == []


def plain_cut(i, text):
    text = text or ""
    tokens = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return (i, len(tokens), "plain", None, None, text, text)
    if h4 % 100 < 20:
        return (i, len(tokens), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (i, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


def cut_rows(seed, n=300):
    rng = random.Random(seed)
    parts = ["word", "Ab", "é", "🎉", " ", "\n", "<", ">", "<P", "<S", "M>", "P>", "S", "<<", "7", "日"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for i in range(n)]
    return [*rows, rows[3], (3, "another text of this id, and a longer one"), (None, "no id here, none at all"), (None, "short"), (n, None), (n + 1, ""), (n + 2, "a" * 500), (n + 3, "." * 500), (n + 4, "x<P>y"), (n + 5, "ab" * 30 + "<M>" + "cd" * 9)]


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, fill_in_middle.CHUNK])
def test_cuts_are_those_of_a_plain_tokenizer(spark, chunk):
    rows = cut_rows(chunk)
    out = fill_in_middle.transform(documents(spark, rows, extra=True).repartition(3), chunk)
    got = [tuple(r) for r in out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restore(F.col("output"), F.col("form"))).collect()]
    assert sorted(got, key=repr) == sorted((plain_cut(*r) for r in rows), key=repr)


def test_chunk_functions_compose_like_the_whole(spark):
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["a", "B", "<", ">", "P", "S", " ", "é"]) for _ in range(rng.randint(0, 12))).encode()
        at = rng.randint(0, len(text))
        while 0 < at < len(text) and text[at] & 0xC0 == 0x80:
            at -= 1
        ends, counts, chars = fill_in_middle.summaries(np.frombuffer(text, np.uint8), np.array([0, at, len(text)]))
        whole_ends, whole_counts, whole_chars = fill_in_middle.summaries(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        for s in range(fill_in_middle.STATES):
            assert ends[1][ends[0][s]] == whole_ends[0][s], (text, at, s)
            assert counts[0][s] + counts[1][ends[0][s]] == whole_counts[0][s]
        assert chars.sum() == whole_chars[0]


def test_cuts_of_odd_and_empty_tables(spark, odd, odd_rows):
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in fill_in_middle.transform(odd).collect()]
    assert sorted(got, key=repr) == sorted((plain_cut(*r)[:6] for r in odd_rows), key=repr)
    assert fill_in_middle.transform(odd.limit(0)).count() == 0


def plain_audit(rows, least_docs, ranks):
    terms_of = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", t or "")]
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        docs[lang].update(set(terms_of(text)))
        counts[lang, source].update(terms_of(text))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // total for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(whole)
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode(), x) for x in sources if x != s)
            own = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t])[:ranks]
            out += [(lang, s, part, x, -v, k + 1) for part, found in (("pair", pairs), ("term", own)) for k, (v, _, x) in enumerate(found)]
    return sorted(out)


def test_audit_is_that_of_plain_counts(spark):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("wa", "Ze", "é", "日", "x") for b in ("", "lo", "ÅR", "n")]
    rows = [(" ".join(rng.choices(words, k=rng.randint(0, 12))) + rng.choice(["", ".", "\x00a_b`c"]), rng.choice(["en", "da", None, ""]), rng.choice(["s1", "s2", "S3", None, "é"])) for _ in range(300)]
    rows += [(None, "en", "only"), ("", "fr", "a"), ("rare words", "fr", "b"), (None, "xx", "alone"), rows[0], rows[0]]
    df = spark.createDataFrame([(k, *r, 0) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    for name in ("n", "term", "vector", "value", "rank", "part", "item", "docs"):
        df = df.withColumn(name, F.lit("x"))
    assert sorted(tuple(r) for r in divergence.audit(df, 4, 3).collect()) == plain_audit(rows, 4, 3)
    assert sorted(tuple(r) for r in divergence.audit(df, 10**6, 3).collect()) == plain_audit(rows, 10**6, 3)
    assert divergence.audit(df.limit(0)).count() == 0


def test_audit_of_odd_rows_and_blocks_of_one_vector(spark, odd, odd_rows, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    rows = [(t, "en" if k % 2 else None, None) for k, (_, t) in enumerate(odd_rows)]
    assert sorted(tuple(r) for r in divergence.audit(odd, 1, 5).collect()) == plain_audit(rows, 1, 5)


def test_exact_shares_of_large_counts():
    counts = np.array([[0, 1, 10**12, 3 * 10**14], [7, 0, 123456789012345, 5]])
    n = np.array([10**13, 10**9, 4 * 10**14, 9 * 10**14])
    got = divergence.exact_shares(counts, n, 1000)
    assert got.tolist() == [[1 + 10**9 * (c + 5) // (int(t) + 5000) for c, t in zip(row, n, strict=True)] for row in counts.tolist()]


@pytest.mark.parametrize("op", [divergence, suffix_dedup, fill_in_middle])
def test_queries_give_the_rows_of_their_sql(spark, op):
    query = {divergence: divergence.op11, suffix_dedup: suffix_dedup.op12, fill_in_middle: fill_in_middle.op13}[op]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(op.ORACLE)
    columns = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in columns) for r in query(spark, SF).collect()) == sorted(want.fetchall())
