"""Operators 2 to 6 and 9, and the pipeline, against brute force, exact round trips and held-out accuracy."""

import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldbook.llm import common, decontaminate, jaccard_join, language, maxent, packing, pii, toxicity

from .conftest import SF, documents

LARGER = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


# packing


def pieces_are_whole(texts, rows, length):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.default_tokenizer())
    want = Counter()
    for d, t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), length):
            part = np.array(ids[k : k + length], "<u4")
            want[d, k // length, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= length
    return len(bins), -(-sum(r.length for r in rows) // length)


def test_packing_is_whole_gapless_and_tight(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()]
    used, least = pieces_are_whole(texts, packing.op2(spark, LARGER).collect(), packing.LENGTH)
    assert used <= 1.01 * least + 1


def test_packing_of_odd_rows_in_many_groups(spark, odd, odd_rows):
    got = packing.pack_pieces(packing.pieces(odd, packing.default_tokenizer(), 64), 64, group=40).collect()
    pieces_are_whole(odd_rows, got, 64)
    assert packing.pack(odd.limit(0), packing.default_tokenizer()).count() == 0


def test_ids_are_the_tokenizers_whatever_the_marks():
    rng, path = random.Random(31), packing.default_tokenizer()
    known = packing.Ids(path)
    letters = "İIıiSßΣσςAÅåE\u0301e Éñ.,!?\u0327\u0307\u0301\u0323\u0308\u0328ﬁ가각한\u1100\u1161  \t\n\x1c\x85\xa0\u2028🎉09_-'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(20_000)]
    for t, raw in zip(texts, known.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == known.tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_marked_words_special_names_and_empty_texts():
    rng, path = random.Random(47), packing.default_tokenizer()
    parts = ["<|startoftext|>", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "'s", "'RE", "'", "''", "...", "$$$", "&&&", "###", "!'", ">.", "_", "\x01", " ", "\t", "\x0b", "\x1f", "\u3000"]
    parts += ["a", "The", "J\u030c", "Éa", "ÿ", "Ÿ", "×", "÷", "ŉ", "ſ", "Й", "и\u0306", "Ђ", "ё", "Ω", "Σ", "İ", "ı", "K", "Å", "½", "²", "٣", "7", "42", "é", "€", "🎉", "\u0338", "中", "ª", "ß", "ẞ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(20_000)] + ["", " ", None, "\n\n", "a ", " a"]
    for most in (packing.KNOWN_WORDS, 50, 0):
        known = packing.Ids(path, most)
        got = [raw for k in range(0, len(texts), 1000) for raw in known.encode(texts[k : k + 1000])]
        for t, raw in zip(texts, got, strict=True):
            assert np.frombuffer(raw, "<u4").tolist() == known.tokenizer.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert known.encode([]) == [] and known.encode([None, ""]) == [b"", b""]


def test_ids_of_plain_words_do_without_the_whole_tokenizer(monkeypatch):
    rng, known = random.Random(48), packing.Ids(packing.default_tokenizer())
    word = lambda: "".join(rng.choice("aeioulnrstüéçñ") for _ in range(rng.randrange(3, 12)))
    texts = [" ".join(word().title() + rng.choice(["", "", ".", ",$$$", "&&&", "-7@x.org"]) for _ in range(200)) for _ in range(50)]
    want = [known.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    sent, whole = [], known.tokenizer

    class Watched:
        def encode_batch_fast(self, texts, **more):
            sent.extend(texts)
            return whole.encode_batch_fast(texts, **more)

    monkeypatch.setattr(known, "tokenizer", Watched())
    assert [np.frombuffer(raw, "<u4").tolist() for raw in known.encode(texts)] == want
    assert not sent


def test_local_search_raises_squared_fill():
    rng = random.Random(2)
    for _ in range(20):
        sizes = [rng.randint(1, 70) for _ in range(60)]
        start = [[i] for i in range(60)]
        out = packing.local_search(start, sizes, 100)
        assert sorted(i for b in out for i in b) == list(range(60))
        fills = [sum(sizes[i] for i in b) for b in out]
        assert max(fills) <= 100 and sum(f * f for f in fills) >= sum(s * s for s in sizes) and len(out) < 50


# benchmark decontamination


def brute_leaks(text, items):
    plain = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", t.lower()).split()
    found, words = {}, plain(text or "")
    by_k = defaultdict(dict)
    for i, t in items:
        if w := plain(t or ""):
            by_k[min(5, len(w))][i] = w
    for k, group in by_k.items():
        bags = {i: Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) for i, w in group.items()}
        df = Counter(s for b in bags.values() for s in b)
        weight = lambda s: round(16 * (1 + np.log((1 + len(bags)) / (1 + max(df.get(s, 0), 1)))))  # noqa: B023, E731
        for i, w in group.items():
            for at in range(len(words) - len(w) + 1):
                win = Counter(tuple(words[at + j : at + j + k]) for j in range(len(w) - k + 1))
                both = sum(weight(s) * min(n, bags[i][s]) for s, n in win.items())
                if both and both >= 0.75 * sum(weight(s) * max(win[s], bags[i][s]) for s in win.keys() | bags[i].keys()):
                    found[i] = True
    return set(found)


def test_leaks_like_brute_force(spark, odd, odd_rows):
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 40, 25, 3, 60, 12])] + [(90, None), (91, "!!")]
    docs = []
    for d in range(60):
        body = [rng.choice(vocab) for _ in range(rng.randint(0, 120))]
        if d % 2:
            part = items[rng.randint(0, 5)][1].split()
            for _ in range(rng.randint(0, 2)):
                part[rng.randrange(len(part))] = "changed"
            at = rng.randint(0, len(body))
            body[at:at] = part
        docs.append((d, ", ".join(body).upper() if d % 3 else " ".join(body)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = defaultdict(set)
    for r in decontaminate.leaks(documents(spark, docs, extra=True), bench).collect():
        got[r.doc_id].add(r.item_id)
    want = {d: s for d, t in docs if (s := brute_leaks(t, items))}
    assert got == want and len(want) > 15
    assert {r.doc_id for r in decontaminate.reject(documents(spark, docs), bench).collect()} == {d for d, _ in docs} - set(want)
    assert decontaminate.leaks(odd, bench).count() == 0 and decontaminate.reject(odd, bench.limit(0)).count() == len(odd_rows)
    assert decontaminate.leaks(odd.limit(0), bench).count() == 0


def brute_short_leaks(text, items):
    """brute_leaks, with a text shorter than an item as its one window."""
    plain = lambda t: re.sub(r"[^0-9a-z\x80-\U0010ffff]+", " ", t.lower()).split()
    words, found = plain(text), brute_leaks(text, items)
    bags = {i: Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4)) for i, t in items if len(w := plain(t)) >= 5}
    df = Counter(s for b in bags.values() for s in b)
    weight = lambda s: round(16 * (1 + np.log((1 + len(bags)) / (1 + max(df.get(s, 0), 1)))))
    win = Counter(tuple(words[j : j + 5]) for j in range(len(words) - 4))
    for i, t in items:
        if i in bags and len(words) < len(plain(t)):
            both, either = (sum(weight(s) * f(win[s], bags[i][s]) for s in win.keys() | bags[i].keys()) for f in (min, max))
            if both and both >= 0.75 * either:
                found.add(i)
    return found


def test_trimmed_items_leak_however_the_benchmark_is_split(spark, monkeypatch):
    rng = random.Random(13)
    vocab = [f"w{i}" for i in range(300)]
    common = [rng.choice(vocab) for _ in range(20)]
    items = [(i, " ".join([*(common if i % 2 else []), *(rng.choice(vocab) for _ in range(rng.choice([30, 45])))])) for i in range(24)]
    docs = []
    for d in range(80):
        w = items[d % 24][1].split()
        part = w[rng.randint(0, len(w) // 6) : len(w) - rng.randint(0, len(w) // 6)]
        docs.append((d, " ".join(part if d % 4 else [*part, *common, *part[:9]])))
    want = {d: s for d, t in docs if (s := brute_short_leaks(t, items))}
    assert len(want) > 20 and any(not brute_leaks(t, items) and d in want for d, t in docs)
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (2_000_000, 1500):
        monkeypatch.setattr(decontaminate, "BENCHMARK_BYTES", most)
        got = defaultdict(set)
        for r in decontaminate.leaks(documents(spark, docs), bench).collect():
            got[r.doc_id].add(r.item_id)
        assert got == want


def test_multi_index_finds_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(4)
    items = [(i, rng.integers(0, 2**63, 30, dtype=np.uint64)) for i in range(50)]
    index = decontaminate.Index(items, 5)
    flips = [sum(1 << b for b in rng.choice(64, n, replace=False).tolist()) for n in rng.integers(0, 30, 400).tolist()]
    prints = np.array([int(index.prints[i % 50]) ^ f for i, f in enumerate(flips)], np.uint64)
    want = {(i, j, d) for i, p in enumerate(prints.tolist()) for j, q in enumerate(index.prints.tolist()) if (d := (p ^ q).bit_count()) <= decontaminate.RADIUS}
    assert set(index.near(30, prints)) == want


# toxicity


def test_marginals_like_enumeration():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 9):
        emit, trans = rng.normal(size=n), rng.normal(size=(2, 2))
        mass, top = 0.0, np.zeros(n)
        for ys in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(emit[t] * y + trans[ys[t - 1] if t else 0, y] for t, y in enumerate(ys)))
            mass += p
            top += p * np.array(ys)
        assert np.allclose(toxicity.marginals(np.concatenate([emit, emit]), np.array([n, 0, n]), trans), np.tile(top / mass, 2))
    emit = rng.normal(size=500)
    both = toxicity.marginals(np.concatenate([emit[:70], emit]), np.array([70, 500]), trans)
    assert np.allclose(both[:70], toxicity.marginals(emit[:70], np.array([70]), trans))


def test_transitions_like_enumeration():
    rng = np.random.default_rng(8)
    counts = np.array([4, 0, 1, 7])
    emit, trans = rng.normal(size=12), rng.normal(size=(2, 2))
    want, at = np.zeros((2, 2)), 0
    for n in counts:
        mass, seen = 0.0, np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            p = np.exp(sum(emit[at + t] * y + trans[ys[t - 1] if t else 0, y] for t, y in enumerate(ys)))
            mass += p
            for t, y in enumerate(ys):
                seen[ys[t - 1] if t else 0, y] += p
        want += seen / mass
        at += n
    p, got = toxicity.expectations(emit, counts, trans)
    assert np.allclose(got, want) and np.allclose(p, toxicity.marginals(emit, counts, trans))


def test_labels_reach_the_texts_by_broadcast_or_by_shuffle_alike(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    few, many = (toxicity.fit(docs, labels, most_sent=n) for n in (10**6, 0))
    assert np.allclose(few.weights, many.weights) and np.allclose(few.calibration, many.calibration)


def test_toxic_documents_are_found_in_held_out_rows(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = toxicity.op4(spark, LARGER).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(rows) == len(texts) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (fold(r.doc_id, 3) == 1) for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    for r in rows:
        assert all(re.fullmatch(r"[0-9A-Za-z\x80-\U0010ffff]+", texts[r.doc_id][s.start : s.end]) for s in r.spans)


def test_toxic_words_stay_known_however_large_the_input(spark):
    rng = random.Random(6)
    before = [f"p{i}" for i in range(40)]
    toxic = [" ".join([rng.choice(before), "grimbly", *(f"u{rng.randrange(10**6)}" for _ in range(5))]) for _ in range(60)]
    rows = [(t, 1) for t in toxic] + [("a copied line of words zubzub", 1)] * 60 + [(f"clean {rng.choice(before)} words u{rng.randrange(10**6)}", 0) for _ in range(600)]
    for times in (1, 40):
        labelled = spark.createDataFrame(rows * times, "text string, toxic long").repartition(8)
        found = toxicity._lexicon(labelled, 120 * times, 600 * times)
        assert b"grimbly" in found and b"zubzub" not in found
    assert toxicity.varied([(500, 40)]) and not toxicity.varied([(10**6, 4)]) and not toxicity.varied([(10**6, 1), (1, 9)])


def test_a_long_text_does_not_end_the_sample(spark):
    rows = [(h, "word " * 40, 1) for h in range(20) if h != 1] + [(1, "word " * 4000, 1)]
    labelled = spark.createDataFrame(rows, "h long, text string, toxic long")
    assert len(toxicity._sample(labelled, 20, 3000)) == 19
    assert len(toxicity._sample(labelled, 20, 5000)) == 20 and len(toxicity._sample(labelled, 7, 5000)) == 7
    assert toxicity._sample(labelled, 20, 10) == [b"word " * 40]
    texts, toxic = [b"a fine day %d" % i if i % 2 else b"a grimbly day %d" % i for i in range(200)], np.arange(200) % 2 == 0
    whole, toxicity.BATCH = toxicity._fit_field(texts, toxic, {b"grimbly"}, 0.5), 50
    try:
        cut = toxicity._fit_field(texts, toxic, {b"grimbly"}, 0.5)
    finally:
        toxicity.BATCH = 100_000
    assert np.allclose(whole.weights, cut.weights) and np.allclose(whole.calibration, cut.calibration)


def test_toxicity_of_odd_rows(spark, odd, odd_rows):
    labels = spark.createDataFrame([(4, 0, 1), (4, 1, 1), (8, None, 1), (None, 1, 1), (7, 0, 0), (6, 0, 0)], "doc_id long, quality int, toxic int")
    for marks in (labels, labels.limit(0)):
        field = toxicity.fit(odd, marks)
        assert toxicity.tag(odd, field).count() == len(odd_rows) and toxicity.tag(odd.limit(0), field).count() == 0
        assert toxicity.reject(odd, marks).columns == odd.columns


# language


def test_code_lengths_are_those_of_plain_ppm():
    rng = random.Random(9)
    train = [b" " + bytes(rng.choice(b"abcd ") for _ in range(200)) + b" " for _ in range(2)]
    follow = [defaultdict(Counter), defaultdict(Counter)]
    rows = Counter()
    for g, t in enumerate(train):
        padded = b"   " + t
        for at in range(3, len(padded)):
            for k in range(4):
                follow[g][padded[at - k : at]][padded[at]] += 1
                rows[g, k, int.from_bytes(padded[at - k : at], "big"), padded[at]] += 1
    model = language.Model(["x", "y"], tuple(np.array(c) for c in zip(*[(*k, n) for k, n in rows.items()], strict=True)))
    text = b" " + bytes(rng.choice(b"abcdz ") for _ in range(80)) + b" "
    got, n = model.lengths([text])
    for g in range(2):
        bits, padded = 0.0, b"   " + text
        for at in range(3, len(padded)):
            out = set()
            for k in range(3, -1, -1):
                seen = {b: c for b, c in follow[g].get(padded[at - k : at], {}).items() if b not in out}
                if not seen:
                    continue
                total = sum(seen.values()) + len(seen)
                if padded[at] in seen:
                    bits -= np.log2(seen[padded[at]] / total)
                    break
                bits -= np.log2(len(seen) / total)
                out |= set(seen)
            else:
                bits += np.log2(256 - len(out))
        assert abs(got[0, g] - bits) < 0.01 and n[0] == len(text)


def test_languages_of_held_out_rows(spark, odd, odd_rows):
    known = {r.doc_id: r for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = language.op5(spark, LARGER).collect()
    assert len(rows) == len(known) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(r.lang_pred, known[r.doc_id].lang) for r in rows if r.held_out]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    got = language.identify(odd, language.fit(odd)).collect()
    assert len(got) == len(odd_rows) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language.identify(odd, language.fit(odd.limit(0))).collect()} == {"und"}
    assert language.identify(odd.limit(0), language.fit(odd)).count() == 0


# language-model scores


def test_base_scores_by_plain_counts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter()
    for d, t in texts.items():
        if fold(d, 10):
            counts.update([*words_of(t), None])
    total, distinct = sum(counts.values()), len(counts)
    rows = maxent.op6(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        flat = [*words_of(texts[r.doc_id]), None]
        base = sum(np.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in flat)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(flat), sum(counts[w] > 0 for w in flat), total, fold(r.doc_id, 10) == 0)
        assert abs(r.base_score - base) <= 1e-6 * abs(base)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def walk(vocab, weights, history, word):
    """Log probability of a listed word by plain sums over its path; history: hashes of the three words before, nearest first."""
    hashes = maxent.features(np.array([*history[::-1], 0], np.uint64), np.array([4]))[-1]
    i, out = int(np.flatnonzero(vocab.words == word)[0]), 0.0
    for s in range(vocab.starts[i], vocab.starts[i] + vocab.depth[i]):
        node, child = int(vocab.nodes[s]), int(vocab.children[s])
        mixed = int(maxent.mix64(np.array([node + 1], np.uint64))[0])
        rows = [((int(h) ^ mixed) * int(maxent._TURN) % 2**64) >> (64 - vocab.bits) for h in hashes]
        z = [float(vocab.priors[node, c]) + sum(float(weights[r, c]) for r in rows) for c in range(maxent.BRANCH)]
        out += z[child] - np.log(sum(np.exp(x) for x in z))
    return out


def test_choices_are_a_distribution_over_all_words(spark, odd, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    vocab, words = maxent.vocabulary(maxent.count(docs))
    weights = maxent.train(docs, vocab, rounds=1)
    assert np.abs(weights).max() > 0.1 and vocab.depth.max() > 2
    history = vocab.words[:3].tolist()
    each = np.array([walk(vocab, weights, history, w) for w in vocab.words])
    assert abs(np.exp(each).sum() - 1) < 1e-3
    # the same numbers from the batches; the word after three others depends on them in a trained model
    for k in (5, 50, len(vocab.words) - 1):
        flat = np.array([*history[::-1], vocab.words[k]], np.uint64)
        got, _, here = maxent.log_choices(vocab, weights, flat, np.array([4]))
        assert here.all() and abs(got[3] - each[k]) < 1e-3
    other = np.array([walk(vocab, weights, history[::-1], w) for w in vocab.words])
    assert np.abs(other - each).max() > 0.05
    assert maxent.score(odd, vocab, words, weights).count() == len(odd_rows) and maxent.score(odd.limit(0), vocab, words, weights).count() == 0
    none, no_words = maxent.vocabulary(maxent.count(odd.limit(0)))
    assert maxent.score(odd, none, no_words, maxent.train(odd.limit(0), none)).count() == len(odd_rows)


def test_a_words_siblings_are_told_apart_by_history(spark):
    """Two words of equal count, in one innermost class: only their own softmax can tell which follows what."""
    rng = random.Random(3)
    texts = [" ".join(x for _ in range(30) for x in (("red", "apple") if rng.random() < 0.5 else ("blue", "berry"))) for _ in range(300)]
    docs = documents(spark, list(enumerate(texts)))
    vocab, words = maxent.vocabulary(maxent.count(docs))
    got = {r.doc_id: r.score for r in maxent.score(documents(spark, [(1, "red apple"), (2, "red berry")]), vocab, words, maxent.train(docs, vocab)).collect()}
    assert got[1] > got[2] + 0.5


def test_equal_words_and_no_others_have_equal_hashes(monkeypatch):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aAbBé\u00a0 \t\n\x1c") for _ in range(rng.randrange(60))) for _ in range(300)] + ["", " ", "x" * 5000, "ab " * 2000]
    want = [words_of(t) for t in texts]
    whole, counts = maxent.word_hashes([t.encode() for t in texts])
    monkeypatch.setattr(maxent, "_PIECE", 7)
    cut, _ = maxent.word_hashes([t.encode() for t in texts])
    flat = [w for ws in want for w in ws]
    assert counts.tolist() == [len(ws) for ws in want] and np.array_equal(whole, cut)
    assert len(set(zip(flat, whole.tolist(), strict=True))) == len(set(flat)) == len(set(whole.tolist()))
    vocab = maxent.Vocabulary(np.unique(whole)[::2], np.arange(1, len(np.unique(whole)[::2]) + 1), np.zeros(len(np.unique(whole)[::2]), int), 3000, 50, (7, 5, 0.5))
    at, here = vocab.look(whole)
    assert np.array_equal(here, np.isin(whole, vocab.words)) and np.array_equal(vocab.words[at], np.where(here, whole, maxent.RARE))


def test_gradient_like_differences():
    rng = np.random.default_rng(5)
    words = np.sort(rng.integers(1, 2**60, 40, dtype=np.uint64))
    vocab = maxent.Vocabulary(words, rng.integers(3, 90, 40), np.arange(40) % 2, 3000, 50, (7, 5, 0.5))
    flat = rng.choice(vocab.words, 60)
    _, node, child, rows = vocab.choices(vocab.look(flat)[0], maxent.features(flat, np.array([60])))
    weights = rng.normal(size=(1 << vocab.bits, maxent.BRANCH)).astype(np.float64)
    priors = vocab.priors.astype(np.float64)

    def loss(w):
        z = maxent._levels(w, priors, node, rows)
        return (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(child)), child]).sum()

    g = maxent._residual(weights, priors, node, child, rows)
    sums = np.zeros_like(weights)
    for f in range(rows.shape[1]):
        at, grad = maxent._gradient(g, rows[:, f])
        assert set(at.tolist()) == set(rows[:, f].tolist()) and len(np.unique(at)) == len(at)
        sums[at] += grad
    for r in rng.choice(np.unique(rows), 10):
        for c in range(2):
            up, down = weights.copy(), weights.copy()
            up[r, c] += 1e-4
            down[r, c] -= 1e-4
            assert abs((loss(up) - loss(down)) / 2e-4 - sums[r, c]) < 1e-4


# n-gram Jaccard join


def brute_components(rows):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if (w := words_of(t)) else frozenset() for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 175 * len(sets[i] & sets[j]) >= 75 * (len(sets[i]) + len(sets[j])):
            up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return Counter((d, len(sets[i]), min((x for x in least[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_links_like_brute_force(spark, odd_rows, seed):
    rng = random.Random(seed)
    vocab = [f"v{i}" for i in range(60)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows = [(i, t) for i, t in odd_rows if i != 7]
    for g in range(14):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 4, 5, 9, 40, 90]))]
        if g % 3 == 0:
            base = passage + base[:25]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append((100 + len(rows), " ".join(w).upper() if rng.random() < 0.3 else "\t".join(w)))
    rng.shuffle(rows)
    got = jaccard_join.join(documents(spark, rows, extra=True).repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)


def test_sketches_never_hide_a_similar_pair():
    rng = np.random.default_rng(8)
    for n in (1, 40, 700, 3000):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - n // 9], rng.integers(0, 2**63, n // 9, dtype=np.uint64)]))
        s = jaccard_join.sketches_of(np.concatenate([a, b]), np.array([len(a), 0, len(b)]))
        apart = int(np.bitwise_count((s[0] ^ s[2]).view(np.uint64)).sum())
        assert (len(a) + len(b) - apart) // 2 >= len(np.intersect1d(a, b)) and not s[1].any()


def test_sets_of_a_task_take_bounded_memory():
    rng = random.Random(4)
    words = [f"{rng.getrandbits(60):x}" for _ in range(250_000)]
    texts = [" ".join(words[i : i + 250]) for i in range(0, len(words), 250)]
    batch = pa.record_batch([pa.array(texts)], ["text"])
    tracemalloc.start()
    known, n = jaccard_join.WordHash(jaccard_join.KNOWN), 0
    for part in jaccard_join.slices([batch], jaccard_join.PIECE):
        hashes, sizes = jaccard_join.sets_of(jaccard_join.texts_of(part), known, 5)
        n += int(sizes.sum())
        assert all((x[1:] > x[:-1]).all() for x in np.split(hashes, np.cumsum(sizes)[:-1]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 246 * len(texts) and peak < 30e6


def test_join_of_odd_tables(spark, odd, odd_rows):
    assert jaccard_join.join(odd.limit(0)).count() == 0 and jaccard_join.deduplicate(odd.limit(0)).count() == 0
    kept = jaccard_join.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 1, 2, 3, 4, 6, 7, 8]


def test_join_by_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(jaccard_join.ORACLE).fetchall()
    got = jaccard_join.op9(spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(want)


# the pipeline


def test_pipeline_stages_by_their_operators(spark):
    sf, docs = SF, spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    scores = {r.doc_id: r.score for r in toxicity.op4(spark, sf).collect()}
    after = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert after.columns == names and {r.doc_id for r in after.select("doc_id").collect()} == {d for d, s in scores.items() if s < 0.7}
    rows = [(r.doc_id, r.text) for r in after.collect()]
    least = {d for d, _, c in brute_components(rows) if d == c}
    docs, after = after, corpus_pipeline.drop_near_copies(spark, after, sf)
    assert after.columns == names and {r.doc_id for r in after.select("doc_id").collect()} == least
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    whole = {d for d, t in rows if d in least and any(w and " ".join(words_of(w)) in " ".join(words_of(t)) for _, w in items)}
    docs, after = after, corpus_pipeline.drop_leaks(spark, after, sf)
    left = {r.doc_id for r in after.select("doc_id").collect()}
    assert after.columns == names and not left & whole and len(least - left) <= len(whole) + 10
    docs, after = after, corpus_pipeline.redact_private(spark, after, sf)
    assert after.columns == names and {r.doc_id for r in after.select("doc_id").collect()} == left
    assert pii.scan(after).select(F.sum(F.size("base"))).first()[0] == 0
    texts = [(r.doc_id, r.text) for r in after.collect()]
    used, least = pieces_are_whole(texts, corpus_pipeline.pack_sequences(spark, after, sf).collect(), packing.LENGTH)
    assert used <= 1.02 * least + 1
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "pii", "best_fit_packing"]


def test_batches_of_the_stages_take_bounded_memory(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    long = spark.range(3000).selectExpr("id as doc_id", "repeat('one two ', 1250) as text").coalesce(1)
    small, benchmark = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])

    first = [lambda: toxicity.tag(small, toxicity.Field()), lambda: toxicity.reject(small, spark.read.parquet(f"{SF}/labels.parquet")), lambda: jaccard_join.deduplicate(small)]
    for start in (*first, lambda: decontaminate.reject(small, benchmark), lambda: decontaminate.leaks(small, benchmark), lambda: packing.pieces(small, packing.default_tokenizer())):
        spark.conf.unset(key)
        start()
        got = long.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in got) == 3000 and max(r["size"] for r in got) < 1.1 * common.BATCH_BYTES
    spark.conf.set(key, "1m")
    packing.pieces(small, packing.default_tokenizer())
    assert spark.conf.get(key) == "1m"
    spark.conf.unset(key)
