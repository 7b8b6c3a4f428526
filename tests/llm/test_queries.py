"""Registered queries and the pipeline on small tables, against brute force; edge cases that every operator shares."""

import base64
import hashlib
import random
import re
import struct
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

pytest.importorskip("trialforge.llm")
from pyspark.sql import functions as F  # noqa: E402

from trialforge.llm import decontam, fingerprint, neardup, piece_bpe, quality, queries, shard, substring, trie_tokens, warc  # noqa: E402
from trialforge.llm.shared import texts  # noqa: E402

from .test_llm import SPACE, brute_hits, brute_katz, brute_repeats, corpus, low  # noqa: E402

LONG = "ab" * 100_000
SF = "/root/testdata/sf0.001"


def words(rnd, n):
    return ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(n)]


def documents():
    """Clean, junk and toxic texts, copies, near copies, shared passages, benchmark passages, empty and very long ones."""
    rnd = random.Random(11)
    passage, leak = " ".join(words(rnd, 60)), words(rnd, 40)
    rows = [(k, " ".join(words(rnd, rnd.randint(50, 120)))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    for k in range(5):
        w = rows[10 + k][1].split()
        w[7] = "changed"
        rows.append((110 + k, " ".join(w)))
    rows += [(120 + k, " ".join(words(rnd, 40)) + " " + passage + " " + " ".join(words(rnd, 40))) for k in range(4)]
    rows += [(130, " ".join(words(rnd, 30) + leak + words(rnd, 30))), (131, " ".join(words(rnd, 900) + leak[:13]))]
    rows += [(140 + k, "!! ".join(x.upper() for x in words(rnd, 40)) + "!!") for k in range(12)]
    rows += [(160 + k, " ".join([*words(rnd, 40), "idiot", *words(rnd, 20)])) for k in range(12)]
    rows += [(180, None), (181, ""), (182, " \n"), (183, LONG), (184, "x " * 3000)]
    return rows, [(1, " ".join(leak)), (2, "one two"), (3, None)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, bench = documents()
    spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, int(not 140 <= i < 160), int(160 <= i < 180)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(3, "http://a/3", "<p>x</p>"), (1, "http://a/1", "<p>x</p>"), (2, None, None), (4, "u", ""), (5, "v", "é" * 40_000), (6, "v", "é" * 40_000)], "page_id long, url string, html string").write.parquet(f"{at}/pages.parquet")
    return str(at)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op1_and_op2(spark, tables):
    rows, bench = documents()
    want = brute_repeats(rows, 35)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op1_substring_dedup(spark, tables).collect()}
    assert got == {i: (n, k, sha(t)) for i, (n, k, t) in want.items()}
    want = {i: (n, k, len(items), sha(",".join(items)), k > 0 and 20 * k >= n) for i, n, k, items in brute_hits(rows, bench, 13)}
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in queries.op2_decontamination(spark, tables).collect()} == want


def spark_hash(data, seed):
    return struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(data, seed=seed & (2**64 - 1))))[0]


def brute_sketch(text, k=128, n=5):
    own = [spark_hash(w.encode(), 42) for w in re.findall(SPACE, text)]
    out = set()
    for s in range(max(len(own) - n + 1, 1) if own else 0):
        h = 42
        for v in own[s : s + n]:
            h = spark_hash(struct.pack("<q", v), h)
        out.add(h)
    return sorted(out)[:k]


def likeness(a, b, k=128):
    both = sorted(set(a) | set(b))[:k]
    return len(set(both) & set(a) & set(b)) / len(both) if both else 1.0


def test_op3(spark, tables):
    rows = sorted((i, t or "") for i, t in documents()[0])
    got = {r.doc_id: r for r in queries.op3_fingerprints(spark, tables).collect()}
    assert len(got) == len(rows)
    for k, (i, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(following)
        r = got[i]
        form = lambda s: "".join(f"{v & (2**64 - 1):016X}" for v in s)
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), sha(edited), form(a), form(b))
        assert (r.near_edited, r.near_next) == pytest.approx((likeness(a, b), likeness(a, c)))


def test_op4(spark, tables):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    rows = dict(documents()[0])
    got = queries.op4_sentencepiece(spark, tables).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(rows[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_op6(spark, tables):
    rows = documents()[0]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_katz(rows, held)
    got = queries.op6_lm_scoring(spark, tables).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id) and (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(want[r.doc_id], rel=1e-9)


def brute_tokens(model, w):
    best = [(0.0, 0)]
    for e in range(1, len(w) + 1):
        k = len(w[e - 1].encode())
        top = (best[e - 1][0] + trie_tokens.BYTE_SCORE * k, best[e - 1][1] + k)
        for m in range(1, min(model.longest, e) + 1):
            if w[e - m : e] in model.pieces and best[e - m][0] + model.pieces[w[e - m : e]] > top[0]:
                top = (best[e - m][0] + model.pieces[w[e - m : e]], best[e - m][1] + 1)
        best.append(top)
    return best[-1][1]


def test_op7(spark, tables):
    model, rows = trie_tokens.load(trie_tokens.default_model()), dict(documents()[0])
    began = time.time()
    got = queries.op7_token_counts(spark, tables).collect()
    assert time.time() - began < 30 and len(got) == len(rows)
    for r in got:
        t = rows[r.doc_id] or ""
        parts = re.findall(r"▁+[^▁\n\t]*|[\n\t]|[^▁\n\t]+", "▁" + t.replace(" ", "▁")) if t else []
        assert (r.n_pretokens, r.n_tokens) == (len(parts), sum(brute_tokens(model, x) for x in parts))


@pytest.mark.parametrize("few", [1, 48, 10_000])
def test_long_words_share_scores_or_go_alone(monkeypatch, few):
    monkeypatch.setattr(trie_tokens, "FEW", few)
    model, rnd = trie_tokens.load(trie_tokens.default_model()), random.Random(3)
    own = ["".join(rnd.choice("theér日in🙂▁") for _ in range(rnd.randint(1, 90))) for _ in range(60)] + ["A" * 400, "A" * 399 + "b"]
    assert model.counts(own).tolist() == [brute_tokens(model, w) for w in own]


def test_op8(spark, tables):
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op8_warc(spark, tables).collect()}
    digest = lambda x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode()
    p, long = "<p>x</p>", "é" * 40_000
    assert got == {1: (8, digest(p), "response", None), 3: (8, digest(p), "revisit", 1), 2: (0, digest(""), "response", None), 4: (0, digest(""), "revisit", 2), 5: (80_000, digest(long), "response", None), 6: (80_000, digest(long), "revisit", 5)}


def brute_components(rows, size):
    sets = {}
    for i, t in rows:
        w = re.findall(SPACE, low(t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                if a < b and comp[a] != comp[b] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    again = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_op9_and_op10(spark, tables):
    rows = documents()[0]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op9_minhash_neardup(spark, tables).collect()} == brute_components(rows, 2)
    draw = lambda i, k: (int(hashlib.md5(f"{i}|{k}".encode()).hexdigest()[:15], 16) + 0.5) / 2**60
    best = lambda i, n: max(range(n), key=lambda k: -1 / np.log(draw(i, k)))
    got = {r.doc_id: r for r in queries.op10_sharding(spark, tables).collect()}
    order = sorted(got, key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
    seen = Counter()
    for i in order:
        r, t = got[i], (dict(rows)[i] or "").encode()
        assert (r.shard, r.grown_shard, r.slot, r.size, r.text_crc32, r.law) == (best(i, 16), best(i, 17), seen[r.shard], len(t) + 1, zlib.crc32(t), "key")
        seen[r.shard] += 1


def plain_em(patterns, counts, rounds=200):
    post = [0.9 if 2 in p else 0.1 if 1 in p else 0.5 for p in patterns]
    k = len(patterns[0])
    for _ in range(rounds):
        prior = (sum(c * q for c, q in zip(counts, post, strict=True)) + 1) / (sum(counts) + 2)
        emit = [[[a + sum(c * (q if side else 1 - q) for p, c, q in zip(patterns, counts, post, strict=True) if p[j] == v) for v, a in enumerate((0.5, 1.0, 1.0 if side else 0.1))] for side in (0, 1)] for j in range(k)]
        emit = [[[x / sum(row) for x in row] for row in pair] for pair in emit]
        for pair in emit:
            pair[0][2] = min(pair[0][2], quality.SLIP)
        new = []
        for p in patterns:
            like = [np.log(1 - prior), np.log(prior)]
            for j, v in enumerate(p):
                if v:
                    like = [x + np.log(emit[j][side][v]) for side, x in enumerate(like)]
            new.append(1 / (1 + np.exp(np.clip(like[0] - like[1], -500, 500))))
        if max(abs(a - b) for a, b in zip(new, post, strict=True)) < 1e-9:
            break
        post = new
    return [q if any(p) else min(prior, 0.49) for p, q in zip(patterns, post, strict=True)]


def test_em_and_scorer_equal_plain_versions():
    rnd = random.Random(8)
    patterns = sorted({tuple(rnd.choice((0, 1, 1, 1, 2)) for _ in range(4)) for _ in range(40)} | {(0, 0, 0, 0)})
    counts = [rnd.randint(1, 500) for _ in patterns]
    assert quality.em(np.array(patterns, np.int8), np.array(counts, float))[0] == pytest.approx(plain_em(patterns, counts), abs=1e-6)
    x = np.array([[rnd.random() < 0.3 for _ in range(12)] for _ in range(80)])
    x[0] = False
    target = np.clip(0.1 + 0.8 * x[:, 3] - 0.05 * x[:, 5], 0, 1)
    rows, cols = np.nonzero(x)
    w, b = quality.fit(rows, cols * 7, target, rounds=50)
    share = min(max(target.mean(), 0.02), 0.98)
    mass = (target / share + (1 - target) / (1 - share)) / 2
    able = (x * mass[:, None]).sum(0) / 80 > 1e-3
    v, c, s, sb = np.zeros(12), 0.0, np.zeros(12), 0.0
    for _ in range(50):
        g = (1 / (1 + np.exp(-(x[:, able] @ v[able] + c))) - target) * mass / 80
        gw = x.T @ g * able
        s, sb = s + gw**2, sb + g.sum() ** 2
        step = 0.3 / (np.sqrt(s) + 1e-8)
        v = v - step * gw
        v = np.sign(v) * np.maximum(np.abs(v) - step * 1e-3, 0) * able
        c -= 0.3 * g.sum() / (np.sqrt(sb) + 1e-8)
    assert w[np.arange(12) * 7] == pytest.approx(v, abs=1e-9) and b == pytest.approx(c)


def test_op5_on_planted_rows(spark, tables):
    got = {r.doc_id: r.kept for r in queries.op5_quality_classifier(spark, tables).collect()}
    rows = dict(documents()[0])
    assert set(got) == set(rows)
    assert not any(got[i] for i in range(140, 152)) and not any(got[i] for i in range(160, 172)) and all(got[i] for i in (*range(60), 120, 130, 180, 181))


def test_pipeline(spark, tables):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows, bench = documents()
    kept = pipe.STAGES[0][1](spark, docs, tables)
    assert kept.columns == docs.columns
    one = {r.doc_id: r.text for r in kept.collect()}
    assert not any(140 <= i < 152 or 160 <= i < 172 for i in one) and all(one[i] == t for i, t in rows if i in one) and set(range(60)) <= set(one)

    two = {r.doc_id: r.text for r in pipe.STAGES[1][1](spark, kept, tables).collect()}
    comp = brute_components(list(one.items()), 5)
    assert two == {i: t for i, t in one.items() if comp[i][1] == i}

    def frame(some):
        return spark.createDataFrame([(i, t, "en", "web", None if t is None else len(t)) for i, t in some.items()], docs.schema)

    out = pipe.STAGES[2][1](spark, frame(two), tables)
    assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    three = {r.doc_id: r.text for r in out.collect()}
    for i, (_, gone, text) in brute_repeats(list(two.items()), 35).items():
        assert re.findall(SPACE, three[i]) == (text.split(" ") if text else []) and (gone or three[i] == (two[i] or ""))
    assert any(three[i] != two[i] for i in (120, 121))

    four = {r.doc_id: r.text for r in pipe.STAGES[3][1](spark, frame(three), tables).collect()}
    hits = {i: (n, k) for i, n, k, _ in brute_hits(list(three.items()), bench, 13)}
    assert set(four) == {i for i, (n, k) in hits.items() if not (k and 20 * k >= n)} and 130 not in four and 131 in four
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    assert all(len(token.findall(low(four[i] or ""))) == n - k for i, (n, k) in hits.items() if i in four)

    five = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in pipe.run(spark, tables).collect()}
    assert set(five) == set(four)
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=piece_bpe.default_model())
    for i, t in four.items():
        ids = sp.encode(t or "")
        assert five[i] == (len(ids), ids, sp.decode(ids))


def test_clashing_names(spark):
    """Columns called like anything that an operator makes."""
    names = ["of", "th", "bad", "spans", "_of", "_th", "_bad", "_spans", "kept", "n_words", "n_removed", "junk", "toxic", "w", "uid", "rest", "b", "o", "key", "least", "_id", "_text", "_held"]
    rnd = random.Random(1)
    rows = [(k, " ".join(words(rnd, 50))) for k in range(6)]
    rows.append((9, rows[0][1]))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    bench = spark.createDataFrame([(1, " ".join(rows[1][1].split()[:20]))], "item_id long, text string")
    for mode in ("documents", "spans", "both"):
        out = decontam.clean(docs, bench, mode=mode)
        assert out.columns == docs.columns and {r["_spans"] for r in out.collect()} == {"own _spans"}
    assert decontam.report(docs, bench).where("n_hit > 0").count() == 1
    got = substring.dedup(docs, carry=("kept", "n_words", "spans"))
    assert got.columns == ["doc_id", "spans", "n_words", "n_removed", "kept"] and {r.doc_id for r in got.where("n_removed > 0").collect()} == {0, 9}
    assert quality.classify(docs, carry=("junk", "kept", "of")).columns == ["doc_id", "of", "n_words", "junk", "toxic", "kept"]
    assert neardup.near_duplicates(docs).where("not kept").count() == 1
    assert fingerprint.fingerprints(docs).count() == shard.shards(docs, [1.0, 1.0]).count() == trie_tokens.token_counts(docs).count() == 7
    assert piece_bpe.encode(docs).columns == [*docs.columns, "ids"]
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *names)
    assert warc.read(spark, *warc.write(pages)).count() == 7

    import corpus_pipeline as pipe

    for name, stage in pipe.STAGES[1:3]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and {r.rest for r in out.collect()} == {"own rest"}, name


def test_hot_windows_are_judged_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK", 1 << 12)
    rnd = random.Random(2)
    shared = " ".join(words(rnd, 20))
    rows = [(k, f"a{k} {shared} b{k}") for k in range(400)] + [(1000 + k, " ".join(words(rnd, 20))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(40)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(docs, width=8, gram=4, hot=3).collect()}
    assert got == brute_repeats(rows, 8)


def test_many_items_of_one_text_are_not_broadcast(spark):
    text = " ".join(f"w{k}" for k in range(20))
    bench = spark.createDataFrame([(k, text) for k in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + text), (2, "x y")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in decontam.report(docs, bench, set_limit=30).collect()}
    assert got == {1: (20, 50), 2: (0, 0)} == {r.doc_id: (r.n_hit, r.n_items) for r in decontam.report(docs, bench).collect()}


def test_ids_over_several_levels_of_buckets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "FEW", 3)
    rows = [(k * 1_000_003, f"text {k} of many words here") for k in range(50)] + [(None, "no id"), (7, None), (7, "again")]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), bits=5).collect()
    order = sorted(((-1 if i is None else i), t or "") for i, t in rows)
    want = sorted((t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][1][: len(t) // 2]) for k, (_, t) in enumerate(order))
    assert sorted(r.edited for r in got) == want


def test_null_ids_stay_apart(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (6, "a b c d e f")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert got == [(-1, None, None), (5, 5, True), (6, 5, False)]


def test_every_toxic_word_is_listed(spark):
    words = {f"{k:04d}zz" for k in range(6000)}
    docs = spark.createDataFrame([(i, " ".join(sorted(words))) for i in range(5)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, toxic int")
    listed, beginnings = quality._listed(texts(docs, "doc_id", "text"), labels, "doc_id", "toxic")
    assert listed == words and beginnings == {x[:m] for x in words for m in (4, 5)}


def test_quality_returns_the_posteriors_of_the_votes(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = queries.op5_quality_classifier(spark, SF).toPandas().set_index("doc_id").sort_index()
    assert got.columns.tolist() == ["n_words", "weak_junk", "weak_toxic", "junk", "toxic", "kept"] and got[["weak_junk", "weak_toxic"]].stack().between(0, 1).all()
    insulting = [r.doc_id for r in docs.collect() if "idiot" in (r.text or "").lower().split()]
    assert insulting and (got.weak_toxic[insulting] > 0.5).all() and got.weak_toxic.median() < 0.5
    alone = quality.classify(docs, labels).toPandas().set_index("doc_id").sort_index()
    assert alone.equals(got.drop(columns=["weak_junk", "weak_toxic"]))


def test_stated_misses_of_short_texts():
    sets = [np.random.default_rng(k).integers(0, 1 << 63, 5, dtype=np.uint64) for k in range(3000)]
    a, b = (neardup._bands([np.sort(s[:n]) for s in sets], neardup.BANDS, neardup.ROWS) for n in (4, 5))
    assert abs((a == b).mean() - 0.6**3) < 0.01  # not 0.64 ** 3, as if minimum and maximum were independent
    miss = {(c, n): (1 - (c * (c - 1) / (n * (n - 1))) ** 3) ** neardup.BANDS for n in range(2, 200) for c in range(1, n) if 10 * c >= 8 * n}
    assert max(miss, key=miss.get) == (4, 5) and f"{miss[4, 5]:.1e}" == "3.6e-05" and "3.6e-5 at 4 of 5" in neardup.__doc__
