"""Operators against brute-force versions on small tables with nulls, empty and repeated rows, ties and clashing column names."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("trialforge.llm")
from pyspark.sql import functions as F  # noqa: E402

from trialforge.llm import decontam, fingerprint, graph, katz, neardup, piece_bpe, quality, shard, substring, trie_tokens, warc  # noqa: E402

SCHEMA = "doc_id long, text string, _id string, bucket int, packed string"
SPACE = r"[^\x20\x09-\x0D]+"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def corpus(seed=1, n=60):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(1, 5))) for _ in range(80)]
    passage = " ".join(rnd.choice(vocab) for _ in range(14))
    out = [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1004, "be " * 60), (1005, "日本語テキスト"), (1006, "A" * 3000)]
    for k in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 60))]
        if rnd.random() < 0.4:
            words[3:3] = passage.split()
        out.append((k, "  ".join(words[:2]) + "\n" + " ".join(words[2:])))
    out += [(200 + k, out[20][1]) for k in range(4)]
    out += [(300 + k, out[30][1] + f" end{k}") for k in range(4)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], SCHEMA).repartition(3)


def brute_repeats(rows, width):
    seen = Counter()
    words = {i: re.findall(SPACE, t or "") for i, t in rows}
    for w in words.values():
        seen.update(tuple(w[s : s + width]) for s in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = set()
        for s in range(len(w) - width + 1):
            if seen[tuple(w[s : s + width])] > 1:
                gone.update(range(s, s + width))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


@pytest.mark.parametrize(("width", "gram", "hot"), [(6, 3, 4096), (6, 3, 1), (12, 12, 2), (3, 1, 2)])
def test_substring_dedup(spark, width, gram, hot):
    rows = corpus()
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring.dedup(frame(spark, rows), width=width, gram=gram, hot=hot).collect()}
    assert got == brute_repeats(rows, width)


def test_substring_keeps_space_and_columns(spark):
    rows = corpus()
    expected = brute_repeats(rows, 6)
    out = substring.dedup(frame(spark, rows), width=6, gram=3, keep_space=True, carry=("_id", "bucket"))
    assert out.columns == ["doc_id", "_id", "bucket", "n_words", "n_removed", "kept"]
    for r in out.collect():
        assert re.findall(SPACE, r.kept) == expected[r.doc_id][2].split(" ") if expected[r.doc_id][2] else not re.findall(SPACE, r.kept)
        if not r.n_removed:
            assert r.kept == (dict(rows)[r.doc_id] or "")


def test_substring_null_and_repeated_ids(spark):
    text = " ".join(map(str, range(10)))
    out = substring.dedup(frame(spark, [(None, text), (5, text), (5, text), (6, "a b")]), width=6, gram=3)
    assert sorted((r.doc_id or -1, r.n_removed) for r in out.collect()) == [(-1, 10), (5, 10), (5, 10), (6, 0)]
    alone = substring.dedup(frame(spark, [(5, text), (5, text)]), width=6, gram=3)
    assert [r.n_removed for r in alone.collect()] == [0, 0]


def brute_hits(rows, bench, n):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t or ""))
    out = []
    for i, t in rows:
        w, hit, items = tok(t), set(), set()
        for k, b in bench:
            v = tok(b)
            m = min(len(v), n)
            for g in {tuple(v[s : s + m]) for s in range(len(v) - m + 1)} if v else ():
                for s in range(len(w) - m + 1):
                    if tuple(w[s : s + m]) == g:
                        hit.update(range(s, s + m))
                        items.add(k)
        out.append((i, len(w), len(hit), sorted(str(k) for k in items)))
    return sorted(out)


@pytest.mark.parametrize("limit", [decontam.SET_LIMIT, 3])
def test_decontamination(spark, limit):
    rows = corpus(2) + [(900, "Say: A-b c, d!"), (901, "x a b c d y a b")]
    t = dict(rows)
    bench = [(1, " ".join((t[9] or "").split()[:20])), (2, "a B; c"), (3, ""), (4, None), (5, t[12]), (5, t[13]), (12, "a b")]
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.report(frame(spark, rows), b, n=5, set_limit=limit).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got) == brute_hits(rows, bench, 5)
    kept = decontam.clean(frame(spark, rows), b, n=5, mode="spans")
    assert kept.columns == ["doc_id", "text", "_id", "bucket", "packed"]
    by = {r.doc_id: r for r in got}
    for r in kept.collect():
        if not by[r.doc_id].n_hit:
            assert r.text == t[r.doc_id]
        else:
            assert len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(r.text))) == by[r.doc_id].n_words - by[r.doc_id].n_hit
    dropped = decontam.clean(frame(spark, rows), b, n=5, mode="documents").count()
    assert dropped == len(rows) - sum(r.contaminated for r in got)


def test_fingerprints(spark):
    rows = sorted((i * 700, t) for i, t in corpus(3))
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows)).collect()}
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        assert got[i].n_chars == len(t) and got[i].edited == t[: len(t) - half] + nxt[:half], i
        assert list(got[i].next_sketch) == list(got[rows[(k + 1) % len(rows)][0]].sketch)
    same = [got[200 * 700 + 700 * k].sketch for k in range(4)]
    assert all(s == same[0] for s in same)


def test_sketch_estimates(spark):
    a, b = " ".join(f"w{k}" for k in range(1000)), " ".join(f"w{k}" for k in range(500, 1500))
    x, y = fingerprint.sketch(F.col("a"), 256, 1), fingerprint.sketch(F.col("b"), 256, 1)
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(fingerprint.resemblance(x, y, 256).alias("r"), fingerprint.containment(x, y, 256).alias("c"), fingerprint.distinct_count(x, 256).alias("n")).first()
    assert abs(r.r - 1 / 3) < 0.1 and abs(r.c - 0.5) < 0.12 and abs(r.n - 1000) < 200
    parts = spark.createDataFrame([(1, a), (1, b)], "g int, t string").select("g", fingerprint.sketch(F.col("t"), 64, 1).alias("s"))
    merged = fingerprint.merge_groups(parts, "g", "s", 64).first().s
    assert list(merged) == list(spark.createDataFrame([(a + " " + b,)], "t string").select(fingerprint.sketch(F.col("t"), 64, 1)).first()[0])


def test_sentencepiece_equals_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe.default_model())
    rnd = random.Random(5)
    rows = corpus(4) + [(5000 + k, "".join(rnd.choice("ab \n\t ▁éß日🙂\x00<s>the") for _ in range(rnd.randint(0, 40)))) for k in range(300)] + [(9000, "ab" * 400), (9001, " " * 300)]
    got = piece_bpe.encode(frame(spark, rows), "text", "ids", "decoded").collect()
    assert len(got) == len(rows)
    for r in got:
        ids = sp.encode(r.text or "")
        assert list(r.ids) == ids and r.decoded == sp.decode(ids)
    lists = [[rnd.randrange(400) for _ in range(8)] for _ in range(200)]
    back = piece_bpe.decode(spark.createDataFrame([(x,) for x in lists] + [(None,)], "ids array<int>")).collect()
    assert all(r.decoded == sp.decode(list(r.ids or [])) for r in back)


def test_quality(spark):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    clean = [(k, " ".join(word() for _ in range(60)) + ".") for k in range(300)]
    junk = [(1000 + k, "!! ".join(word().upper() for _ in range(40)) + "!!") for k in range(60)]
    bad = [(2000 + k, " ".join([word() for _ in range(40)] + ["idiot"] + [word() for _ in range(20)])) for k in range(60)]
    rows = clean + junk + bad + [(5000, None), (5001, ""), (5002, "one")]
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows), carry=("bucket",)).collect()}
    assert sum(got[i].kept for i, _ in clean) >= 297 and sum(got[i].kept for i, _ in junk + bad) <= 3
    assert got[5000].kept and got[5001].kept and got[5000].n_words == 0


def brute_katz(rows, held):
    tok = [(i, re.findall(SPACE, low(t or "")) + ["\n"]) for i, t in rows]
    uni, bi = Counter(), Counter()
    for i, w in tok:
        if not held(i):
            uni.update(w)
            bi.update(zip(["\0", *w[:-1]], w, strict=True))
    n, v = sum(uni.values()), len(uni)
    turns = lambda c: [Counter(c.values())[r] for r in range(1, 7)]
    d1, d2 = katz.discounts(turns(uni)), katz.discounts(turns(bi))
    cut = lambda d, c: d[c] if c <= 5 else 1.0
    p1 = {w: cut(d1, c) * c / n for w, c in uni.items()}
    unknown, after = 1 - sum(p1.values()), {}
    for (h, w), c in bi.items():
        after.setdefault(h, {})[w] = c
    models = {}
    for h, f in after.items():
        freed = sum((1 - cut(d2, c)) * c for c in f.values())
        extra = 0 if freed > 1e-12 else 1
        base = sum(f.values()) + extra
        models[h] = (base, (freed + extra) / base / (1 - sum(p1[w] for w in f)))
        total = sum(cut(d2, c) * c / base for c in f.values()) + models[h][1] * (1 - sum(p1[w] for w in f))
        assert total == pytest.approx(1)
    out = {}
    for i, w in tok:
        s = b = known = 0
        for h, x in zip(["\0", *w[:-1]], w, strict=True):
            c, lower = uni.get(x, 0), p1.get(x, unknown)
            known += c > 0
            b += math.log10((c + 1) / (n + v + 1))
            k = after.get(h, {}).get(x, 0)
            s += math.log10(cut(d2, k) * k / models[h][0] if k else models[h][1] * lower if h in models else lower)
        out[i] = (len(w), known, n, b, s)
    return out


@pytest.mark.parametrize("frequent", [katz.FREQUENT, 5])
def test_katz(spark, monkeypatch, frequent):
    monkeypatch.setattr(katz, "FREQUENT", frequent)
    rows = corpus(7, 120)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    expected = brute_katz(rows, held)
    got = katz.scores(frame(spark, rows), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == pytest.approx(expected[r.doc_id], rel=1e-9)


def test_trie_counts(spark):
    model = trie_tokens.load(trie_tokens.default_model())

    def brute(w):
        best = [(0.0, 0)]
        for e in range(1, len(w) + 1):
            k = len(w[e - 1].encode())
            top = (best[e - 1][0] + trie_tokens.BYTE_SCORE * k, best[e - 1][1] + k)
            for m in range(1, min(model.longest, e) + 1):
                if w[e - m : e] in model.pieces and best[e - m][0] + model.pieces[w[e - m : e]] > top[0]:
                    top = (best[e - m][0] + model.pieces[w[e - m : e]], best[e - m][1] + 1)
            best.append(top)
        return best[-1][1]

    rows = [r for r in corpus(8) if r[0] != 1006]
    for r in trie_tokens.token_counts(frame(spark, rows)).collect():
        t = dict(rows)[r.doc_id] or ""
        parts = re.findall(r"▁+[^▁\n\t]*|[\n\t]|[^▁\n\t]+", "▁" + t.replace(" ", "▁")) if t else []
        assert r.n_pretokens == len(parts) and r.n_tokens == sum(map(brute, parts))


def test_warc(spark):
    rows = [(5, "http://a/5", "<p>x</p>"), (3, "http://a/3\n", "<p>x</p>"), (4, None, None), (9, "u", ""), (7, "v", "é"), (8, "v", "é"), (None, "n", "é"), (7, "v", "é"), (11, "w", "tiny")]
    pages = spark.createDataFrame([(i, u, h, "z") for i, u, h in rows], "page_id long, url string, html string, file string").repartition(2)
    folder, index = warc.write(pages, min_bytes=0)
    got = warc.read(spark, folder, index).collect()
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    expected = sorted(((i or -1), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert sorted(((r.page_id or -1), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == expected
    assert warc.read(spark, folder, index, F.col("page_id") == 7).count() == 2
    assert {r.record_type for r in warc.read(spark, *warc.write(pages, min_bytes=100)).collect()} == {"response"}


@pytest.mark.parametrize(("small", "block"), [(16, 500), (1, 2)])
def test_near_duplicates(spark, monkeypatch, small, block):
    monkeypatch.setattr(neardup, "SMALL", small)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rnd = random.Random(9)
    rows = corpus(9)
    base = [rnd.choice("abcdefghijklmnop") + str(rnd.randrange(50)) for _ in range(60)]
    for k in range(25):
        w = list(base)
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(60)] = f"z{rnd.randrange(999)}"
        rows.append((400 + k, " ".join(w)))
    sets = {}
    for i, t in rows:
        w = re.findall(SPACE, low(t or ""))
        sets[i] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)} if len(w) > 1 else {tuple(w)} if w else set()
    comp = {i: i for i in sets}
    again = True
    while again:
        again = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and comp[a] != comp[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
                    again = True
    got = neardup.near_duplicates(frame(spark, rows), shingle=2, group=3).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(20)] + [(50, 60), (60, 55), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.comp for r in graph.components(edges).collect()}
    assert all(got[k] == 0 for k in range(21)) and got[60] == got[55] == got[50] == 50


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(shard, "PART_ROWS", 5)
    rows = [(k, f"t{k}é") for k in range(3000)] + [(None, None), (7, "again")]
    got = shard.shards(frame(spark, rows), [1.0] * 4 + [2.0], [1.0] * 4 + [2.0, 1.0]).collect()
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    sizes = Counter(r.shard for r in got)
    assert abs(sizes[4] / 1000 - 1) < 0.12 and all(abs(sizes[k] / 500 - 1) < 0.2 for k in range(4))
    assert all(r.grown_shard in (r.shard, 5) for r in got) and abs(sum(r.grown_shard == 5 for r in got) / 3000 - 1 / 7) < 0.03
    t = {i: x for i, x in rows if i != 7}
    assert all((r.size, r.text_crc32) == (len((t[r.doc_id] or "").encode()) + 1, zlib.crc32((t[r.doc_id] or "").encode())) for r in got if r.doc_id != 7)
    with pytest.raises(ValueError):
        shard.assign(F.col("doc_id"), [0.0])


def test_empty_tables(spark):
    none = frame(spark, [(1, "x")]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    assert substring.dedup(none).count() == 0
    assert decontam.report(none, bench).count() == 0
    assert decontam.report(frame(spark, [(1, "a b")]), bench).first().n_hit == 0
    assert fingerprint.fingerprints(none).count() == 0
    assert piece_bpe.encode(none).count() == 0
    assert quality.classify(none).count() == 0
    assert katz.scores(none, F.lit(False)).count() == 0
    assert trie_tokens.token_counts(none).count() == 0
    assert warc.read(spark, *warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0
    assert neardup.near_duplicates(none).count() == 0
    assert shard.shards(none, [1.0, 1.0]).count() == 0
