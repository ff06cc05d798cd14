"""The operators against plain versions of what they promise."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orrery.llm import bpe, chat, classifier, decontam, langid, licences, lm, neardup, quality, tokenfiles
from orrery.llm.text import mix

rng = np.random.default_rng(11)
VOCABULARY = ["".join(rng.choice(list("abdegilmnorstu"), int(rng.integers(2, 8)))) for _ in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(n: int) -> str:
    return " ".join(rng.choice(VOCABULARY, n))


def rows_of(texts, **same):
    out = {"lang": "en", "source": "s"} | same
    return [(i, t, out["lang"], out["source"], len(t or "")) for i, t in enumerate(texts)]


# 1. Language ID: the same naive Bayes with dicts, one text and one n-gram at a time.


def test_langid(spark):
    alphabets = {"aa": "abcde", "bb": "defgh", "cc": "ghabx"}
    rows = []
    for i in range(150):
        lang = list(alphabets)[i % 3]
        text = " ".join("".join(rng.choice(list(alphabets[lang]), int(rng.integers(1, 7)))) for _ in range(int(rng.integers(0, 12))))
        rows.append((i, None if i % 50 == 7 else text + ["", " 12!", " É"][i % 3], None if i % 10 == 3 else lang, "s", 0))
    got = {r["doc_id"]: r for r in langid.op1(spark.createDataFrame(rows, DOCS)).collect()}

    def buckets(text):
        chars = re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in text.lower() + "\n")).lstrip()
        out = []
        for n in (1, 2, 3):
            for i in range(len(chars) - n + 1):
                if n == 1 and chars[i] == " ":
                    continue
                h = n
                for c in chars[i : i + n]:
                    h = (h * 1_000_003 + ord(c)) % 2**64
                out.append(int(mix(np.array([h], np.uint64))[0]) % langid.BUCKETS)
        return out

    counts = {lang: Counter() for lang in alphabets}
    for i, text, lang, *_ in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1 and text is not None and lang is not None:
            counts[lang].update(buckets(text))
    for i, text, *_ in rows:
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        if not any(map(str.isalpha, text or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        found = buckets(text)
        total = {lang: sum(math.log((c[b] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for b in found) / math.sqrt(len(found)) for lang, c in counts.items()}
        best = max(sorted(total), key=total.get)
        score = 1 / sum(math.exp(v - total[best]) for v in total.values())
        assert got[i]["score"] == pytest.approx(score, rel=1e-3)
        assert got[i]["lang_pred"] == best or abs(total[got[i]["lang_pred"]] - total[best]) < 1e-3


def test_langid_holds_any_number_of_languages():
    assert langid.buckets_for(4) == langid.BUCKETS
    for n in (1_000, 5_000, 100_000):
        assert langid.buckets_for(n) * n * 4 <= langid.MAX_MODEL_BYTES < langid.buckets_for(n) * n * 8 or langid.buckets_for(n) == langid.BUCKETS


# 2. Decontamination: the edit distance of every passage and text, at every length.


def distance(passage: str, text: str) -> int:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(passage, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


@pytest.mark.parametrize("entries", [decontam.ENTRIES, 50])
def test_decontamination_at_every_length(monkeypatch, entries):
    monkeypatch.setattr(decontam, "ENTRIES", entries)
    norm = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    found = missed = 0
    for m in range(8, 61):
        passages = []
        while len(passages) < 3:
            p = " ".join("".join(rng.choice(list("abcdefghij klmno"), m)).split())
            passages += [p] * (len(p) == m)
        texts = []
        for p in passages:
            for edits in range(int(0.1 * m) + 2):
                chars = list(p)
                for x in np.linspace(0, m - 1, edits + 2)[1:-1].astype(int):
                    chars[x] = ["z", "", chars[x] + "z"][rng.integers(3)]
                texts.append("xx yy " + "".join(chars) + " ww")
        got = decontam.Passages(list(range(3)), passages).find(texts)
        for (t, text), (i, p) in product(enumerate(texts), enumerate(passages)):
            d = distance(p, norm(text))
            assert ((t, i) in got) == (d <= int(0.1 * m)), (m, p, text)
            found, missed = found + (d <= int(0.1 * m)), missed + (d > int(0.1 * m))
            assert (t, i) not in got or got[t, i][0] == d
    assert found > 300 < missed


def test_decontamination_of_odd_tables(spark):
    passage = prose(12)
    texts = [None, "", passage, prose(4000) + " " + passage, passage, prose(20)]
    docs = spark.createDataFrame([(i % 5, t, "x") for i, t in enumerate(texts)], "id long, text string, edits string")
    bench = spark.createDataFrame([(0, passage), (1, None), (0, passage)], "id long, text string")
    for block in (decontam.BLOCK_CHARS, 30):
        got = sorted(tuple(r) for r in decontam.matches(docs, bench, "id", item="id", block_chars=block).select("id", "benchmark_id", "edits").collect())
        assert got == [(i, 0, 0) for i in (2, 2, 3, 3, 4, 4)]
        kept = decontam.decontaminated(docs, bench, item="id", block_chars=block)
        assert kept.columns == docs.columns and sorted(kept.collect(), key=str) == sorted([(0, None, "x"), (0, texts[5], "x"), (1, "", "x")], key=str)


# 3. Near duplicates: a template that all texts share, below the similarity, and pairs above it.


def cells(text: str) -> set:
    w = re.findall(r"[^\W_]+", text.lower())
    n = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else {}
    return {(k, j) for k, v in n.items() for j in range(v)}


def test_pairs_just_above_within_a_crowd_just_below(spark):
    shared = prose(180).split()
    n = 200
    texts = []
    for i in range(n):
        own = [f"o{i}x{k}" for k in range(5)]
        texts += [shared + own + [f"a{i}x{k}" for k in range(k0, k0 + 20)] for k0 in (0, 20)]
    x = [cells(" ".join(t)) for t in texts[:4]]
    same, other = len(x[0] & x[1]) / len(x[0] | x[1]), len(x[0] & x[2]) / len(x[0] | x[2])
    assert same >= 0.8 > other > 0.75
    got = {r[0]: r[1] for r in neardup.op3(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).select("doc_id", "class_id").collect()}
    found = sum(got[2 * i] == got[2 * i + 1] == 2 * i for i in range(n))
    print(f"{found} of {n} pairs at {same:.3f} in a crowd at {other:.3f}")
    assert found >= 0.99 * n and len(set(got.values())) >= n


def test_components_of_any_shape(spark):
    draw = np.random.default_rng(2)
    shapes = [[(i, i + 1) for i in range(60)], [(100, i) for i in range(101, 140)], [(i, i + 1) for i in range(299, 200, -1)], [tuple(map(int, draw.integers(400, 460, 2))) for _ in range(40)], [(500, 500)]]
    links = [x for s in shapes for x in s]
    got = {r["node"]: r["label"] for r in neardup.contracted(spark.createDataFrame(links, "u long, v long")).collect()}
    parent = {x: x for link in links if link[0] != link[1] for x in link}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            parent[find(a)] = find(b)
    assert set(got) == set(parent)
    assert all((got[a] == got[b]) == (find(a) == find(b)) for a, b in combinations(sorted(parent), 2))


def test_rows_of_one_id(spark):
    a, b, c = prose(40), prose(40), prose(40)
    rows = [(1, a, "x"), (1, b, "x"), (1, a, "x"), (1, a.upper(), "y"), (2, a + " end", "x"), (3, c, "x"), (3, c, "w"), (None, c, "x"), (4, None, "x"), (4, None, "x"), (5, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    got = Counter((r[0], (r[1] or "").lower()) for r in kept.collect())
    assert got == Counter({(1, a): 1, (1, b): 1, (3, c): 1, (None, c): 1, (4, ""): 2, (5, ""): 1})
    assert neardup.op3(docs).count() == len(rows)


# 4. Licences: base places on every text of a table, by the words in order.


def test_licences_over_a_table(spark):
    words = [*"mit MIT license License licence apache general public GENERAL the spdx-license-identifier: gpl-2.0-only and ( or".split(), "é", "_", "\n"]
    texts = [None, "", *["".join(x + str(rng.choice([" ", "\n", ".", "  ", "-"])) for x in rng.choice(words, int(rng.integers(0, 60)))) for _ in range(300)]]
    for r in licences.op4(spark.createDataFrame(rows_of(texts), DOCS)).collect():
        low = (texts[r["doc_id"]] or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        own = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        phrases = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
        places = [(i, label) for i in range(len(own)) for p, label in phrases.items() if own[i : i + len(p.split())] == p.split()]
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))


# 5 and 6. Encoding: the library itself.


@pytest.fixture(params=["word_bpe_49k.json", "byte_bpe_50k.json"])
def encoder(request):
    return bpe.ChunkEncoder(public_tokenizers.path(request.param))


@pytest.mark.parametrize(("longest", "back"), [(4096, 1 << 12), (24, 6), (64, 100)])
def test_repaired_joins(monkeypatch, encoder, longest, back):
    monkeypatch.setattr(bpe, "LONGEST", longest)
    monkeypatch.setattr(bpe, "KEPT_BACK", back)
    parts = ["the", "ing", "er", "on", "a", "lat", "quest", "zz", "Qu", "xyzzy", "aaaa", "ab", "'s", "'re", "1", "é", "日本", "-", "<|endoftext|>"]
    p = np.array([1.0] * 12 + [0.02] * 7)
    cuts = 0
    for _ in range(60 if longest < 4096 else 3):
        text = "".join(rng.choice(parts, int(rng.integers(50, 500)) if longest < 4096 else 30_000, p=p / p.sum()))
        cuts += len(bpe.run_cuts(text)[0])
        assert np.frombuffer(encoder.run(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    assert cuts > 20


def test_a_megabyte_without_spaces(encoder):
    passage = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 1 << 18))
    text = "".join(rng.choice(list("etaoinshrdlu"), 1 << 19)) + passage + "'" + passage
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    # the passage that occurs twice is cut alike: its chunks are encoded once
    cuts = bpe.run_cuts(text)[0]
    assert len({text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)}) < 0.85 * len(cuts)


def test_clashing_hashes_give_no_wrong_ids(monkeypatch, encoder):
    whole = bpe.span_hashes
    monkeypatch.setattr(bpe, "span_hashes", lambda *x: whole(*x) & np.uint64(0xF000000000000000))
    texts = [prose(30) for _ in range(40)]
    assert [x.tolist() for x in encoder.encode(texts)] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_more_words_than_slots(encoder):
    text = " ".join(f"w{i * 7919:x}" for i in range(40_000))
    encoder.words.BITS = 10
    encoder.words.clear()
    assert encoder.encode([text])[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids
    table, n = bpe.WordTable(), 3_000_000
    h = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    h = np.unique(h)
    table.add(h, [b"\1\0\0\0"] * len(h), ["x"] * len(h))
    cp = np.full(4, ord("x"), np.uint32)
    some = h[:: len(h) // 1000]
    assert (table.find(some, cp, np.zeros(len(some), int), np.ones(len(some), int)) == np.arange(len(h))[:: len(h) // 1000]).all()
    assert table.find(some + np.uint64(2), cp, np.zeros(len(some), int), np.ones(len(some), int)).max() <= -1 or np.isin(some + np.uint64(2), h).any()


def test_columns_that_clash_in_token_files(spark, tmp_path):
    docs = spark.createDataFrame(rows_of(["a"]), DOCS).withColumn("part", F.lit(1))
    with pytest.raises(ValueError):
        tokenfiles.write_tokens(docs, str(tmp_path / "t"), keep=("part",))


# 7. Quality: the least determinant among many more starts, with exact shares.


def test_minimum_covariance_determinant(spark):
    draw = np.random.default_rng(4)
    texts, sources = [], []
    for i in range(420):
        words = [w.capitalize() if draw.random() < 0.1 else w for w in draw.choice(VOCABULARY, int(draw.integers(40, 300)))]
        if i % 9 == 0:
            words = [w + "!?;"[i % 3] * 3 for w in words]
        if i % 13 == 0:
            words = [w.upper() + "#" for w in words]
        texts.append(" ".join(words) + ("\nsame line" * int(draw.integers(1, 30)) if i % 11 == 0 else ""))
        sources.append("large" if i < 380 else "small" if i < 415 else "tiny")
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, (t, s) in enumerate(zip(texts, sources, strict=True))], DOCS)
    got = {r["doc_id"]: r for r in quality.op7(docs).collect()}
    stats = quality.statistics({}, texts)
    x = np.column_stack([stats[f] for f in quality.FEATURES])
    good, source, floor = ~stats["base_failed"], np.array(sources), np.diag(np.array(list(quality.FEATURES.values())) ** 2)

    def far(rows, mean, covariance):
        return np.einsum("ij,jk,ik->i", rows - mean, np.linalg.inv(covariance), rows - mean)

    cores = {}
    for s in set(sources):
        own = x[good & (source == s)]
        best = None
        for _ in range(200):
            core = own[draw.integers(0, len(own), 9)]
            last = math.inf
            while True:
                mean, covariance = core.mean(axis=0), quality.CONSISTENCY * np.cov(core.T, bias=True) + floor
                det = np.linalg.slogdet(covariance)[1]
                if last - det < 1e-9:
                    break
                last = det
                d = far(own, mean, covariance)
                core = own[d <= np.sort(d)[math.ceil(len(own) / 2) - 1]]
            if best is None or det < best[0]:
                best = (det, mean, covariance)
        cores[s] = own[far(own, *best[1:]) <= quality.NEAR]
    every = np.concatenate(list(cores.values()))
    sure = 0
    for s, core in cores.items():
        part = quality.PRIOR / (len(core) + quality.PRIOR)
        off = core.mean(axis=0) - every.mean(axis=0)
        mixed = (1 - part) * np.cov(core.T, bias=True) + part * np.cov(every.T, bias=True) + part * (1 - part) * np.outer(off, off)
        d = far(x, core.mean(axis=0) - part * off, quality.NEAR_CONSISTENCY * mixed + floor)
        for i in np.flatnonzero(source == s):
            assert got[i]["kept"] == (got[i]["distance"] <= quality.CUT and not got[i]["base_failed"])
            if good[i] and not 0.75 * quality.CUT < d[i] < 1.3 * quality.CUT:
                sure += 1
                assert got[i]["kept"] == (d[i] <= quality.CUT), (i, d[i], got[i]["distance"])
    assert sure > 350 and 10 < sum(not r["kept"] for r in got.values()) < 200


def test_each_statistic_can_reject_by_itself():
    most = {"dup_lines": math.log1p(10), "repeats": 0.3, "stutter": 1.0, "symbols": math.log1p(100), "punct": math.log1p(100), "upper": math.log1p(100)}
    assert all((most[f] / quality.FEATURES[f]) ** 2 > quality.CUT for f in most)


def test_quality_of_odd_tables(spark):
    clean = [prose(60) for _ in range(30)]
    rows = [(i % 20, t, "en", None, 1) for i, t in enumerate(clean)] + [(3, "spam " * 300, "en", None, 1), (None, "spam " * 300, None, "s", 1), (None, clean[0], "en", None, 1), (4, None, "en", "s", 1), (5, prose(20_000), "en", None, 1)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("kept", F.lit("clash"))
    kept = quality.passed(docs)
    assert kept.columns == docs.columns
    texts = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert texts[(None, clean[0])] == 1 and (3, clean[3]) in texts and sum(t.startswith("spam") for _, t in texts) == 0 and (4, None) not in texts
    one = spark.createDataFrame([(1, prose(50), "xx", "only", 1)], DOCS)
    assert quality.op7(one).first()["kept"]


# 8. Language model: all segmentations by recursion, before and after the round of expectation.


def test_language_model(spark):
    words = ["the", "then", "ten", "net", "é", "x1"]
    texts = [None, *[" ".join(rng.choice(words, int(rng.integers(0, 9)))) for _ in range(40)]]
    got = {r["doc_id"]: r for r in lm.op8(spark.createDataFrame(rows_of(texts), DOCS)).collect()}
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    ids = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    spelled = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(sp.get_piece_size()) if sp.is_byte(i)}

    def ways(word):
        if not word:
            yield []
            return
        for k in range(1, len(word) + 1):
            head = [ids[word[:k]]] if word[:k] in ids else [spelled[b] for b in word[0].encode()] if k == 1 else None
            if head:
                yield from (head + rest for rest in ways(word[k:]))

    cut = {w: list(ways("▁" + w)) for w in words}
    ranks = np.array([sp.get_piece_size() if sp.is_byte(i) else -sp.get_score(i) for i in range(sp.get_piece_size())])
    start = np.log(1 / (ranks + 100))
    start -= np.log(np.exp(start).sum())
    counts, ends = np.full(len(ranks), lm.LEAST), 0
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 10:
            ends += 1
            for w in (t or "").split():
                p = np.exp([start[x].sum() for x in cut[w]])
                for x, share in zip(cut[w], p / p.sum(), strict=True):
                    np.add.at(counts, x, share)
    logp = np.log(counts / (counts.sum() + ends))
    end = math.log(ends / (counts.sum() + ends))
    for i, t in enumerate(texts):
        want = end + sum(math.log(sum(math.exp(logp[x].sum()) for x in cut[w])) for w in (t or "").split())
        assert got[i]["score"] == pytest.approx(want / math.log(10), rel=1e-6)


# 9. Chat: every sequence of choices.


def test_chat_against_all_repairs(spark):
    names = {1: "system", 2: "user", 3: "assistant"}
    conversations = [[[*names.values(), "tool", None][k] for k in draw] for n in range(1, 5) for draw in product(range(5), repeat=n)]
    conversations = [conversations[i] for i in rng.choice(len(conversations), 150, replace=False)]
    rows = [(i, t, role, f"t{i}") for i, c in enumerate(conversations) for t, role in enumerate(c)]
    got: dict = {}
    for r in chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), block=2).collect():
        got[r["conv_id"]] = got.get(r["conv_id"], 0) + r["cost"]
    legal = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}

    def cheapest(state, left):
        if not left:
            return 0 if state in (2, 3) else math.inf
        best = math.inf
        for target in names:
            change = 0 if left[0] == names[target] else chat.RELABEL + chat.TO_SYSTEM * (target == 1)
            ways = [chat.MERGE] * (state == target) + [0] * (target in legal[state]) + [chat.INSERT] * any(target in legal[m] for m in legal[state])
            best = min([best, *(w + change + cheapest(target, left[1:]) for w in ways)])
        return best

    assert got == {i: cheapest(0, c) for i, c in enumerate(conversations)}


# 10. Quality classifier: views that are separate, and one kind of label.


def test_views_are_separate(spark):
    a, b = classifier.text_view([prose(30), "x"]), classifier.metadata_view(["en", None], ["s", None], [10, None])
    assert a.shape[1] == classifier.PAIRS + classifier.TEXT_DENSE and b.shape[1] == classifier.META
    texts = [prose(40) if i % 2 else "# $ % " * 30 for i in range(200)]
    docs = spark.createDataFrame([(i, t, "en", "good" if i % 2 else "bad", 100) for i, t in enumerate(texts)], DOCS)
    for n in (8, 60):
        got = {r["doc_id"]: r["kept"] for r in classifier.op10(docs, spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id long, quality int")).collect()}
        assert sum(got[i] == bool(i % 2) for i in range(200)) >= 198
    one = classifier.op10(docs, spark.createDataFrame([(1, 1), (3, 1)], "doc_id long, quality int"))
    assert one.select(F.min("score")).first()[0] > 0.99
    odd = spark.createDataFrame([(1, None, None, None, None), (1, "x" * 100_000, "en", "s", 5), (None, "", "en", None, -1)], DOCS)
    assert classifier.op10(odd, spark.createDataFrame([(1, 1)], "doc_id long, quality int")).count() == 3


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "any passage of a benchmark")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
