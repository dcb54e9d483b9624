import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, lower

from textloom.llm import common, fingerprints, neardup, packing, pieces, pitmanyor, quality, rules, seating, sharding, substrings, suffixes, webpages


def plain(df):
    return [tuple(r) for r in df.collect()]


# ------------------------------------------------------------------ 1
def test_entropies():
    data = np.frombuffer(bytes(np.random.default_rng(1).integers(97, 103, 300, dtype=np.uint8)), np.uint8)
    for k, e in enumerate(fingerprints.entropies(data)):
        p = np.bincount(data[k : k + 16])
        p = p[p > 0] / 16
        assert abs(e - -(p * np.log2(p)).sum() / 4 * 1000) < 1.01


def test_fingerprints(documents, rows):
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(documents).collect()}
    ordered = sorted(rows)
    for k, (i, t) in enumerate(ordered):
        edited = fingerprints.edit(t, ordered[(k + 1) % len(ordered)][1])
        assert len(edited) <= len(t) and edited[: len(t) - len(t) // 4] == t[: len(t) - len(t) // 4]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    same = {}
    for i, t in rows:
        assert same.setdefault(t, got[i].fingerprint) == got[i].fingerprint
    near, far = [r.near_edited for r in got.values()], [r.near_next for r in got.values()]
    assert 0 <= min(near + far) and max(near + far) <= 1
    assert np.median(near) > 0.65 and np.quantile(far, 0.95) < 0.1 and np.mean(np.array(near) > np.array(far)) > 0.98


def test_neighbours_of_scattered_ids(spark, rows):
    """One far id must not put all others into one range; neighbours stay neighbours."""
    far = sorted((i * 10**13 if i > 150 else i - 50, t) for i, t in rows)
    got = {r.doc_id: r for r in fingerprints.compare_neighbours(spark.createDataFrame(far, "doc_id long, text string")).collect()}
    for k, (i, t) in enumerate(far):
        assert got[i].edited_sha256 == hashlib.sha256(fingerprints.edit(t, far[(k + 1) % len(far)][1]).encode()).hexdigest()
    narrow = spark.createDataFrame([(i, 100) for i, _ in far], "okey long, n_bytes long")
    firsts, size = fingerprints.ranges(narrow, 20, 1 << 30)
    assert size.sum() == 100 * len(far) and size.max() <= 100 * len(far) // 20 and firsts.tolist() == sorted(firsts.tolist())


def test_fingerprints_of_odd_texts(odd):
    out = {(r.doc_id, r.n_chars): r for r in fingerprints.compare_neighbours(odd).collect()}
    assert out[(1, 0)].fingerprint == out[(2, 0)].fingerprint and out[(1, 0)].near_next == 1.0
    assert out[(4, 3)].near_next == 1.0 and out[(3, 3)].near_next < 1
    assert len(plain(fingerprints.compare_neighbours(odd))) == odd.count()
    assert plain(fingerprints.compare_neighbours(odd.limit(0))) == []


# ------------------------------------------------------------------ 2
def test_scores_and_base(documents, rows):
    got = pitmanyor.score(documents).collect()
    tokens = {i: [*WORD.findall(lower(t)), 0] for i, t in rows}
    counts = Counter()
    for i, x in tokens.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(x)
    n, v = sum(counts.values()), len(counts)
    for r in got:
        x = tokens[r.doc_id]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in x)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.train_tokens == n
        assert (r.n_tokens, r.n_known, r.held_out) == (len(x), sum(counts[w] > 0 for w in x), zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
        assert r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    again = {r.doc_id: r.score for r in pitmanyor.score(documents.repartition(3)).collect()}
    assert all(again[r.doc_id] == pytest.approx(r.score, rel=1e-6) for r in got)
    # the whole model by dictionaries
    want = brute.pitman_yor(rows, 4)
    assert all(r.score == pytest.approx(want[r.doc_id], rel=1e-8) for r in got)


def test_blocks_without_pairs_of_their_own(spark, monkeypatch):
    """Blocks of copies own no pair; many small blocks give what one gives."""
    texts = ["the cat sat on the mat and the cat sat again"] * 40 + ["", "the dog sat on the cat", None, "new words only once here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute.pitman_yor([(i, t or "") for i, t in enumerate(texts)], 4)
    monkeypatch.setattr(common, "BLOCK_BYTES", 50)
    got = {r.doc_id: r.score for r in pitmanyor.score(docs.repartition(7, "doc_id")).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-8) for i in want)


def test_probabilities_sum_to_one():
    model = pitmanyor.Model(9, 3, 0.4)
    model.base_discount = 0.3
    dish, parent = np.array([3, 2, 1, 0]), np.array([2, 1, 1, 0])
    model.at = [(6, 4, 1.5, 5.0)]
    p = model.parent(dish, parent, 0)
    assert p.sum() == pytest.approx(1) and p[-1] == pytest.approx((1.5 + 0.3 * 4) / 4 / 7.5)
    c, tables = np.array([4, 1, 0, 0]), np.array([2, 1, 0, 0])
    p = (np.maximum(c - 0.4 * tables, 0) + (5 + 0.4 * tables.sum()) * p) / (5 + c.sum())
    assert p.sum() == pytest.approx(1)


def enumerated(c, lead, slope, d):
    """Chances of 1.. tables by seating the customers one by one in every way (counts of ways by table sizes)."""
    ways = {(1,): 1.0}
    for _ in range(c - 1):
        after = Counter()
        for sizes, w in ways.items():
            for k, n in enumerate(sizes):
                after[tuple(sorted((*sizes[:k], n + 1, *sizes[k + 1 :])))] += w * (n - d)
            after[tuple(sorted((*sizes, 1)))] += w * (lead + slope * len(sizes))
        ways = after
    by = Counter()
    for sizes, w in ways.items():
        by[len(sizes)] += w
    return np.array([by[t] for t in range(1, c + 1)]) / sum(by.values())


@pytest.mark.parametrize(("c", "lead", "slope", "d"), [(2, 0.7, 0.1, 0.4), (7, 0.7, 0.1, 0.4), (9, 3.0, 0.02, 0.8)])
def test_seating_is_a_chinese_restaurant(c, lead, slope, d):
    n = 40_000
    key = common.mix(np.arange(n, dtype=np.uint64) + np.uint64(n * c))
    got = seating.seat(np.full(n, c), np.full(n, lead), np.full(n, slope), d, key, 1)
    assert np.abs(np.bincount(got, minlength=c + 1)[1:] / n - enumerated(c, lead, slope, d)).max() < 0.012


@pytest.mark.parametrize("c", [40, 41, 300])
def test_steps_keep_the_distribution_on_either_side_of_the_list(c):
    n, lead, slope, d = 6000, 6.0, 0.1, 0.7
    w = seating.ways(d, c)[c, 1 : c + 1] + np.concatenate([[0], np.cumsum(np.log(lead + slope * np.arange(1, c)))])
    p = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
    now = np.random.default_rng(c).choice(np.arange(1, c + 1), n, p=p)
    key = common.mix(np.arange(n, dtype=np.uint64))
    after = seating.seat(np.full(n, c), np.full(n, lead), np.full(n, slope), d, key, 3, now)
    mean, sd = (p * np.arange(1, c + 1)).sum(), np.sqrt((p * np.arange(1, c + 1) ** 2).sum() - (p * np.arange(1, c + 1)).sum() ** 2)
    assert (after != now).mean() > 0.5
    for x in (now, after):
        assert abs(x.mean() - mean) < 5 * sd / np.sqrt(n) and abs(x.std() - sd) < 0.06 * sd


def test_ways_to_seat_many():
    for d in (0.1, 0.5, 0.9):
        exact = seating.ways(d, 400)
        for c in (41, 90, 400):
            t = np.arange(1, c + 1)
            assert np.abs(seating.log_ways(np.full(c, c), t, d) + math.lgamma(c + 1) - exact[c, 1 : c + 1]).max() < (2e-3 if d == 0.9 else 1e-6)
    # a table more or less: S(c + 1, t) = (c - t d) S(c, t) + S(c, t - 1), for any c
    for c, t in ((10**6, 1000), (10**9, 50), (10**9, 2)):
        at = lambda c, t: float(seating.log_ways(np.array([c]), np.array([t]), 0.6)[0])
        assert at(c + 1, t) + math.log(c + 1) == pytest.approx(np.logaddexp(math.log(c - t * 0.6) + at(c, t), at(c, t - 1)), abs=1e-4)
    assert (seating.seat(np.array([10**10]), np.array([50.0]), np.array([0.01]), 0.6, np.array([1], np.uint64), 1) > 40).all()
    assert not len(seating.seat(*(np.zeros(0, k) for k in (np.int64, float, float)), 0.6, np.zeros(0, np.uint64), 1))


def test_packed_numbers():
    rng = np.random.default_rng(2)
    arrays = [rng.integers(0, 2**k, 50) for k in (1, 8, 20, 62)] + [np.zeros(0, np.int64)]
    assert all((a == b).all() for a, b in zip(arrays, pitmanyor.take(pitmanyor.put(*arrays)), strict=True))
    rising = np.sort(mixed := common.mix(np.arange(50, dtype=np.uint64)))
    assert len(mixed) and (pitmanyor.risen(pitmanyor.steps(rising), np.uint64) == rising).all()


def test_scores_of_odd_texts(odd):
    out = pitmanyor.score(odd).collect()
    assert len(out) == odd.count() and all(math.isfinite(r.score) and r.score <= 1e-9 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (1, 2, 3)} == {1}
    assert plain(pitmanyor.score(odd.limit(0))) == []
    held = odd.where("doc_id is not null").where("crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")
    assert all(r.score == 0 and r.train_tokens == 0 for r in pitmanyor.score(held).collect())


# ------------------------------------------------------------------ 3
def best_score(model, entries, text):
    patterns = {}
    for k, (t, s, kind) in enumerate(entries):
        if kind in (pieces.NORMAL, pieces.USER) and t:
            patterns.setdefault(t, s)
    longest, best = max(map(len, patterns)), [0.0] + [-1e18] * len(text)
    for at in range(1, len(text) + 1):
        best[at] = best[at - 1] + model.uncovered
        for n in range(1, min(longest, at) + 1):
            s = patterns.get(text[at - n : at])
            if s is not None:
                best[at] = max(best[at], best[at - n] + s)
    return best[-1]


def test_pieces_round_trip_and_best(vocabulary):
    entries = pieces.vocabulary(str(vocabulary("piece_bpe_32k.model")))
    model, rng = pieces.Pieces(entries), random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("abcdethéñ ▁ \n\t\0日😀.,!  the") for _ in range(rng.randint(0, 40)))
        ids, score = model.encode(text)
        assert model.decode(ids.tolist()) == text
        if text and pieces.MARK not in text:
            assert score == pytest.approx(best_score(model, entries, pieces.MARK + text.replace(" ", pieces.MARK)))


def test_encoder_of_two_vocabularies():
    own = [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]
    first, second = (own + [(t, -1.0, pieces.NORMAL) for t in x] for x in ("ab", "cd"))
    assert pieces.encoder(first).encode("a")[0].tolist() != pieces.encoder(second).encode("a")[0].tolist()
    assert pieces.encoder(second) is pieces.encoder(list(second))


def test_pieces_of_tables(spark, odd, vocabulary):
    path = str(vocabulary("piece_bpe_32k.model"))
    assert all(r.exact for r in pieces.round_trip(odd, path).collect())
    back = pieces.decode(pieces.encode(odd, path), path)
    assert sorted(map(str, (r.text for r in back.collect()))) == sorted(r.text or "" for r in odd.collect())
    assert plain(pieces.round_trip(odd.limit(0), path)) == []


# ------------------------------------------------------------------ 4
def test_classifier_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    docs, marks = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, marks).collect()}
    assert len(got) == docs.count()
    held = [(r.quality, got[r.doc_id].score) for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(got[r.doc_id].held_out for r in marks.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    good, bad = [s for q, s in held if q == 1], [s for q, s in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.95 and np.mean(np.array(good) >= 0.3) > 0.97
    assert all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got.values())


def test_non_negative_risk_learns():
    rng = np.random.default_rng(5)
    n = quality.N_FEATURES
    good, bad = rng.normal(0.7, 1, (4000, n)), rng.normal(-0.7, 1, (1000, n))
    model = quality.Network().fit(good[:2000].astype(np.float32), np.concatenate([good[2000:], bad]).astype(np.float32), 2 / 3, epochs=30)
    assert model.score(good).mean() > 0.85 and model.score(bad).mean() < 0.25


def test_classifier_odd_texts(spark, odd):
    marks = spark.createDataFrame([(k, 1, 0) for k in (4, 6, 11, 12)], "doc_id long, quality int, toxic int")
    out = quality.classify(odd, marks).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    none = quality.classify(odd, marks.limit(0)).collect()
    assert len({r.score for r in none}) == 1
    assert plain(quality.classify(odd.limit(0), marks)) == [] and quality.keep(odd, marks).columns == odd.columns


@pytest.mark.parametrize("share", [0.3, 0.6, 0.9])
def test_prior_from_positives_and_unlabelled(share):
    rng = np.random.default_rng(int(share * 10))
    good, bad = rng.normal(0.8, 1, (8000, 12)), rng.normal(-0.8, 1, (8000, 12))
    n = int(6000 * share)
    assert quality.class_prior(good[:2000], np.concatenate([good[2000 : 2000 + n], bad[: 6000 - n]])) == pytest.approx(share, abs=0.06)


def test_content_decides_where_style_is_equal(spark):
    say = lambda k, w: " ".join(random.Random(k).choice(w) for _ in range(60)) + "."
    data = [(k, say(k, ["river", "stone", "light", "grass"] if k % 2 else ["lucky", "prize", "claim", "bonus"])) for k in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = spark.createDataFrame([(k, 1) for k in range(1, 400, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.classify(docs, marks).collect()}
    assert np.mean([got[k] > 0.5 for k in range(1, 600, 2)]) > 0.95 and np.mean([got[k] < 0.5 for k in range(0, 600, 2)]) > 0.95


# ------------------------------------------------------------------ 5
def check_shards(out, n):
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(n))
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    return [sum(r.size for r in by.get(k, [])) for k in range(n)]


def test_shards_have_equal_bytes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
    out = sharding.shard(docs, 8).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in out)
    sizes = check_shards(out, 8)
    assert len(out) == len(texts) and max(sizes) < 1.05 * min(sizes)
    groups = {}
    for r in out:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert sum(len(g) > 1 for g in groups.values()) <= 2
    sizes = check_shards(sharding.shard(docs, 5).collect(), 5)
    assert max(sizes) < 1.06 * min(sizes)
    assert len({r.shard for r in sharding.shard(docs, target_bytes=1_000_000).collect()}) == -(-sum(sizes) // 1_000_000)


def test_one_heavy_group_is_split(spark):
    docs = spark.createDataFrame([(k, "same text", "en", "s") for k in range(400)] + [(k, f"text {k} " * 3, "fr", f"s{k % 3}") for k in range(400, 800)], "doc_id long, text string, lang string, source string")
    sizes = check_shards(sharding.shard(docs, 8).collect(), 8)
    assert max(sizes) < 1.1 * min(sizes)


def test_shards_of_odd_rows(odd):
    out = sharding.shard(odd, 8).collect()
    check_shards(out, 8)
    assert len(out) == odd.count() and {r.size for r in out if r.doc_id in (1, 2)} == {1}
    assert plain(sharding.shard(odd.limit(0), 8)) == []


# ------------------------------------------------------------------ 6
def test_best_fit_equals_search():
    rng = random.Random(8)
    for _ in range(200):
        window = rng.choice([16, 50, 64])
        lengths = sorted((rng.randint(1, window) for _ in range(rng.randint(1, 60))), reverse=True)
        bins, offsets = packing.best_fit(lengths, window)
        filled = {}
        for b, o, n in zip(bins, offsets, lengths, strict=True):
            assert filled.get(b, 0) == o
            filled[b] = o + n
        assert sorted(window - f for f in filled.values()) == brute.best_fit(lengths, window)


def test_tokenizer_by_word(vocabulary):
    from tokenizers import Tokenizer

    spec = open(vocabulary("word_bpe_49k.json"), encoding="utf-8").read()
    own, whole = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    whole.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["l'été don't I'm ÀÉ. 10,000 0 00 x0 a.b.. hey!! ΣΑΣ. é ́x ß, ẞ <|endoftext|>", "", "  ", "\x85 a\x85b", "日本語。 ½ Ⅷ ::: : ; ."]
    texts += ["".join(rng.choice("aAbéÉß.,!?;:'0129 \n\tsStT́ñÑ*# ") for _ in range(rng.randint(0, 80))) for _ in range(800)]
    ids, counts = own(pa.array(texts))
    want = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def check_packing(out, docs, path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    sequences = {}
    by_doc = Counter()
    for r in out:
        ids = [*whole.encode(docs[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.doc_tokens == len(ids) and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    return sequences, by_doc


def test_other_tokenizers_encode_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    spec = open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read()
    own, whole = packing.WordTokenizer(spec), Tokenizer.from_str(spec)
    texts = ["Two  words\n", "", "0 a0b 10", None]
    ids, counts = own(pa.array(texts))
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not own.by_word and counts.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_packing_in_many_cells(spark, vocabulary, monkeypatch):
    """Rows that repeat go to many cells; full windows are sequences of their own."""
    monkeypatch.setattr(packing, "CELL_PIECES", 10)
    path, text = str(vocabulary("word_bpe_49k.json")), "word " * 5000
    out = packing.pack(spark.createDataFrame([(1, text)] * 40, "doc_id long, text string"), path).collect()
    assert len(out) == 40 * 3 and len({r.sequence_id for r in out if r.length == 2048}) == 80
    cells = Counter(r.sequence_id >> 32 for r in out if r.length < 2048)
    assert len(cells) == 4 and max(cells.values()) < 25


def test_packing(documents, rows, vocabulary):
    path = str(vocabulary("word_bpe_49k.json"))
    sequences, by_doc = check_packing(packing.pack(documents, path).collect(), dict(rows), path)
    assert set(by_doc) == {i for i, _ in rows}
    assert sum(by_doc.values()) > 0.97 * 2048 * len(sequences)


def test_packing_odd_rows(odd, vocabulary):
    path = str(vocabulary("word_bpe_49k.json"))
    out = packing.pack(odd, path).collect()
    check_packing(out, {r.doc_id: r.text for r in odd.collect()}, path)
    assert sorted(r.length for r in out if r.doc_id in (1, 2, 3)) == [1, 1, 1] and plain(packing.pack(odd.limit(0), path)) == []


# ------------------------------------------------------------------ 7
@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, documents, rows, words, percent):
    assert sorted(plain(neardup.near_duplicates(documents, words, percent))) == brute.near_duplicates(rows, words, percent)


def test_bands_find_pairs_at_any_limit(spark, rows):
    for percent in (15, 50, 80, 85, 100):
        bands, values = neardup.bands_for(percent)
        assert bands * values <= neardup.BINS and (1 - (percent / 100) ** values) ** bands <= neardup.MISSED
    with pytest.raises(ValueError):
        neardup.bands_for(5)
    some = rows[:80] + [(900, rows[0][1] + " x"), (900, rows[1][1] + " y")]
    docs = spark.createDataFrame(some, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, 9, 60).collect()}
    assert {out[rows[0][0]], out[rows[1][0]], out[900]} == {min(out[rows[0][0]], out[rows[1][0]])}, "an id is linked by any of its texts"
    plain_ = [r for r in neardup.near_duplicates(docs.where("doc_id <> 900"), 9, 60).collect()]
    assert sorted(map(tuple, plain_)) == brute.near_duplicates(rows[:80], 9, 60)


def test_chains_and_outliers(spark):
    """Copies edited ever further from a base, and chains that only their ends' neighbours link."""
    rng = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    data = []
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 5)):
            words[at] = f"x{rng.randint(0, 400)}"
        data.append((k, " ".join(words)))
    chain = [f"c{k}" for k in range(100)]
    for k in range(20):
        data.append((1000 + k, " ".join(chain)))
        chain = [*chain[2:], f"d{k}", f"e{k}"]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert sorted(plain(neardup.near_duplicates(docs, 3, 85))) == brute.near_duplicates(data, 3, 85)


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(k, k + 1) for k in range(500, 540)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(plain(neardup.components(spark.createDataFrame(edges, "a long, b long"))))
    assert all(got.get(x, x) == find(x) for x in parent)


def test_near_duplicates_of_odd_rows(odd):
    out = {r.doc_id: r for r in neardup.near_duplicates(odd, 3, 85).collect()}
    assert out[1].component_id == 1 and out[2].component_id == 2 and out[3].n_shingles == 0
    assert out[5].component_id == 4 and not out[5].kept and out[9].kept and out[None].kept
    assert plain(neardup.near_duplicates(odd.limit(0), 3, 85)) == []
    kept = neardup.keep_one(odd, 3, 85)
    assert kept.columns == odd.columns and 5 not in {r.doc_id for r in kept.collect()}


# ------------------------------------------------------------------ 8
def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for k in range(200):
        x = rng.integers(0, rng.integers(1, 6), rng.integers(1, 60))
        x = np.tile(x, 3) if k % 5 == 0 else x
        sa = suffixes.suffix_array(x)
        assert sa.tolist() == sorted(range(len(x)), key=lambda i: list(x[i:]))
        left = np.arange(len(x), 0, -1)
        plcp = suffixes.permuted_lcp(x.astype(np.uint16), sa, left)
        for a, b in zip(sa[:-1], sa[1:], strict=True):
            n = 0
            while max(a, b) + n < len(x) and x[a + n] == x[b + n]:
                n += 1
            assert plcp[b] == n


def test_marked_windows_equal_search():
    rng = random.Random(3)
    for _ in range(60):
        base = "".join(rng.choice("ab") for _ in range(40))
        pieces = []
        for _ in range(rng.randint(1, 25)):
            at = rng.randint(0, 25)
            pieces.append((base[at : at + rng.randint(8, 14)] + "x" * rng.randint(0, 3)).ljust(8, "y").encode())
        owner = [rng.randint(0, 6) for _ in pieces]
        got = set(zip(*(x.tolist() for x in substrings.mark(np.array(owner), np.array(list(map(len, pieces))), np.frombuffer(b"".join(pieces), np.uint8), 8)), strict=True))
        least = {}
        for o, p in zip(owner, pieces, strict=True):
            for k in range(len(p) - 7):
                least[p[k : k + 8]] = min(o, least.get(p[k : k + 8], 99))
        assert got == {(n, k) for n, (o, p) in enumerate(zip(owner, pieces, strict=True)) for k in range(len(p) - 7) if least[p[k : k + 8]] < o}


def test_repeats_equal_brute_force(documents, rows):
    assert sorted(plain(substrings.repeats(documents))) == sorted(brute.repeats(rows))


def test_repeats_of_odd_rows(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(20, "b" * 70 + "xy " * 30), (21, "ab" * 5000 + "q" + "b" * 49), (22, "xéa" * 2 + "éa" * 30), (23, "éa" * 30), (24, "z" + "xy " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as block")
    assert sorted(plain(substrings.repeats(docs)), key=str) == sorted(brute.repeats(rows), key=str)
    assert plain(substrings.repeats(odd.limit(0))) == []
    out = {r.doc_id: r for r in substrings.strip(odd).collect()}
    assert substrings.strip(odd).columns == odd.columns and out[12].text == "\nOnce told."[-len(out[12].text) :] and out[12].n_chars == len(out[12].text)


# ------------------------------------------------------------------ 9
PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="main"><p>{note}</p><h1>Title &amp; {k}</h1><p>First  text
of {k} &eacute;<br>more.<p>Second of {k}</p><div class="ad-box">buy</div><script>x("</p>")</script><form><p>mail</p></form><div id="comments"><p>nice!</p></div></div><aside>side {k}</aside><footer>&copy; f</footer></body></html>"""


def test_pages_by_template(spark):
    data = [(k, f"https://Host.example/{k}", PAGE.format(k=k, note="Sign in to read on.")) for k in range(12)]
    got = {r.page_id: r for r in webpages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k].text == f"Title & {k}\nFirst text of {k} é more.\nSecond of {k}" and got[k].n_chars == len(got[k].text)


def test_template_with_odd_pages(spark):
    note = "Sign in to read on."
    for other in ("", None, "<nav>only</nav>", "<html><body><h1>404</h1><p>Not found</p></body></html>", "<p>" + "odd words " * 900):
        data = [(k, f"https://host.example/{k}", PAGE.format(k=k, note=note if k != 5 else "")) for k in range(12)] + [(12, "https://host.example/12", other)]
        got = {r.page_id: r.text for r in webpages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
        for k in range(12):
            assert got[k] == f"Title & {k}\nFirst text of {k} é more.\nSecond of {k}"
        assert got[12] == {None: "", "": "", "<nav>only</nav>": ""}.get(other, got[12]) and (got[12] != "") == ("<p>" in (other or ""))


@pytest.mark.parametrize("n", [2, 3, 9, 10])
def test_template_of_small_hosts(spark, n):
    note = "Sign in to read on. " * 20  # more than half of the text
    data = [(k, f"https://host.example/{k}", PAGE.format(k=k, note=note)) for k in range(n)] + [(50 + k, f"https://copies.example/{k}", PAGE.format(k=7, note=note)) for k in range(n)]
    got = {r.page_id: r.text for r in webpages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for k in range(n):
        assert got[k] == f"Title & {k}\nFirst text of {k} é more.\nSecond of {k}"
        assert got[50 + k] == f"{note.strip()}\nTitle & 7\nFirst text of 7 é more.\nSecond of 7"


def test_slot_with_odd_pages(spark):
    page = "<html><body><div class=top><p>{k} visitors</p></div><div class=text><p>{long} {k}</p></div></body></html>"
    data = [(k, f"https://host.example/{k}", page.format(k=k, long="word " * 40)) for k in range(12)] + [(12, "https://host.example/12", ""), (13, "https://host.example/13", "<p>" + "odd words " * 900)]
    got = {r.page_id: r.text for r in webpages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    for k in range(12):
        assert got[k] == "word " * 40 + f"{k}"


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<p>a <span class=ad>x</span> b<p>c", "a b\nc"),
        ('<p>a <span aria-hidden="true">x</span> b</p><p>c</p>', "a b\nc"),
        ('<p>a <a class="share">x<a>y</a> z</a> b<p>c', "a b\nc"),
        ('<p>a <span hidden>x <span>y</span> z</span> b <i>d</i><p>c', "a b d\nc"),
        ("<p>a <sup class=ad>x<p>c<p>d", "a\nc\nd"),
        ("<p>a <span style='display:none'>x</p> b<p>c", "a\nb\nc"),
        ("<ul><li>a <b class=promo>x<li>c</ul>d", "a\nc\nd"),
        ("<div>a <span class=ad>x<p>y</p></span> b</div>c", "a\nb\nc"),
        ("a <span>b</span> <img class=ad> c</span> d", "a b c d"),
    ],
)
def test_text_after_a_skipped_inline_element(body, text):
    assert webpages.text_of(f"<html><body><nav>n</nav><article>{body}</article><footer>f</footer></body></html>", None, frozenset()) == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><h1>T</h1><div class="elementor-widget-container"><p>The whole article text.</p></div><div class="share-price table"><p>Price rose.</p></div><p>End</p></article>', "T\nThe whole article text.\nPrice rose.\nEnd"),
        ('<body><section class="responsive-menu-ready"><p>Body</p></section></body>', "Body"),
        ('<body><section class="menu"><p>All the text</p></section><nav>x</nav></body>', "All the text"),
        ('<body><p>t</p><div class="ad-box">buy</div><div id="cookie-notice">c</div><ul class="nav-list"><li>n</li></ul></body>', "t"),
    ],
)
def test_names_of_elements(page, text):
    assert webpages.text_of(page, None, None) == text


def test_fixture_pages(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in webpages.extract(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|<footer|$)", source[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"<p>|</p>|</?h\d>|<br>", body)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_odd_pages(spark):
    data = [(1, None, None), (2, "http://[bad", "<p>x<p> y &lt;z"), (3, "http://a.b/", ""), (3, "http://a.b/", ""), (None, "http://a.b/", "plain"), (5, "u", "<p>" + "long " * 20000), (6, "u", "<!-- open"), (7, "u", "<script>x")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").selectExpr("*", "1 as slot", "'x' as host", "'y' as text")
    out = {r.page_id: r.text for r in webpages.extract(pages).collect()}
    assert out[1] == "" and out[2] == "x\ny <z" and out[3] == "" and out[None] == "plain" and len(out[5]) == 99999 and out[6] == "" and out[7] == ""
    assert plain(webpages.extract(pages.limit(0))) == []


# ------------------------------------------------------------------ 10
def test_rules_equal_brute_force(documents, rows, odd):
    got = {r.doc_id: r for r in rules.judge(documents).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t)
        assert r.kept in (True, False) and not (r.kept and r.base_failed)
    for r in rules.judge(odd).collect():
        t = next(x.text for x in odd.collect() if x.doc_id == r.doc_id)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.rules(t)
    assert plain(rules.judge(odd.limit(0))) == []


def test_host_verdicts(spark):
    good = "these are twenty words of quite clean text that says a little about nothing much at all but stays clean today"
    data = [(k, good + f" {k}" if k % 10 else "bad", "fine") for k in range(200)] + [(1000 + k, "bad" if k % 10 else good, "awful") for k in range(200)] + [(2000, "bad", "small"), (2001, good, "small"), (2002, good, None)]
    got = {r.doc_id: r.kept for r in rules.judge(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()}
    assert got[1] and not got[0] and not got[1000] and got[2002]
    assert got[2001], "a host with one failure of two is drawn to the others' rate"
    kept = rules.keep(spark.createDataFrame(data, "doc_id long, text string, source string"))
    assert {r.doc_id for r in kept.collect()} == {i for i, k in got.items() if k}


# ------------------------------------------------------------------ SQL
def test_queries_equal_sql(spark, sf_dir):
    duckdb = pytest.importorskip("duckdb")
    from textloom.llm import queries

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, sf_dir).toPandas(), c.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda f: sorted(map(str, f[sorted(f.columns)].itertuples(index=False, name=None)))
        assert key(got) == key(want), name


# ------------------------------------------------------------------ shared
def test_no_local_folder_on_a_cluster():
    class Nothing:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(Nothing)  # noqa: N815
        getCheckpointDir = staticmethod(lambda: None)  # noqa: N815

    class Session:
        sparkContext, conf = Context(), Nothing()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
