import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codestrata.llm import attention_lm, mixing, ngram_join, quality, sentencepiece_fst, sharding, token_files
from codestrata.llm.common import scratch_path

WORD = re.compile("[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOW))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(rows, t=75):
    """Brute force: (index -> smallest doc_id of its component)."""
    sets = [shingles(r["text"]) for r in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            low[root(i)] = min(low.get(root(i), r["doc_id"]), r["doc_id"])
    return [(r["doc_id"], len(s), low.get(root(i))) for i, (r, s) in enumerate(zip(rows, sets, strict=True))]


def test_sharding(spark, dirty, nothing):
    placed, stored = sharding.shard_documents(dirty, shards=4, n_slots=64)
    rows = placed.collect()
    assert len(rows) == dirty.count()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r)
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in dirty.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    assert stored.groupBy("version").count().collect()[0]["count"] == 64
    assert sharding.shard_documents(nothing, shards=4, n_slots=64)[0].count() == 0


def test_rebalance_moves_only_the_excess(spark):
    load = spark.createDataFrame([(s, 100 if s == 0 else 10, 1) for s in range(32)], "vslot int, bytes long, rows long")
    first = sharding.initial_map(spark, 4, 32)
    second = sharding.rebalance(first, load, 4).collect()
    sizes = Counter()
    for r in second:
        sizes[r["shard"]] += r["bytes"]
    assert max(sizes.values()) - min(sizes.values()) <= 40
    was = {r["vslot"]: r["shard"] for r in first.collect()}
    assert sum(was[r["vslot"]] != r["shard"] for r in second) <= 8
    grown = sharding.rebalance(sharding.initial_map(spark, 4, 32), load, 5).collect()
    assert {r["shard"] for r in grown} == set(range(5))


def test_ngram_join(dirty, nothing):
    got = ngram_join.near_groups(dirty).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(components(dirty.collect()))
    assert ngram_join.near_groups(nothing).count() == 0


@pytest.mark.parametrize("t", [50, 90])
def test_ngram_join_other_thresholds(dirty, t):
    got = ngram_join.near_groups(dirty, t).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(components(dirty.collect(), t))


def test_ngram_join_large_block(spark, monkeypatch):
    """A block of many tiles, a chain of sets that link only with their neighbours, and strays."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    monkeypatch.setattr(ngram_join, "PART", 5)
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[4 * i : 4 * i + 60])) for i in range(40)]
    rows += [(100 + i, " ".join(w[:90] + [f"x{i}"])) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.near_groups(df).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(components(df.collect()))


def mutants(n, seed=5):
    """Sets of which each keeps most of one base, so that about half of them link with no other."""
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    return [np.unique(np.concatenate([rng.permutation(base)[: 300 - k], rng.integers(0, 2**63, k, dtype=np.uint64)])) for k in rng.integers(0, 80, n).tolist()]


def test_probes_are_verified_against_what_they_meet_alone(monkeypatch):
    """Probes of a part come to every span of tiles; pairs among them are told where one of them is met."""
    sets, told = mutants(90), set()
    probes, met = np.arange(90) < 60, np.arange(90) >= 50
    of = ngram_join.Overlaps.of
    monkeypatch.setattr(ngram_join.Overlaps, "of", lambda self, i, j: told.update(zip(i.tolist(), j.tolist(), strict=True)) or of(self, i, j))
    found = ngram_join.links(sets, 75, None, probes, met)
    assert told and all(probes[i] and met[j] or met[i] and probes[j] for i, j in told)
    up = ngram_join.Union(90)
    for i, j in found:
        up.join(i, j)
    want = ngram_join.Union(90)
    for i in range(90):
        for j in range(i):
            k = len(np.intersect1d(sets[i], sets[j]))
            if (probes[i] and met[j] or met[i] and probes[j]) and 175 * k >= 75 * (len(sets[i]) + len(sets[j])):
                want.join(i, j)
    assert [up.root(i) for i in range(90)] == [want.root(i) for i in range(90)]


def test_overlaps_by_bits_equal_intersections(monkeypatch):
    sets = mutants(40)
    i, j = np.triu_indices(40, 1)
    bits = ngram_join.Overlaps(sets)
    monkeypatch.setattr(ngram_join, "ROWS_BYTES", 0)
    plain = ngram_join.Overlaps(sets)
    assert bits.rows is not None and plain.rows is None
    assert bits.of(i, j).tolist() == plain.of(i, j).tolist()
    assert len(ngram_join.links(sets, 75)) > 10


def test_a_slab_of_near_copies_is_not_all_pairs(monkeypatch):
    points, seen = [ngram_join.point(s) for s in mutants(600)], []
    pairs = ngram_join.RTree.pairs

    def counted(*args):
        for x in pairs(*args):
            seen.append(len(x[0]))
            yield x

    monkeypatch.setattr(ngram_join.RTree, "pairs", counted)
    found = ngram_join.may_link(points, np.array([300] * 600), 75)
    assert len({found.root(k) for k in range(600)}) < 300 and sum(seen) < 600 * 600 // 8


def test_ngram_join_partner_beyond_a_neighbour(spark):
    """In the slabs that A shares with B1 and B2 only A is at home, and between A and B2 stands B1, which does not link with B2."""
    a = [f"w{i}" for i in range(129)]
    rows = [(1, " ".join(a)), (2, " ".join(a + [f"longerword{i}" for i in range(22)])), (3, " ".join(a + [f"otherwords{i}" for i in range(30)]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    got = ngram_join.near_groups(df).select("doc_id", "n_shingles", "component_id").collect()
    assert Counter(map(tuple, got)) == Counter(components(df.collect())) == Counter([(1, 125, 1), (2, 147, 1), (3, 155, 1)])


def test_slab_marks_equal_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(7)
    n = rng.integers(20, 200, 400)
    h, home = rng.integers(0, 40, 400), rng.integers(0, 3, 400) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.arange(400)), pa.array((2 * n + home).astype(np.int32))], names=["h", "class", "nh"])
    small = lambda i, j: home[i] and n[i] <= n[j] and 100 * n[i] >= 75 * n[j]
    may = np.array([any(h[i] == h[j] and i != j and (small(i, j) or small(j, i)) for j in range(400)) for i in range(400)])
    want = {tuple(r.values()) for r in ngram_join._positions(ngram_join._key(h[may], n[may]), ngram_join.FILTER_BITS).to_pylist()}
    got = {tuple(r.values()) for b in ngram_join._shared(ngram_join.FILTER_BITS, 75)([batch]) for r in b.to_pylist()}
    assert got == want


def test_rtree_bound_is_complete():
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (8, 40, 41, 300)]
    sets = base + [np.unique(np.concatenate([b[: int(len(b) * f)], rng.integers(0, 2**63, 3, dtype=np.uint64)])) for b in base for f in (0.5, 0.8, 0.9, 1.0)]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 75 * (len(sets[i]) + len(sets[j]) - k)}
    points = [ngram_join.point(s) for s in sets]
    found = ngram_join.may_link(points, np.array([len(s) for s in sets]), 75)
    assert want and all(found.root(i) == found.root(j) for i, j in want)
    linked = ngram_join.Union(len(sets))
    for i, j in ngram_join.links(sets, 75):
        assert (max(i, j), min(i, j)) in want
        linked.join(i, j)
    assert all(linked.root(i) == linked.root(j) for i, j in want)


def test_quality(spark, dirty, nothing):
    rows = [(i, ("the cat sat on a mat and then it went home " * 3 + str(i)) if i % 3 else ("BUY!! NOW!! " * 12 + str(i)), int(i % 3 > 0)) for i in range(300)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], None) for r in rows] + [(None, 1, 0), (5, None, 0), (7, 1, 0), (7, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["qscore"] for r in quality.score(docs, model).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, _, y in rows)
    scored = quality.score(dirty, model)
    assert scored.columns == [*dirty.columns, "qscore"] and scored.count() == dirty.count()
    assert all(0 <= r["qscore"] <= 1 for r in scored.collect())
    none = quality.Model([], [])
    assert {r["qscore"] for r in quality.score(dirty, none).collect()} == {0.5}
    assert quality.score(nothing, model).count() == 0
    empty = {r["qscore"] for r in scored.where("text is null or text = ''").collect()}
    assert len(empty) == 1


def test_quality_held_out(spark):
    ids = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    assert [r[1] for r in ids.select("doc_id", quality.held_out()).collect()] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)] + [False]


def test_token_files(spark, dirty, nothing):
    from tokenizers import Tokenizer

    path = scratch_path(spark, "t")
    token_files.write_tokens(dirty, path)
    own = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    want = Counter((r["doc_id"], tuple(own.encode(r["text"] or "", add_special_tokens=False).ids) + (0,)) for r in dirty.collect())
    rows = token_files.read_tokens(spark, path)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in rows.collect()) == want
    offsets = {r["part"]: r["offset"] for r in token_files.part_offsets(spark, path).collect()}
    at = 0
    for r in sorted(rows.collect(), key=lambda r: (r["part"], r["local_start"])):
        assert offsets[r["part"]] + r["local_start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows.collect(), key=lambda r: (r["part"], r["local_start"]))]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert {r["doc_id"] for r in token_files.read_tokens(spark, path, 100, 102).collect()} == {100, 101, 102}
    token_files.write_tokens(nothing, empty := scratch_path(spark, "e"))
    assert token_files.read_tokens(spark, empty).count() == 0


def test_token_encoder_equals_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    own, encoder = Tokenizer.from_file(path), token_files.encoder(path)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z\n<|endoftext|> q", " lead  two", "nb sp\u00a0x \u00a0y", "a\0b c\0 d", "\n\nx\ny \n z", "tab\tx y\r\nz", "don't we'll I'm, 'tis 'll", "Ġx y Ġ", "日本 語", " ", "", "x "]
    got = encoder.encode_many(texts)
    assert [g.tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert 50256 in got[0].tolist()


def test_token_units_known_by_hash(monkeypatch):
    """Plain texts go by units alone; forgotten, odd, long and repeated units give the library's ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path(token_files.TOKENIZER)
    own, encoder = Tokenizer.from_file(path), token_files.Encoder(path)
    monkeypatch.setattr(token_files, "KNOWN", 12)
    plain = [["one two, two\nthree one", "One TWO é", "", "don't one\n日本 <x>"], ["ab" * 100, "", "a\0b c\0 d\0\n\0e"], [], ["two, one", *(f"w{i} one\nx{i}" for i in range(40))], ["one", "one two, 7"]]
    mixed = ["a\n\nb", " a", "a ", "\n", "a\u3000b c", "one \u00a0two", "x " + "ab" * 200, "a <|endoftext|> b", "one two", "\u2028", "a\u0085", "ab\x1cc"]
    for texts in plain:
        assert [g.tolist() for g in encoder.encode_many(texts)] == [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert not encoder.cache and len(encoder.keys) < 100
    for _ in range(2):
        assert [g.tolist() for g in encoder.encode_many(mixed)] == [own.encode(t, add_special_tokens=False).ids for t in mixed]


def test_sentencepiece(dirty, nothing):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(sentencepiece_fst.MODEL))
    rows = sentencepiece_fst.decode(sentencepiece_fst.encode(dirty, out="pieces"), "pieces").collect()
    assert len(rows) == dirty.count()
    for r in rows:
        if r["text"] is None:
            assert r["pieces"] is None and r["decoded"] is None
        else:
            assert r["pieces"] == own.encode(r["text"]) and r["decoded"] == own.decode(r["pieces"])
            assert r["decoded"] == r["text"].replace("▁", " ")
    assert sentencepiece_fst.encode(nothing, out="pieces").count() == 0


def test_sentencepiece_depth_first_equals_sweep(spark):
    own, rng = sentencepiece_fst.transducer(), np.random.default_rng(8)
    letters = [p for p in own.ids if len(p) == 1]
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(200).collect()
    units = {u for r in rows for u in sentencepiece_fst.UNIT.findall(own.normalise(r["text"] or ""))}
    units |= {"".join(rng.choice(letters[:60], int(k))) for k in rng.integers(1, 30, 2000)} | {"a" * 300, "ab" * 200, sentencepiece_fst.SPACE * 9}
    known = [u for u in sorted(units) if all(ch in own.ids for ch in u)]
    assert len(known) > 2000
    for u in known:
        assert own.deepest(u) == own.swept(u)


def test_sentencepiece_unigram_is_the_cheapest_path():
    import itertools
    import struct

    def piece(name, score, kind=1):
        body = b"\x0a" + bytes([len(name.encode())]) + name.encode() + b"\x15" + struct.pack("<f", score) + b"\x18" + bytes([kind])
        return b"\x0a" + bytes([len(body)]) + body

    scores = {"▁": -2.0, "a": -3.0, "b": -3.5, "ab": -4.0, "▁a": -3.2, "ba": -5.0, "aba": -7.5, "▁ab": -9.0}
    raw = piece("<unk>", 0, 2) + b"".join(piece(p, s) for p, s in scores.items()) + b"\x12\x02\x18\x01" + b"\x1a\x06\x18\x01\x20\x00\x28\x01"
    fst = sentencepiece_fst.Transducer(raw)
    for n in range(1, 6):
        for chars in itertools.product("ab", repeat=n):
            text = "▁" + "".join(chars)
            cuts = itertools.product(["", "|"], repeat=n)
            paths = ["".join(c + k for c, k in zip(text, (*cut, ""), strict=True)).split("|") for cut in cuts]
            best = min(-sum(scores[p] for p in path) for path in paths if all(p in scores for p in path))
            got = fst.encode("".join(chars))
            assert -sum(fst.score[i] for i in got) == pytest.approx(best)
            assert fst.decode(got.tolist()) == "".join(chars)


def test_language_model(dirty, nothing):
    got = attention_lm.score_documents(dirty).collect()
    rows = dirty.collect()
    counts = Counter()
    for r in rows:
        if r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 7 != 2:
            counts.update([*words(r["text"]), None])
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r in rows:
        w = [*words(r["text"]), None]
        want[(r["doc_id"], len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)
    assert attention_lm.score_documents(nothing).count() == 0


def small_model(rng, width: int = 4, ids: int = 30):
    """A model with random weights over a few ids, and the ids that begin words."""
    starts = np.arange(ids) % 3 == 0
    starts[ids - 1] = True
    model = attention_lm.Model(attention_lm.Tree(rng.integers(0, 50, ids), starts), width)
    model.w = {k: rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in model.w.items()}
    return model, starts


def scalar_log_p(model, text):
    """log p of each id and of its first decision, one number at a time, by the definitions in the module's text."""
    w, d, out = model.w, model.width, []
    x = [attention_lm.END % len(w["e"]), *text[:-1]]
    for i, y in enumerate(text):
        begin = max(0, i // attention_lm.STRIDE - 1) * attention_lm.STRIDE
        first = (i // attention_lm.STRIDE - 1) * attention_lm.STRIDE  # place 0 of the window
        q = w["e"][x[i], :d] @ w["q"] + w["qp"][i % attention_lm.STRIDE]
        weights = {j: math.exp(q @ (w["e"][x[j], :d] @ w["k"] + w["kp"][j - first]) / math.sqrt(d)) for j in range(begin, i + 1)}
        h = sum(p * (w["e"][x[j], :d] @ w["v"]) for j, p in weights.items()) / sum(weights.values()) + w["e"][x[i], d:]
        at = slice(model.tree.start[y], model.tree.start[y] + model.tree.length[y])
        steps = [-math.log1p(math.exp(-sign * (w["u"][node] @ h + w["b"][node]))) for node, sign in zip(model.tree.nodes[at], model.tree.signs[at], strict=True)]
        out.append((sum(steps), steps[0]))
    return np.array(out)


def test_attention_equals_scalars(monkeypatch):
    """Batched masked attention over overlapping windows gives what one position after another gives."""
    monkeypatch.setattr(attention_lm, "END", 29)
    rng = np.random.default_rng(3)
    model, _ = small_model(rng)
    texts = [rng.integers(0, 30, n) for n in (1, 15, 16, 17, 40, 100, 2, 1600)]
    p, root = model.score(texts)
    want = np.concatenate([scalar_log_p(model, t.tolist()) for t in texts])
    assert p == pytest.approx(want[:, 0], abs=1e-4) and root == pytest.approx(want[:, 1], abs=1e-4)


def test_scores_of_words_are_a_distribution(monkeypatch):
    """After any beginning the ids' probabilities sum to 1, and so do those of words of up to some ids and longer ones."""
    monkeypatch.setattr(attention_lm, "END", 29)
    rng = np.random.default_rng(5)
    model, starts = small_model(rng)
    start = rng.integers(0, 30, 21)
    after = [np.append(start, i) for i in range(30)]
    p, root = model.score(after)
    assert np.exp(p[21::22].astype(float)).sum() == pytest.approx(1, abs=1e-5)
    counts = {tuple([3]): 5, (6, 1): 2, (29,): 3}  # words by their ids; the last is the end
    words_ = attention_lm.Words(sum(counts.values()), len(counts))
    total = 0.0
    begins = [i for i in range(30) if starts[i]]
    one = np.array([np.append(start, i) for i in begins])
    p, root = model.score(list(one))
    for k, i in enumerate(begins):
        first = float(p[k * 22 + 21] - root[k * 22 + 21])
        if i == 29:
            own = [((29,), first)]
        else:
            nexts = [np.append(one[k], j) for j in range(30)]
            q, r = model.score(nexts)
            goes_on = [(j, float(q[j * 23 + 22])) for j in range(30) if not starts[j]]
            ends = float(r[begins[0] * 23 + 22])
            own = [((i,), first + ends)] + [((i, j), first + lp) for j, lp in goes_on]  # (i, j) stands for all longer words that begin so
        for word, lp in own:
            seen = sum(c for w, c in counts.items() if w == word or len(word) == 2 and w[:2] == word)
            rest, weight = words_.parts(np.array([lp]), np.array([0]), np.array([0]))
            total += 10 ** float(words_.log10(rest, weight, np.array([float(seen)]))[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_every_id_sees_a_window_back(monkeypatch):
    """The id ten places back changes an id's probability, wherever windows begin."""
    monkeypatch.setattr(attention_lm, "END", 29)
    rng = np.random.default_rng(4)
    model, _ = small_model(rng)
    text = rng.integers(0, 29, 70)
    for p in range(11, 70):
        other = text.copy()
        other[p - 11] = (other[p - 11] + 1) % 29
        a, b = (model.score([t])[0][p] for t in (text, other))
        assert a != b, p


def test_copying_counts_earlier_words():
    of, hashes = np.array([0, 0, 0, 1, 1, 0]), np.array([5, 6, 5, 5, 5, 5], np.uint64)
    assert attention_lm.earlier(of, hashes).tolist() == [0, 0, 1, 0, 1, 2]
    rng = np.random.default_rng(0)
    of, hashes = np.sort(rng.integers(0, 9, 4000)), rng.integers(0, 50, 4000).astype(np.uint64)
    seen = Counter()
    for o, h, n in zip(of.tolist(), hashes.tolist(), attention_lm.earlier(of, hashes).tolist(), strict=True):
        assert n == seen[o, h]
        seen[o, h] += 1
    assert attention_lm.earlier(of[:0], hashes[:0]).tolist() == []


def test_subword_counts_survive_the_last_flush(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(attention_lm, "HELD_WORDS", 2)
    batch = pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([b"one two three four"], pa.binary())], names=["doc_id", "text"])
    rows = [r for b in attention_lm._prepared(attention_lm.TOKENIZER)([batch]) for r in b.to_pylist()]
    assert sum(r["n"] for r in rows if r["kind"] == 2) == len(rows[0]["ids"]) // 2


def test_subwords_equal_library_word_by_word():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    texts = ["a\u00a0b c", "\u00a0 \u00a0", "Don't STOP\tnow", "", "x\u2003", "日本 é <|endoftext|>", "\u00a0x y"]
    got, distinct, which, n = attention_lm.subwords().encode([t.encode() for t in texts])
    assert n.tolist() == [len(t.encode().split()) for t in texts] and (distinct[which] == attention_lm.word_hashes([t.encode() for t in texts])[0]).all()
    for t, raw in zip(texts, got, strict=True):
        ids = np.frombuffer(raw, np.uint16)
        own = [w.decode() for w in t.encode().translate(attention_lm.LOWER).split()]
        assert ids.tolist() == [i for w in own for i in library.encode(" " + w, add_special_tokens=False).ids] + [attention_lm.END]
        assert attention_lm.subwords().starts[ids].sum() == len(own) + 1


def test_forgotten_subwords_are_learned_again(monkeypatch):
    texts = [[b" ".join(b"w%d" % (i * i % m) for i in range(k, k + 40)), b"", b"Every text has these words"] for k in range(0, 400, 20) for m in (7, 331)]
    fresh = [attention_lm.Subwords(public_tokenizers.path(attention_lm.TOKENIZER)).encode(t)[0] for t in texts[:4]]
    for most in (4, 60, 1000):
        monkeypatch.setattr(attention_lm, "CACHE", most)
        own = attention_lm.Subwords(public_tokenizers.path(attention_lm.TOKENIZER))
        got = [own.encode(t)[0] for t in texts + texts[:4]]
        assert got[-4:] == got[:4] == fresh
        assert (np.diff(own.keys.astype(object)) > 0).all() and len(own.keys) == len(own.entry) <= len(own.begin) - 1
        assert len(own.begin) == len(own.length) == len(own.met)


def test_language_model_trains_on_long_texts(spark):
    """The only training text is one long text."""
    docs = spark.createDataFrame([(None, "red green blue " * 12000), (1, "red green blue red green blue")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in attention_lm.score_documents(docs).collect()}
    assert got[1] / 7 > -1


def test_training_lowers_the_loss(spark):
    """Over partitions, by every text: the mean of what tasks learn gives later texts more than counts alone."""
    rng = np.random.default_rng(2)
    texts = [np.append(np.cumsum(rng.integers(1, 3, n)) % 40, attention_lm.END).astype(np.uint16) for n in rng.integers(1, 3000, 120)]
    starts = attention_lm.subwords().starts
    model = attention_lm.Model(attention_lm.Tree(np.bincount(np.concatenate(texts), minlength=attention_lm.VOCABULARY), starts))
    before = model.score(texts)[0].mean()
    attention_lm.train(spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary").repartition(3), model)
    assert model.score(texts)[0].mean() > before + 0.5


def test_every_window_trains(spark):
    """Each window's id, in texts of many windows and of one, stands nowhere else."""
    windows = np.arange(40, 2600)
    texts = [np.append(np.repeat(w, attention_lm.STRIDE), attention_lm.END).astype(np.uint16) for w in [*np.split(windows[:1536], 3), *windows[1536:, None]]]
    model = attention_lm.Model(attention_lm.Tree(np.bincount(np.concatenate(texts), minlength=attention_lm.VOCABULARY), attention_lm.subwords().starts))
    attention_lm.train(spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "ids binary").repartition(2), model)
    last = model.tree.nodes[(model.tree.start + model.tree.length - 1)[windows]]  # decisions that no other text's windows but a sibling's make
    assert model.w["u"].any(1)[last].all()  # all rows begin as 0


def test_attention_gradients(monkeypatch):
    monkeypatch.setattr(attention_lm, "END", 29)
    rng = np.random.default_rng(1)
    model, _ = small_model(rng)
    x, fresh, y, keep = attention_lm.slots([rng.integers(0, 30, n) for n in (5, 40, 33)])
    grads = model.gradients(x, fresh, y, keep)[1]
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    for name, w in model.w.items():
        rows, g = grads[name]
        k = int(rng.integers(0, len(rows)))
        at = (rows[k], *(int(rng.integers(0, s)) for s in w.shape[1:]))
        w[at] += 1e-4
        up = model.gradients(x, fresh, y, keep)[0]
        w[at] -= 2e-4
        down = model.gradients(x, fresh, y, keep)[0]
        w[at] += 1e-4
        assert g[(k, *at[1:])] == pytest.approx((up - down) / 2e-4, rel=0.02, abs=1e-3), name


def test_top_nodes_change_nothing(monkeypatch):
    """The root's decisions, those of some nodes or all by one product: the same scores and gradients."""
    monkeypatch.setattr(attention_lm, "END", 29)
    rng = np.random.default_rng(4)
    model, _ = small_model(rng)
    texts = [rng.integers(0, 30, n) for n in (5, 40, 33)]
    found = []
    for top in (1, 6, 64):
        monkeypatch.setattr(attention_lm, "TOP", top)
        loss, grads = model.gradients(*attention_lm.slots(texts))
        whole = {k: np.zeros_like(w) for k, w in model.w.items()}
        for name, (at, g) in grads.items():
            assert len(np.unique(at)) == len(at)
            whole[name][at] = g
        found.append([np.float64(loss), *model.score(texts), *whole.values()])
    for other in found[1:]:
        for x, y in zip(found[0], other, strict=True):
            np.testing.assert_allclose(y, x, rtol=1e-3, atol=1e-4)


def held_out_figures(spark, sf: str):
    rows = attention_lm.op7_attention_lm(spark, f"/root/testdata/{sf}").where("held_out").agg({"score": "sum", "base_score": "sum", "n_tokens": "sum"}).first()
    return rows["sum(score)"] / rows["sum(n_tokens)"], rows["sum(base_score)"] / rows["sum(n_tokens)"]


def test_language_model_held_out(spark):
    """Against the words' own frequencies, of which the base makes no distribution: it gives every unseen word a seen one's share."""
    score, base = held_out_figures(spark, "sf0.01")
    assert score > base - 0.15


def test_mixing(spark, dirty, nothing):
    rows = [(i, "w " * (5 if i % 10 else 50), "big" if i % 4 else f"small{i % 8}") for i in range(400)] + [(900, None, None), (901, "x y", "tiny"), (902, "x y", "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    narrow = mixing.counted(docs)
    got = mixing.drawn(narrow, mixing.plan(narrow)).collect()
    size, drawn = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    for r in got:
        drawn[r["source"]] += r["n_tokens"]
    assert {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert drawn["big"] == size["big"] and drawn["tiny"] <= 2 * size["tiny"]
    times = {s: drawn[s] / size[s] for s in size if size[s]}
    assert max(times.values()) <= 2 and times["tiny"] >= max(times.values()) - 0.5
    assert sum({r["source"]: r["weight"] for r in got}.values()) == pytest.approx(1)
    order = [r["order_key"] for r in got if r["source"] == "big"]
    assert len(set(order)) == len(order)
    budget = mixing.drawn(narrow, mixing.plan(narrow, budget=500)).agg(F.sum("n_tokens")).first()[0]
    assert 350 <= budget <= 500
    flat = mixing.weights(narrow.groupBy("source").agg(F.sum("n_tokens").alias("tokens")), min_entropy=1.2).where("tokens > 0").collect()
    assert -sum(r["weight"] * math.log(r["weight"]) for r in flat) == pytest.approx(1.2, abs=1e-4)
    assert mixing.mixed(spark, dirty, "").columns == dirty.columns
    assert mixing.mixed(spark, dirty, "").select("doc_id").distinct().count() == dirty.select("doc_id").distinct().count()
    assert mixing.mixed(spark, nothing, "").count() == 0
    with pytest.raises(ValueError):
        mixing.drawn(docs.withColumn("block", F.lit(1)), mixing.plan(narrow))


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
@pytest.mark.parametrize("width", [3, 16])
def test_sums_of_rows(dtype, width):
    """Rows of equal places summed at once, of parts that go to the last places, as one after another gives."""
    rng = np.random.default_rng(9)
    values = rng.integers(0, 1 << 16, 40)[rng.integers(0, 40, 300)]
    found, place = attention_lm.distinct(values)
    assert found.tolist() == sorted(set(values.tolist())) and (found[place] == values).all()
    many, at = attention_lm.distinct(np.tile(values, 200))
    assert many.tolist() == found.tolist() and (at == np.tile(place, 200)).all()
    parts = [rng.normal(0, 1, (n, width)).astype(dtype) for n in (300, 284)]
    for part, got in zip(parts, attention_lm.summed_rows(parts, place, len(found)), strict=True):
        want = np.zeros((len(found), width), dtype)
        np.add.at(want, place[-len(part) :], part)
        assert got.dtype == dtype
        np.testing.assert_allclose(got, want, rtol=1e-4, atol=1e-5)


def test_ways_of_a_tree():
    """Top nodes, then all others, are the way to every id, however many are top nodes."""
    rng = np.random.default_rng(10)
    tree = attention_lm.Tree(rng.integers(0, 9000, 300), np.arange(300) % 3 == 0)
    for top in (1, 64, 200, 299):
        where, *codes = tree.ways(top)
        for i in range(300):
            way = slice(tree.start[i], tree.start[i] + tree.length[i])
            want = (2 * tree.nodes[way] + (tree.signs[way] > 0)).tolist()
            high, begin, low, low_begin = where[i].tolist()
            assert codes[0][begin : begin + high].tolist() + codes[1][low_begin : low_begin + low].tolist() == want
            assert all(c < 2 * top for c in want[:high]) and all(c >= 2 * top for c in want[high:])


def test_slabs_of_a_few_need_no_tree(monkeypatch):
    import pyarrow as pa

    from codestrata.llm import ngram_join as J

    rng = np.random.default_rng(5)
    base = [np.unique(rng.integers(1, 1 << 62, n, dtype=np.uint64)) for n in (9, 40, 300, 4000, 270)]
    sets = [np.concatenate([s, rng.integers(1, 1 << 62, extra, dtype=np.uint64)]) for s in base for extra in (0, 1, len(s) // 9, len(s) // 5, len(s))]
    packed = [J.packed(J.point(s)) for s in sets]
    rows = [(h, k) for h in range(60) for k in rng.choice(len(sets), rng.integers(2, 7), replace=False).tolist()]
    rows += [(100 + h, k) for h in range(5) for k in range(5 * h, 5 * h + 5)]
    want = J.Union(len(sets))
    for h in {h for h, _ in rows}:
        at = [k for g, k in rows if g == h]
        for i in at:
            for j in at:
                if i < j and J.may_link([J.unpacked(packed[k]) for k in (i, j)], np.array([len(sets[k]) for k in (i, j)]), 75).root(1) == 0:
                    want.join(i, j)
    monkeypatch.setattr(J, "may_link", lambda *_: pytest.fail("a tree for a few points"))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), pa.array([packed[r[1]] for r in rows], pa.binary())], names=["h", "class", "body"])
    got = J.Union(len(sets))
    for b in J._trees(75)(iter([batch])):
        for x, y in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), strict=True):
            got.join(x, y)
    assert [got.root(k) for k in range(len(sets))] == [want.root(k) for k in range(len(sets))]
    assert len({want.root(k) for k in range(len(sets))}) < len(sets)
