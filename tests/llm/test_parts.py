"""The operators' own pieces against plain versions of them."""

import io
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from tessera.llm import bytes_np, decontamination, language_id, near_vectors, parity_join, piece_dropout, quality, token_files, toxicity
from tessera.llm.bytes_np import WHITE, Substrings, word_spans
from tessera.llm.common import utf8_chunks
from tessera.llm.components import connected_components
from tessera.llm.token_counts import count_tokens, read_cache
from tessera.llm.tokenizing import CachedEncoder, version_digest

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were".split()


def text(n, seed):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + str(draw.randrange(60)) for _ in range(n))


# --- bytes -------------------------------------------------------------------------------------


def test_chunks_and_words():
    rows = ["a b", None, "", "ä  B\n", "x" * 50, " "]
    for limit in (1, 5, 1000):
        got = []
        for a, b, data, offsets in utf8_chunks(pa.array(rows).slice(0), limit):
            s, e, t = word_spans(data, offsets, ~WHITE)
            got += [(a + k, bytes(data[i:j])) for i, j, k in zip(s, e, t)]
        assert got == [(k, w.encode()) for k, r in enumerate(rows) for w in re.findall(r"[^ \t-\r]+", r or "")]


def test_hash_depends_on_the_substring_alone():
    data = np.frombuffer(b"abcXabcxABC", np.uint8)
    h = Substrings(data).hashes(np.array([0, 4, 8, 1, 3, 7]), np.array([3, 7, 11, 3, 4, 8]))
    assert h[0] == h[1] == h[2] and len({*h.tolist()}) == 3 and h[4] == h[5]


def test_long_data_hash_as_short_ones(monkeypatch):
    data = np.frombuffer((b"some words, " * 40 + b"x" * 300 + b" A b C " * 9), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ~WHITE)
    want = Substrings(data).hashes(starts, ends)
    for size in (7, 64, 128):
        monkeypatch.setattr(bytes_np, "BLOCK", size)
        assert (Substrings(data).hashes(starts, ends) == want).all()


# --- op6 ---------------------------------------------------------------------------------------


def test_sets_of_a_batch_equal_sets_alone():
    rows = ["one", "", "a b c d e f g a b c d e f", "A B C D", "x y z w v", None, text(300, 1), text(40, 2), "a b c d"]
    (_, _, data, offsets),  = utf8_chunks(pa.array(rows))
    values, at = parity_join.shingle_runs(data, offsets)
    keys, owners, need = parity_join.set_keys(values, at)
    digests = parity_join.digests(values, at)
    assert digests[3].tolist() == digests[8].tolist() and len({tuple(d) for d in digests.tolist()}) == 7
    for k, row in enumerate(rows):
        own = values[at[k] : at[k + 1]]
        words = (row or "").lower().split()
        assert len(own) == len({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)) if words})
        if row:
            (_, _, data, offsets), = utf8_chunks(pa.array([row]))
            alone, one = parity_join.shingle_runs(data, offsets)
            assert (alone == own).all() and (np.diff(own.astype(object)) > 0).all()
            k2, _, n2 = parity_join.set_keys(alone, one)
            assert sorted(k2) == sorted(keys[owners == k]) and (n2[0] == need[k]).all()
            assert (parity_join.digests(alone, one)[0] == digests[k]).all()


def edited(words, seed, rate):
    draw = random.Random(seed)
    return [w if draw.random() > rate else f"e{draw.randrange(10**6)}" for w in words]


@pytest.mark.parametrize("n", [3, 5, 9, 17, 33, 60, 130, 400, 1500])
def test_linked_sets_share_the_keys_they_need(n):
    draw = random.Random(n)
    for trial in range(40):
        a = {draw.getrandbits(64) for _ in range(n)}
        b = set(sorted(a)[: max(1, n - draw.randrange(0, max(1, n // 6) + 1))]) | {draw.getrandbits(64) for _ in range(draw.randrange(0, max(1, n // 7) + 1))}
        if not parity_join.linked(len(a & b), len(a), len(b)) or a == b:
            continue
        arrays = [np.array(sorted(x), np.uint64) for x in (a, b)]
        (ka, _, na), (kb, _, nb) = (parity_join.set_keys(x, np.array([0, len(x)])) for x in arrays)
        na, nb = na[0], nb[0]
        common = np.intersect1d(ka, kb)
        assert len(common), (n, trial)
        kinds = common & np.uint64(parity_join.KIND)
        counts = [int((kinds == k).sum()) for k in range(3)]
        # The guarantee is about one kind: that of the smaller set's band, or prefix keys.
        assert any(c >= max(x, y) for c, x, y in zip(counts, na, nb) if c), (counts, na, nb)
        assert bool(parity_join.may_link(parity_join.sketch(arrays[0]), len(a), parity_join.sketch(arrays[1]), len(b)))


def test_sketch_distance_never_exceeds_the_difference():
    draw = random.Random(3)
    for n in (1, 10, 100, 1000):
        a = {draw.getrandbits(64) for _ in range(n)}
        b = set(list(a)[n // 2 :]) | {draw.getrandbits(64) for _ in range(n)}
        x, y = (parity_join.sketch(np.array(sorted(s), np.uint64)) for s in (a, b))
        width = min(len(x), len(y))
        assert np.bitwise_count(parity_join.folded(x, width) ^ parity_join.folded(y, width)).sum() <= len(a ^ b)


def test_similar_groups_equal_brute_force(spark):
    from tests.llm.test_queries_small import brute_groups

    rows, k = [], 0
    for base in range(12):
        words = text(random.Random(base).choice([6, 12, 40, 120, 300]), base).split()
        for copy in range(random.Random(100 + base).choice([1, 2, 5, 40])):
            rows.append((k, " ".join(edited(words, 1000 * base + copy, random.Random(copy).choice([0, 0.01, 0.03, 0.05])))))
            k += 1
    passage = text(60, 999)
    rows += [(k + i, f"{text(80, 5000 + i)} {passage} {text(40, 6000 + i)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similar_groups(df).collect()}
    assert got == brute_groups(rows)


def test_large_groups_are_tested_in_blocks(spark, monkeypatch):
    from tests.llm.test_queries_small import brute_groups

    monkeypatch.setattr(parity_join, "LIST_ROWS", 2)
    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 7)
    words = text(120, 1).split()
    rows = [(k, " ".join(edited(words, k, 0.04))) for k in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in parity_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_components(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 205), (205, 203)]
    got = dict(connected_components(spark.createDataFrame(chain, "a long, b long")).collect())
    assert got == {k: 0 for k in range(61)} | {100: 100, 101: 100, 200: 200, 203: 200, 205: 200}


# --- op1 ---------------------------------------------------------------------------------------


def brute_links(x, labels):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None]) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize(("block", "tables"), [(1024, None), (8, None), (1024, (12, 28))])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block, tables):
    monkeypatch.setattr(near_vectors, "BLOCK_ROWS", block)
    random_ = np.random.default_rng(1)
    centres = random_.standard_normal((30, 32))
    x = (centres[random_.integers(0, 30, 300)] + 0.12 * random_.standard_normal((300, 32))).astype(np.float32)
    x[:40] = x[0]
    labels = random_.integers(0, 3, 300)
    link = brute_links(x.astype(float), labels)
    df = spark.createDataFrame([(k, x[k].tolist(), int(labels[k])) for k in range(300)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_vectors.near_vectors(df, tables=tables).collect()}
    found, all_links = sum(r["n_links"] for r in got.values()), int(link.sum())
    assert found <= all_links and found >= 0.99 * all_links
    assert all(got[k]["component_id"] <= k and got[k]["kept"] == (got[k]["component_id"] == k) for k in range(300))


def test_vectors_of_any_length_and_size_link(spark):
    rows = [(0, [1.0, 0.1], "a"), (1, [2.0, 0.2], "a"), (2, [1.0, 0.1, 0.0], "a"), (3, [1.0, 0.12, 0.0], "a"), (4, [-1.0], "a"), (5, [-7.0], "a"), (6, [3.0], "a")]
    rows += [(7, [1e200, 1e199], "a"), (8, [1e-200, 1e-201], "a"), (9, [1.0, 0.1], "b")]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {0: (3, 0), 1: (3, 0), 7: (3, 0), 8: (3, 0), 2: (1, 2), 3: (1, 2), 4: (1, 4), 5: (1, 4), 6: (0, 6), 9: (0, 9)}


def test_pairs_compared_grow_slowly():
    """Random vectors meet as often as the plan says: pairs grow as less than the 1.3th power of the rows."""
    random_ = np.random.default_rng(7)
    met = []
    for n in (8_192, 65_536):
        bits, tables = near_vectors.planned_tables(n, 0.93)
        x = random_.standard_normal((n, 48))
        codes = near_vectors.fit_quantiser(x[:2000], tables, bits, rounds=5).codes(near_vectors.unit_rows(x))
        sizes = [np.unique(codes[:, t], return_counts=True)[1] for t in range(tables)]
        met.append(sum(int((s * (s - 1) // 2).sum()) for s in sizes))
    assert np.log(met[1] / met[0]) / np.log(8) < 1.3


def test_rotations_are_orthogonal_and_codes_balanced():
    x = np.random.default_rng(2).standard_normal((2000, 16)) * np.linspace(3, 0.3, 16)
    q = near_vectors.fit_quantiser(x, tables=4)
    r = q.rotations[:, :16]
    assert np.allclose(r.T @ r, np.eye(16), atol=1e-8)
    ones = np.unpackbits(q.codes(near_vectors.unit_rows(x)), axis=1).mean(axis=0)
    assert (abs(ones - 0.5) < 0.2).all()


# --- op2 ---------------------------------------------------------------------------------------


def least_distance(pattern, target):
    row = [0] * (len(target) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(target, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    draw = random.Random(5)
    for _ in range(200):
        p = "".join(draw.choice("abc") for _ in range(draw.randrange(1, 90)))
        t = "".join(draw.choice("abc") for _ in range(draw.randrange(0, 120)))
        assert decontamination.Pattern(p).distance(t) == least_distance(p, t)


def test_pieces_find_every_item_within_its_budget():
    draw = random.Random(6)
    items = tuple((k, decontamination.normalised(text(30, 40 + k))) for k in range(6))
    matcher = decontamination.Matcher(items, 0.08)
    for trial in range(60):
        k = draw.randrange(6)
        chars = list(items[k][1])
        for _ in range(draw.randrange(0, 20)):
            at = draw.randrange(len(chars))
            chars[at : at + 1] = draw.choice([[], ["x"], [chars[at], "y"]])
        doc = f"{text(20, trial)} {''.join(chars)} {text(20, trial + 500)}"
        plain = decontamination.normalised(doc)
        want = sorted((i, d) for i, t in items if (d := least_distance(t, plain)) <= decontamination.budget(len(t), 0.08))
        assert matcher.find(doc) == want


def test_items_in_batches(spark):
    items = spark.createDataFrame([(k, text(20, k)) for k in range(7)] + [(9, "short")], "item_id long, text string")
    docs = spark.createDataFrame([(k, f"x {text(20, k).upper()}!! y") for k in range(7)] + [(8, "clean")], "doc_id long, text string")
    batches = list(decontamination.item_batches(items, 300))
    assert len(batches) > 2 and sum(map(len, batches)) == 8
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.contaminated(docs, items, batch_chars=300).collect()}
    assert got == {k: [k] for k in range(7)} | {8: []}


def test_an_item_of_several_texts_counts_with_its_nearest(spark):
    items = spark.createDataFrame([(1, text(20, 1)), (1, text(20, 1) + "s"), (1, text(20, 2))], "item_id long, text string")
    got = decontamination.contaminated(spark.createDataFrame([(1, text(20, 1) + "s!")], "doc_id long, text string"), items).collect()
    assert [(r["item_ids"], r["distance"]) for r in got] == [([1], 0)]


def test_short_items_are_found_as_whole_words(spark):
    items = spark.createDataFrame([(1, "E = mc^2"), (2, "水的沸点是多少？"), (3, "Ada Lovelace"), (4, "?!")], "item_id long, text string")
    docs = {1: "so e=mc^2 holds", 2: "问：请问水的沸点是多少呢", 3: "ADA  LOVELACE", 4: "Canada Lovelace, Ada Lovelaces, me mc 2, ?!", 5: "x ada lovelaces ada lovelace"}
    rows = decontamination.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), items).collect()
    assert {r["doc_id"]: r["item_ids"] for r in rows} == {1: [1], 2: [2], 3: [3], 4: [], 5: [3]}
    assert all(r["distance"] == 0 for r in rows if r["contaminated"])


# --- op3, op10, op5 ----------------------------------------------------------------------------


def test_counterfactual_penalty_evens_out_groups():
    toxic = [f"those women are trash {k}" for k in range(40)]
    fine = [f"the men went home {k}" for k in range(40)] + [f"some neutral words {k}" for k in range(40)]
    rows, y = toxicity.features_of(toxic + fine), np.array([1.0] * 40 + [0.0] * 80)
    pairs = [tuple(toxicity.features_of(list(p))) for t in toxic + fine for p in toxicity.counterfactuals(t)]
    chosen = np.unique(np.concatenate(rows))
    gap = {}
    for weight in (0.0, 50.0):
        model = toxicity.fit_weights(chosen, rows, y, pairs, counterfactual=weight, l2=0.05)
        a, b = model.score(toxicity.features_of(["women here", "men here"]))
        gap[weight] = a - b
        assert model.score(toxicity.features_of(["such trash"]))[0] > 0.5
    assert gap[50.0] < 0.1 < gap[0.0]


def test_counterfactual_sentences():
    assert toxicity.counterfactuals("Women sing. Nothing here.") == [("women sing.", "men sing.")]
    assert toxicity.counterfactuals("womenfolk") == []


def test_trees_learn_and_flatten():
    x = np.random.default_rng(0).random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = quality.fit_trees(x, y, trees=60)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97

    def walk(row):
        total = model.base
        for f, t, leaf in zip(model.feature, model.threshold, model.leaf):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + int(row[f[k]] > t[k])
            total += leaf[k - len(f)]
        return total

    assert np.allclose([walk(r) for r in x[:50]], model.margin(x[:50]))
    assert 0 < quality.fit_trees(x, np.ones(800)).score(x[:1])[0] <= 1 and len(quality.fit_trees(x[:0], y[:0]).score(x[:3])) == 3


def test_statistics_don_t_depend_on_neighbours():
    rows = ["Some words. More, words!", "", "x | y | z\nx | y | z", "%%% a$ b&", "ABC " * 30]
    one = [quality.statistics(d, o)[0] for r in rows for _, _, d, o in utf8_chunks(pa.array([r]))]
    whole = np.vstack([quality.statistics(d, o) for _, _, d, o in utf8_chunks(pa.array(rows))])
    assert np.allclose(one, whole) and whole.shape[1] == len(quality.FEATURES)


def test_rank_order_distance():
    grams, counts = language_id.ngram_counts("Ab ab")
    names = {int(g): int(c) for g, c in zip(grams, counts)}
    a, b = ord("a"), ord("b")
    gram = lambda *c: sum(x << 21 * k for k, x in enumerate(reversed(c)))
    want = {gram(*c): 2 for c in ((a,), (b,), (1, a), (a, b), (b, 1), (1, a, b), (a, b, 1))}
    assert names == want
    profile = language_id.ranked(grams, counts, 5)
    assert profile.tolist() == sorted(want)[:5]
    p = language_id.Profiles(["x", "y"], [profile, profile[::-1].copy()], 5)
    want = [0.0, sum(abs(i - (4 - i)) for i in range(5)) / 25]
    assert np.allclose(p.distances(profile), want)
    assert p.predict("ab ab")[0] == "x" and p.predict(None)[0] == p.predict("1 2")[0] == "und"


# --- op4, op8, op9 -----------------------------------------------------------------------------

ODD = ["", " ", "  ", " a  b ", "x\n  y\n", "日本語 漢字", "😀 ﬁ", "a▁b ▁", "<s> </s>", "q" * 90, "\t\ttab  ", "é" * 45]


def test_no_dropout_equals_the_library():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = piece_dropout.OccurrenceEncoder(MODEL, 1, 0.0)
    for t in [text(200, 1), *[t for t in ODD if "▁" not in t]]:
        assert np.frombuffer(encoder.encode([t], [0])[0], "<u4").tolist() == own.encode(t)


def test_dropout_agenda_seeds_and_decoding():
    v = piece_dropout.pieces(MODEL)
    samples = [text(150, 2), *ODD]
    seen = set()
    for seed in (1, 2):
        encoder = piece_dropout.OccurrenceEncoder(MODEL, seed, 0.3)
        by = range(len(samples))
        got = encoder.encode(samples, by)
        assert got == encoder.encode(samples, by)
        for k, (t, ids) in enumerate(zip(samples, got)):
            assert encoder.decode(ids) == t
            chunks = piece_dropout._chunks(t)
            keys = piece_dropout.occurrence_keys(k, t, len(chunks), seed).tolist()
            assert ids == b"".join(piece_dropout.encode_by_agenda(v, c, 0.3, key).tobytes() for c, key in zip(chunks, keys))
        seen |= {got[0], encoder.encode(samples[:1], [1])[0]}
    assert len(seen) == 4
    everything = piece_dropout.OccurrenceEncoder(MODEL, 1, 1.0).encode(["abc"], [0])[0]
    assert len(everything) // 4 == 4  # nothing merges: the blank and three letters


def test_each_occurrence_has_draws_of_its_own():
    v, samples = piece_dropout.pieces(MODEL), [text(150, 2), *ODD, "internationalisation " * 60]
    for rate in (0.0, 0.3, 1.0):
        big, small = (piece_dropout.OccurrenceEncoder(MODEL, 1, rate, max_chunks=n) for n in (10**6, 5))
        got = big.encode(samples, range(len(samples)))
        assert got == [small.encode([t], [k])[0] for k, t in enumerate(samples)]
        for k, (t, ids) in enumerate(zip(samples, got)):
            chunks = piece_dropout._chunks(t)
            keys = piece_dropout.occurrence_keys(k, t, len(chunks), 1).tolist()
            assert ids == b"".join(piece_dropout.encode_by_agenda(v, c, rate, key).tobytes() for c, key in zip(chunks, keys))
            assert big.decode(ids) == t


def test_copies_and_repeated_words_are_cut_in_many_ways(spark):
    docs = spark.createDataFrame([(k, "internationalisation of the dictionary " * 5) for k in range(20)], "doc_id long, text string")
    rows = piece_dropout.encode_decode(docs, MODEL, with_ids=True).collect()
    assert len({r["ids_crc32"] for r in rows}) > 15 and all(r["lossless"] for r in rows)
    again = {r["doc_id"]: r["ids"] for r in piece_dropout.encode_decode(docs.repartition(7), MODEL, with_ids=True).collect()}
    assert again == {r["doc_id"]: r["ids"] for r in rows}


def test_cache_bound_keeps_results():
    a, b = (piece_dropout.OccurrenceEncoder(MODEL, 1, 0.1, max_chunks=n) for n in (10, 10**6))
    assert [a.encode([text(50, k)], [0]) for k in range(5)] == [b.encode([text(50, k)], [0]) for k in range(5)]


def test_cached_encoder_equals_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    for limit in (5, 10**6):
        encoder = CachedEncoder(path, limit)
        for t in [text(100, 3), *ODD, "a<|endoftext|> b", "   x", "x \n y", "it's 5 o'clock\r\n\r\n  z"]:
            assert np.frombuffer(encoder.encode([t])[0], "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_cached_encoder_keeps_white_space_before_letters():
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    own, draw = Tokenizer.from_file(path), random.Random(8)
    fixed = ["a\n\nb", "x.\n\nY", "word\n\nNext", "First paragraph ends here.\n\nSecond paragraph starts.", "\nb", "\n\nb", "a \nb", "a\t\nb", "a\r\n\r\nb"]
    mixed = ["".join(draw.choices(["\n", "\t", "\r", " ", "\u00a0", "\x1c", "a", "Bc", "é", "7", ".", "'s", "漢"], k=draw.randrange(1, 14))) for _ in range(5000)]
    encoder = CachedEncoder(path)
    for t, got in zip(fixed + mixed, encoder.encode(fixed + mixed)):
        assert np.frombuffer(got, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, t


def test_frames(tmp_path):
    frames = [np.arange(k, dtype="<u4").tobytes() for k in (3, 0, 1000)]
    out = io.BytesIO()
    w = token_files.FrameWriter(out)
    for i, f in zip((None, 0, 20), frames):
        w.add(i, f)
    w.close()
    raw = out.getvalue()
    # Any decoder reads the whole; skippable frames are passed over.
    assert zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(raw) == b"".join(frames)
    reader = token_files.FrameReader(pa.BufferReader(raw))
    assert reader.ids.tolist() == [0, 0, 20] and reader.has_id.tolist() == [False, True, True] and [reader.frame(k) for k in range(3)] == frames
    spoilt = bytearray(raw)
    spoilt[len(raw) - 9 - 12 * 3 + 8] ^= 1  # the first frame's checksum
    with pytest.raises(token_files.Corrupt):
        token_files.FrameReader(pa.BufferReader(bytes(spoilt))).frame(0)
    with pytest.raises(token_files.Corrupt):
        token_files.FrameReader(pa.BufferReader(raw[:-1]))


def test_reading_some_documents(spark, tmp_path):
    docs = spark.createDataFrame([(k, text(5, k)) for k in range(30)], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    manifest = token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"), 2)
    every = {r["doc_id"]: r for r in token_files.read_token_files(manifest, path, with_ids=True).collect()}
    some = token_files.read_token_files(manifest, path, doc_ids=[3, 17, 99], with_ids=True).collect()
    assert sorted(r["doc_id"] for r in some) == [3, 17] and all(r == every[r["doc_id"]] for r in some)
    assert all(r["ids"][-1] == 2 and len(r["ids"]) == r["n_tokens"] for r in every.values())


def test_cache_encodes_only_misses(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(1, "Hello world"), (2, "Hello \n world"), (3, "other")], "doc_id long, text string")
    counts = {r["doc_id"]: r["n_tokens"] for r in count_tokens(first, cache, path).collect()}
    assert counts == {1: 2, 2: 2, 3: 1}
    assert spark.read.parquet(cache).count() == 2  # equal but for white space: one digest
    again = spark.createDataFrame([(1, "other"), (2, "new text here")], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(again, cache, path).collect()} == {1: 1, 2: 3}
    assert read_cache(first, cache, version_digest(path)).count() == 3
    assert read_cache(first, cache, "another version").count() == 0


def test_counts_keep_white_space_where_the_tokenizer_does(spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, texts = Tokenizer.from_file(path), ["a b", "a  b", "a\n\n b", "a b"]
    rows = count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), f"file://{tmp_path}/cache", path).collect()
    assert {r["doc_id"]: r["n_tokens"] for r in rows} == {k: len(own.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
