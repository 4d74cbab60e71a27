"""Each operator against a plain version, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import io
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadlake.llm import chat, exact_dedup, langid, minhash, mixing, packing, planes, quality, secret_scan, sharding, tokens

DDL = "doc_id long, text string, lang string, source string, n_chars long, name string, row long, key string"
LONG = " ".join(f"w{i % 977}" for i in range(9000))
TEXTS = [None, "", " ", "a", "A b c", "A  b\nc", "same text here", "same text here", "same\ttext here ", LONG, LONG + " end", "日本 語", "x" * 40000]


def frame(spark, texts, **columns):
    rows = [(i, t, "en", None if i % 5 == 4 else f"s{i % 3}", 1, "clash", 7, "clash") for i, t in enumerate(texts)]
    rows += rows[-1:]  # a row repeated in full
    return spark.createDataFrame(rows, DDL).repartition(3)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, TEXTS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DDL)


def plain(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3000, "hash_bits": 2}])
def test_exact_dedup(docs, options):
    rows = exact_dedup.exact_dedup(docs, **options).collect()
    groups = defaultdict(list)
    for r in docs.collect():
        groups[plain(r.text)].append((-len(r.text or ""), r.doc_id))
    assert len(rows) == docs.count() and sum(r.kept for r in rows) == len(groups)
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in rows:
        g = groups[plain(text[r.doc_id])]
        assert (r.keep_id, r.group_size) == (min(g)[1], len(g))
    assert exact_dedup.drop_exact_copies(docs).columns == docs.columns


def test_exact_dedup_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0


@pytest.fixture(scope="module")
def library():
    """Ids by a tokenizer of its own, as it comes."""
    from tokenizers import Tokenizer

    fresh = Tokenizer.from_file(tokens.default_tokenizer())
    return lambda t: np.array(fresh.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_encoder_equals_the_library(library):
    tool = tokens.Encoder(tokens.default_tokenizer(), most=500)
    rng = random.Random(3)
    letters = list("ab Z9'.,!\n\t  é×÷$|s\x1c\x85") + ["'s ", "'ll", "\n\n", "<|endoftext|>", "\u00a0", "\u3000", "\u2028", "\u200b", "\ufeff", "\u180e", "😀", "“", "日本", "\r\n", "ab" * 50]
    for _ in range(3000):
        some = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3)]
        assert tool.encode(some) == [library(s) for s in some]
    text = " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(3000)).replace("<|endoftext|>", "")
    assert next(iter(tokens.encoded([text], tokens.default_tokenizer(), chars=500))) == library(text)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_plane_files_round_trip(kind):
    rng = np.random.default_rng(1)
    docs = [(i, rng.integers(0, 50257, n).astype("<u4").tobytes()) for i, n in enumerate((0, 1, 7, 500, 3))] + [(None, b"")]

    class Sized(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    out = Sized()
    w = planes.PlaneWriter(out, kind, block=64)
    for d in docs:
        w.add(*d)
    w.close()
    assert list(planes.read_documents(out)) == docs
    index = planes.read_index(out)
    whole = b"".join(x for _, x in docs)
    assert b"".join(planes.read_block(out, index, k) for k in reversed(range(len(index["blocks"]))))[-256:] == whole[:256]


def test_token_files(docs, none, library):
    rows = planes.read_token_files(planes.write_token_files(docs, block=1000)).collect()
    at = 0
    expected = Counter()
    for d, t in sorted((r.doc_id, r.text or "") for r in docs.collect()):
        ids = library(t) + (2).to_bytes(4, "little")
        expected[(d, at, len(ids) // 4, zlib.crc32(ids))] += 1
        at += len(ids) // 4
    assert Counter((r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in rows) == expected
    assert planes.read_token_files(planes.write_token_files(none)).count() == 0


def test_plan_packs_every_piece_once():
    rng = random.Random(5)
    for _ in range(30):
        cap = rng.choice([10, 50, 200])
        counts = {x: rng.randint(1, 40) for x in rng.sample(range(1, cap + 1), rng.randint(1, cap // 2))}
        bins = packing.plan(counts, cap)
        used = Counter()
        for items, times in bins:
            assert times > 0 and sum(items) <= cap
            for x in items:
                used[x] += times
        assert used == Counter(counts)
        total = sum(x * n for x, n in counts.items())
        # pieces above half a bin need one each
        least = max(-(-total // cap), sum(n for x, n in counts.items() if 2 * x > cap))
        assert sum(t for _, t in bins) <= 1.3 * least + 1


def test_two_pieces_for_the_smallest():
    # greedy puts 6 and 3 in a bin of 10; 6 and the pair 2, 2 fill it
    assert sorted(packing.plan({6: 1, 3: 1, 2: 2}, 10)[0][0], reverse=True) == [6, 2, 2]


def test_plan_is_best_two_fit():
    """Bin by bin against a plain version that tries all pairs."""
    rng = random.Random(8)
    replaced = 0
    for _ in range(100):
        cap = rng.choice([10, 40, 100])
        left = Counter({x: rng.randint(1, 6) for x in rng.sample(range(1, cap + 1), rng.randint(1, min(cap, 14)))})
        for items, times in packing.plan(dict(left), cap):
            for _ in range(times):
                greedy, gap = [], cap
                for x in sorted(left.elements(), reverse=True):
                    if x <= gap:
                        greedy.append(x)
                        gap -= x
                small, free = greedy[-1], sorted((left - Counter(greedy)).elements())
                sums = {a + b for a, b in itertools.combinations(free, 2) if small < a + b <= gap + small} if len(greedy) > 1 else set()
                if sums:
                    kept = Counter(greedy[:-1])
                    assert not kept - Counter(items)
                    pair = list((Counter(items) - kept).elements())
                    assert len(pair) == 2 and sum(pair) == max(sums)
                    replaced += 1
                else:
                    assert sorted(items) == sorted(greedy)
                left -= Counter(items)
        assert not left
    assert replaced > 20


def test_packing(docs, none, library):
    rows = packing.packed_documents(docs, 512).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[(r.doc_id, r.row)].append(r)
    assert len(pieces) == docs.count()
    text = {r.doc_id: r.text for r in docs.collect()}
    for (d, _), found in pieces.items():
        ids = library(text[d] or "") + bytes(4)
        at = 0
        for k, r in enumerate(sorted(found, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at) and (r.length == 512 or k == 0)
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert at == len(ids) // 4
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 512
    assert packing.packed_documents(none).count() == 0


def test_perspectives(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (1, 3, "ann", "bye"), (2, 0, None, "x"), (3, 0, "system", "alone"), (None, 1, "ann", "lost"), (4, None, "eve", "2"), (4, None, "eve", "1" * 3000), (4, None, "eve", "1")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, perspective string")
    out = defaultdict(list)
    for r in chat.perspectives(df).collect():
        out[(r.conv_id, r.perspective)].append(r)
    assert set(out) == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann"), (4, "eve")}
    for found in out.values():
        found.sort(key=lambda r: r.start)
        text = "".join(r.segment for r in found)
        assert all(text[r.start : r.start + r.length] == r.segment for r in found)
    assert [len(r.segment) - len(chat.START + "assistant\n" + chat.END) for r in out[(4, "eve")]] == [1, 3000, 1]
    ann = out[(1, "ann")]
    text = "".join(r.segment for r in ann)
    assert [text[r.mask_start : r.mask_end] for r in ann if r.mask] == ["hi<|im_end|>", "bye<|im_end|>", "bye<|im_end|>"]
    assert "<|im_start|>user name=bob\n<|im_end|>\n" in text
    assert chat.perspectives(df.limit(0)).count() == 0


def test_sharding(spark, none):
    rng = random.Random(2)
    texts = [None, "", *("hot" for _ in range(150)), *(f"g{rng.randint(0, 60)}" for _ in range(200)), *(f"single {i}" for i in range(137))]
    df = frame(spark, texts)
    rows = sharding.balanced_shards(df, shards=5).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == df.count() and max(n.values()) - min(n.values()) <= 1 and set(n) == set(range(5))
    for s in n:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(n[s]))
    text = {r.doc_id: r.text for r in df.collect()}
    at = defaultdict(Counter)
    for r in rows:
        at[text[r.doc_id]][r.shard] += 1
        assert r.size == 8 + len((text[r.doc_id] or "").encode()) and r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode())
    links = sum(sum(c.values()) ** 2 for t, c in at.items() if t is not None)
    kept = sum(x * x for t, c in at.items() if t is not None for x in c.values())
    assert kept / links > 0.4  # the hot group alone is larger than a shard
    small = [c for t, c in at.items() if t and t.startswith("g") and sum(c.values()) > 1]
    assert sum(len(c) == 1 for c in small) >= 0.8 * len(small)
    assert sharding.balanced_shards(none).count() == 0


def inside(spark, texts, shards):
    """Share of the links that lie inside a shard, and each text's counts by shard."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = sharding.balanced_shards(df, shards=shards).collect()
    n = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(n.values()) - min(n.values()) <= 1
    at = defaultdict(Counter)
    for r in rows:
        at[texts[r.doc_id]][r.shard] += 1
    return sum(x * (x - 1) for c in at.values() for x in c.values()) / sum(c.total() * (c.total() - 1) for c in at.values()), at


def test_sharding_where_every_row_has_a_copy(spark):
    assert inside(spark, [f"g{i // 5}" for i in range(3000)], 6)[0] > 0.9


def test_sharding_of_a_group_larger_than_shards(spark):
    texts = ["hot" if i % 3 == 0 else f"g{i // 15}" if i % 3 == 1 else f"single {i}" for i in range(3600)]
    found = sorted(inside(spark, texts, 12)[1]["hot"].values())
    assert found == [300] * 4


def test_grants_keep_the_quotas():
    rng = random.Random(14)
    assert sharding._grants([[0, 3, 0], [0, 0, 4], [5, 0, 0]], [0, 0, 0]) == [[0, 3, 0], [0, 0, 3], [3, 0, 0]]
    assert sharding._grants([[0, 3, 0], [0, 0, 4], [0, 0, 0]], [0, 0, 2]) == [[0, 2, 0], [0, 0, 2], [0, 0, 0]]
    for _ in range(50):
        asked = [[rng.choice([0, 0, rng.randint(1, 9)]) * (s != t) for t in range(7)] for s in range(7)]
        room = [rng.choice([0, 0, rng.randint(1, 9)]) for _ in range(7)]
        got = sharding._grants(asked, room)
        assert all(0 <= got[s][t] <= asked[s][t] for s in range(7) for t in range(7))
        assert all(sum(r[t] for r in got) - sum(got[t]) <= room[t] for t in range(7))


def brute_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_near_duplicates(spark, none):
    rng = random.Random(4)
    base = [[f"t{rng.randint(0, 4000)}" for _ in range(n)] for n in (60, 200, 200, 900)]
    texts = [None, "", "one two", "one  two", "one two three"]
    for w in base:
        texts.append(" ".join(w))
        for edits in (1, 2, 3, 10):
            v = list(w)
            for _ in range(edits):
                v[rng.randrange(len(v))] = "edit"
            texts.append(" ".join(v))
    df = frame(spark, texts)
    rows = minhash.near_duplicates(df).collect()
    got = {r.doc_id: r.class_id for r in rows}
    sets = {i: brute_shingles(t) for i, t in enumerate(texts)}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sets, 2):
        if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = label[a], label[b]
            label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    assert got == label
    assert sum(r.kept for r in rows) == len(set(label.values()))
    assert minhash.drop_near_copies(df).count() == len(set(label.values()))
    assert minhash.near_duplicates(none).count() == 0


def test_near_duplicates_of_a_hub(spark):
    # every copy is similar to the original, no two copies to each other
    rng = random.Random(11)
    words = [f"t{i}" for i in range(200)]
    texts = [" ".join(words)]
    for c in range(3000):
        v = list(words)
        for k in rng.sample(range(1, 39), 4):
            v[5 * k] = f"edit{c}"
        texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sizes = Counter(r.class_id for r in minhash.near_duplicates(df).select("class_id").collect())
    assert sizes == {0: 3001}


def test_near_duplicates_that_repeat_passages(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(20):
        w = [f"t{rng.randint(0, 9999)}" for _ in range(300)]
        texts += [" ".join(w * times) for times in (1, 3, 6, 10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()} == {i: i - i % 4 for i in range(80)}


def test_near_duplicates_on_a_template(spark):
    # pairs of similarity 0.85, all others about 0.74: they share bands, far more than one part of a bucket holds
    rng = random.Random(15)
    base, texts = [f"t{i}" for i in range(500)], []
    for p in range(350):
        slots = rng.sample(range(100), 8)
        for c in range(2):
            v = list(base)
            for k, slot in enumerate(slots):
                v[5 * slot] = f"p{p}" if k < 5 else f"p{p}c{c}"
            texts.append(" ".join(v))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(df).collect()}
    sets = [brute_shingles(t) for t in texts]
    label = list(range(len(texts)))
    root = lambda x: x if label[x] == x else root(label[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    assert got == {i: root(i) for i in range(len(texts))}


def test_linked_members_are_those_of_brute_force():
    rng = np.random.default_rng(4)
    sets = [rng.choice(60, rng.integers(20, 50), replace=False).astype(np.int64) for _ in range(80)]
    sets += [np.append(s[1:], 100 + k) for k, s in enumerate(sets)]
    node, label = np.arange(160), np.arange(160) % 130
    for one_part in (True, False):
        side = np.zeros(160, dtype=bool) if one_part else node >= 80
        a, b = minhash._linked_members(node, side, label, sets, one_part, 0.8)
        of = {i: i for i in range(160)}

        def join(x, y):
            for k, v in of.items():
                if v == max(of_x, of_y):
                    of[k] = min(of_x, of_y)

        for x, y in itertools.combinations(range(160), 2):
            common = len(set(sets[x]) & set(sets[y]))
            if label[x] != label[y] and (one_part or side[x] != side[y]) and common >= 0.8 * (len(sets[x]) + len(sets[y]) - common):
                of_x, of_y = of[x], of[y]
                join(x, y)
        got = {i: i for i in range(160)}
        for x, y in zip(a.tolist(), b.tolist()):
            low, high = sorted((got[x], got[y]))
            got = {k: low if v == high else v for k, v in got.items()}
        assert got == of and len(set(of.values())) < 120


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    e = rng.integers(0, 2**63, 400).astype(np.uint64)
    wa, wb = rng.integers(1, 9, 400).astype(float), rng.integers(1, 9, 400).astype(float)
    sig = minhash.dart_signatures(np.concatenate([e, e]), np.concatenate([wa, wb]), np.repeat([0, 1], 400), 2, 2000)
    exact = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 256):
        rows = spark.range(n).select(mixing.permuted(F.lit("k"), F.col("id"), F.lit(n).cast("long")).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_mixing(spark, none):
    rng = random.Random(6)
    texts = [None, "", *(" ".join("w" for _ in range(rng.randint(0, 700))) for _ in range(300))]
    df = frame(spark, texts)
    rows = mixing.mix(df).collect()
    size = {i: len((t or "").split()) for i, t in enumerate(texts)}
    source = {r.doc_id: r.source for r in df.collect()}
    total = defaultdict(int)
    for r in df.collect():
        total[r.source] += size[r.doc_id]
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, rest = {}, set(order), 1.5 * sum(total.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * total[s]}
        for s in full or open_:
            target[s] = 2 * total[s] if full else share[s]
        rest -= sum(target[s] for s in full)
        open_ -= full or open_
    taken = defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        assert r.size == size[r.doc_id] and r.source_size == total[s] and abs(r.target - target[s]) < 1e-6 * target[s] + 1e-9
        assert r.taken <= 2 * r.size
        taken[s] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(2, 0.025 * target[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(df).collect()))
    assert mixing.mix(none).count() == 0
    assert mixing.mixed_documents(df).columns == df.columns


def test_mix_of_small_sources(spark):
    rows = [(1, " ".join("a" * 60), "small"), (2, " ".join("b" * 9), "tiny"), (3, None, "none"), (4, " ".join("c" * 5000), "large"), (5, " ".join("d" * 100), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for r in mixing.mix(df, weights=(1,), total_share=1.17).collect():
        assert abs(r.taken - r.target) <= max(2, 0.02 * r.target)


def test_shards_draw_their_counts(spark):
    rows = [(k, n, float(t), w) for k, (n, t, w) in enumerate(((300, 400, 1), (500, 200, 1), (7, 14, 1), (0, 0, 1)))]
    amounts = mixing.block_amounts(spark.createDataFrame([(k, n * 256, t * 256, w) for k, n, t, w in rows], "source_index int, source_size long, target double, weight int"))
    found = mixing.draws(amounts, shard_blocks=50).collect()
    want = {r.source_index: (r.slots, r.blocks) for r in amounts.collect()}
    assert len({(r.shard, r.position) for r in found}) == len(found) == sum(s for s, _ in want.values())
    for k, (slots, blocks) in want.items():
        own = [r for r in found if r.source_index == k]
        assert sorted(r.slot for r in own) == list(range(slots)) and max(Counter(r.block for r in own).values(), default=0) <= -(-slots // max(1, blocks))
    shards = [Counter(r.source_index for r in found if r.shard == s)[0] for s in range(len(found) // 50)]
    assert 2 < np.std(shards) < 6  # a multinomial draw of 50: 3.3


def test_mixed_documents_meet_the_targets_of_long_texts(spark):
    text = " ".join(["w"] * 3000)
    rows = [(i, text, f"s{min(i % 8, 2)}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = {r.source_size: r.target for r in mixing.mix(df).collect()}
    got = Counter(r.source for r in mixing.mixed_documents(df).select("source").collect())
    size = Counter(r[2] for r in rows)
    for s in size:
        assert abs(3000 * got[s] / target[3000 * size[s]] - 1) < 0.1
    assert any(0.6 < t / n < 0.9 or 1.1 < t / n < 1.4 for n, t in target.items())


def test_quality(spark, docs, none):
    rng = random.Random(8)
    texts = [*TEXTS, "x y\nx y\nz\n\n\n", *(" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(60))]
    df = frame(spark, texts)
    for r in quality.quality_filter(df, sample_rows=20).collect():
        t = texts[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(hit))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
        assert r.kept == (r.failed_rule is None) and not (r.base_failed and r.kept)
    assert quality.quality_filter(none).count() == 0


def test_rules_are_ordered_by_rejection_per_cost(spark):
    sample = quality.base_counts(spark.createDataFrame([(1, "a b")] * 50, "doc_id long, text string")).persist()
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("always", F.lit(True))]
    assert [r.name for r, _, _ in quality.ordered_rules(sample, rules)] == ["always", "never"]


def test_language_id(spark):
    rng = random.Random(9)
    words = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 8))) for _ in range(200)] for k, a in {"aa": "abcdeit", "bb": "mnoprste", "cc": "äöüßxyze"}.items()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(40)), k) for i, k in enumerate(rng.choice(list(words)) for _ in range(400))]
    rows += [(1000, None, "aa"), (1001, "", "aa"), (1002, "12 34 !!", "bb"), (1003, " ".join(words["aa"][:30]), None)]
    df = spark.createDataFrame([(*r, "clash", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id: r for r in langid.language_predictions(df).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] < 1000 and langid.is_held_out(r[0])]
    assert held and all(got[r[0]].held_out for r in held)
    assert sum(got[i].lang_pred == k for i, _, k in held) >= 0.98 * len(held)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = langid.drop_unidentified(df)
    assert kept.columns == df.columns and kept.where("doc_id in (1000, 1001, 1002)").count() == 0
    assert kept.count() >= 0.95 * len(rows)
    assert langid.language_predictions(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language_predictions(df.where("lang IS NULL")).collect()} == {"und"}


@pytest.fixture(scope="module")
def language_model():
    rng = random.Random(4)
    text = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60))
    return langid.train([(text(a), a) for a in ("abcdeit", "mnoprste", "cäöüßxyze", "日本語 a") for _ in range(30)])


def test_language_id_needs_little_memory(language_model):
    """Two workers share 3000 MB with a heap of 1800."""
    import tracemalloc

    for texts in (["word, other " * 80] * 2000, ["word, other " * 160_000]):
        tracemalloc.start()
        labels = language_model.predict(texts)[0]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(labels) == len(texts) and peak < 50_000_000


def test_language_scores_do_not_depend_on_pieces(language_model, monkeypatch):
    texts = ["abc  de\n1it", "", None, "a", "日本 語 9", "\ud800 x", "  mno  ", "prste" * 50, "äöü ß. xyze", "no end mark"]
    alone = [language_model.predict([t]) for t in texts]
    for piece, block in ((1 << 17, 1 << 16), (1, 1), (7, 5), (64, 33)):
        monkeypatch.setattr(langid, "PIECE", piece)
        monkeypatch.setattr(langid, "BLOCK", block)
        for some in (texts, texts[::-1]):
            assert list(zip(*language_model.predict(some))) == [(x[0], y[0], z[0]) for x, y, z in (alone if some is texts else alone[::-1])]


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 40):
        code = langid.codewords(n)
        apart = min(int((a != b).sum()) for a, b in itertools.combinations(code, 2))
        assert apart >= (1 if n == 2 else 2)


def test_candidates_have_no_bounds():
    late = "a" * 300 + "7" + "b" * 30
    text = f"x {late} {'c' * 100}apikey=secretvalue {'d' * 50}"
    assert [text[a:z] for a, z in secret_scan.candidates(text)] == [late, "secretvalue"]


def test_every_label_is_learned(spark):
    words = [f"{chr(97 + k // 20)}{chr(97 + k % 20)}qx" for k in range(250)]
    rows = [(4 * i, " ".join([w, w[::-1], w] * 5), w) for i, w in enumerate(w for w in words for _ in range(12))]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x for _, x in langid.learning_sample(df)} == set(words)


def test_secret_scan(spark):
    forest = secret_scan.default_forest()
    fresh = secret_scan.labelled_findings(800, 77)
    scores = forest.scores(np.array([secret_scan.features(t, a, z) for t, a, z, _ in fresh]))
    assert ((scores >= 0.5) == np.array([y for *_, y in fresh])).mean() > 0.97
    key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8"
    rows = [(1, f'x token = "{key}" y'), (2, "card 4763047826333361 of"), (3, None), (4, ""), (5, "plain words only"), (6, f"commit {key}"), (1, f'x token = "{key}" y'), (7, "w " * 50000 + f'api_key="{key}"')]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, score string")
    found = secret_scan.scan(df, forest=forest).collect()
    text = dict(rows)
    assert Counter(r.doc_id for r in found if r.is_secret) == Counter({1: 2, 7: 1})
    assert all(text[r.doc_id][r.start : r.end] == key for r in found if r.is_secret)
    assert {r.doc_id for r in found} == {1, 2, 6, 7}
    assert secret_scan.scan(df.limit(0), forest=forest).count() == 0
