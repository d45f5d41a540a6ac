"""The ten operators against brute force, on a small table with odd rows."""

import collections
import hashlib
import inspect
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from heddle.llm import bpe, chat, components, lm, mixing, ngram_join, quality, queries, sharding, token_counts, topk, toxicity

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, n_tokens string, score string, rejected_by string, slot int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def prose(rnd, n, vocabulary=400):
    return " ".join(rnd.choice(["the", "of", "and", "in", "der", "die"]) if rnd.random() < 0.3 else f"w{rnd.randrange(vocabulary)}er" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    base = [prose(rnd, rnd.randint(60, 160), 5000) for _ in range(30)]
    texts = list(base)
    for t in base[:8]:  # copies and near copies, in chains
        words = t.split()
        for k in (1, 2, 4):
            near = list(words)
            for i in range(k):
                near[-1 - i] = f"x{i}"
            texts.append(" ".join(near))
        texts.append(t.upper())
    texts += [None, "", " \n ", "one", "two three", "one", "Ünïcode wörds 中文 <|endoftext|> don't", "!!! ### $$$ %%% &&& " * 30, "a b c\n" * 40, prose(rnd, 30_000, 300)]
    out = [(i, t, "en", ["s", "big", None, ""][0 if i % 3 else 1 + i % 3 + (i % 7 == 0)], None, 7, "x", "y", "z", 1) for i, t in enumerate(texts)]
    out += [out[3], out[3], (None, base[4], None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    got = token_counts.count_tokens(docs, path)
    assert got.columns.count("n_tokens") == 1
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t, *_ in rows), key=repr)
    assert sorted_rows(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count_tokens(empty, path).count() == 0
    assert token_counts.summary(got).first().documents == len(rows)


def test_bpe_round_trip(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = sorted(((r.doc_id, r.n_tokens, hashlib.sha256(r.ids).hexdigest(), r.decoded) for r in bpe.encode(docs, path, decoded=True).collect()), key=repr)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), library.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=repr)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_random_strings():
    encoder = bpe.Encoder(bpe.files.read(path := public_tokenizers.path("byte_bpe_50k.json")))
    library, rnd = Tokenizer.from_file(path), random.Random(5)
    pool = [chr(c) for c in range(1, 384)] + list("abcdefgh 'st  \n") * 8 + ["中", "😀", "́", "İ", " "]
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert list(np.frombuffer(ids, "<u4")) == library.encode(text, add_special_tokens=False).ids
        assert encoder.decode(ids) == text


def brute_classes(rows, n, num, den):
    sets = {}
    for i, t, *_ in rows:
        if i is None:
            continue
        w = WORD.findall(lower(t or ""))
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < n else zip(*(w[k:] for k in range(n)), strict=False))
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and den * (o := len(sets[a] & sets[b])) >= num * (len(sets[a]) + len(sets[b]) - o):
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {i: (len(s), top(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80)])
def test_ngram_join(docs, rows, n, num):
    want = brute_classes(rows, n, num, 100)
    got = ngram_join.join(docs, n, num, 100).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None


def test_ngram_join_near_copies_in_a_crowd(spark):
    """Many edited copies of one text, of which only some pairs link: the exact phase decides."""
    rnd = random.Random(9)
    base = [f"b{k}" for k in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rnd.choice([0, 1, 2, 4, 8, 16])):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(1 << 30)}"
        rows.append((i, " ".join(words)))
    want = brute_classes(rows, 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100).collect()}
    assert got == want


def near_pairs(count, seed):
    """Texts of 4 to 30 four-word shingles, and each with a word or two more, fewer or other."""
    rnd = random.Random(seed)
    for _ in range(count):
        a = [f"n{rnd.randrange(1 << 40)}" for _ in range(rnd.randint(7, 33))]
        b = list(a)
        for _ in range(rnd.choice([1, 1, 2])):
            b = rnd.choice([[*b, "x"], ["y", *b], b[1:], [*b[:-1], "z"]])
        yield " ".join(a), " ".join(b)


def test_ngram_prefixes_of_small_sets():
    """Whatever the order of buckets, both sets of a linked pair keep the first one they share."""
    shingler = ngram_join.Shingler(4)
    for a, b in near_pairs(4000, 21):
        h = [shingler(x) for x in (a, b)]
        o = len(np.intersect1d(*h))
        if 100 * o < 80 * (len(h[0]) + len(h[1]) - o):
            continue
        signed, spares = zip(*(ngram_join.signatures(x, 80, 100) for x in h), strict=True)
        met = []
        for k in (0, 1):
            own = [{int(x) for x in s if int(x) & 1 == k} for s in signed]
            both = own[0] & own[1]
            met.append(bool(both) and all(len(x - both) < len(x) + s[k] for x, s in zip(own, spares, strict=True)))
        assert any(met), (a, b)


def test_ngram_join_small_near_pairs(spark):
    """A set that signs its empty fragments and one that doesn't, alone; then many near pairs, and a large family of them."""
    shingler = ngram_join.Shingler(4)
    fragment = lambda text: {int(x) * 3 >> 64 for x in shingler(text)}
    alone = [f"n{next(i for i in itertools.count() if len(fragment(t := ' '.join(f'n{i}{c}' for c in 'abcdefg'))) == 1 and len(fragment(t + ' x')) == 2)}{c}" for c in "abcdefg"]
    alone = [" ".join(alone), " ".join([*alone, "x"])]
    crowd = [t for pair in near_pairs(150, 22) for t in pair]
    rnd = random.Random(23)
    base = [f"f{k}" for k in range(13)]
    for _ in range(200):
        words = base[: rnd.randint(9, 13)]
        words[rnd.choice([0, -1])] = f"e{rnd.randrange(60)}"
        crowd.append(" ".join(words))
    for texts in (alone, crowd):
        rows = list(enumerate(texts))
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80, 100).collect()}
        assert got == brute_classes(rows, 4, 80, 100)


def edited_pairs(seed):
    """Texts of 1 to 80 four-word shingles, each beside an edit of one word at either end, inside, or one word more or less."""
    rnd = random.Random(seed)
    for size in range(1, 81):
        for _ in range(4):
            a = [f"q{rnd.randrange(1 << 40)}" for _ in range(size + 3)]
            at = rnd.randrange(len(a))
            yield from ((" ".join(a), " ".join(b)) for b in (a[:-1], a[1:], ["y", *a], [*a, "x"], ["z", *a[1:]], [*a[:-1], "z"], [*a[:at], "m", *a[at + 1 :]]))


def test_ngram_join_one_word_edits(spark):
    """Isolated pairs of all small sizes, and one that the bucket order once parted."""
    parted = "w158770 w826038 w7216 w611342 w464342 w373018 w424648 w551170 w820727 w26776 w986521"
    texts = [parted, parted.rsplit(" ", 1)[0], *(t for pair in edited_pairs(31) for t in pair)]
    pairs, shingler = list(zip(texts[::2], texts[1::2], strict=True)), ngram_join.Shingler(4)
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.join(frame, 4, 85, 100).collect()}
    for k, (a, b) in enumerate(pairs):
        x, y = shingler(a), shingler(b)
        o = len(np.intersect1d(x, y))
        if 100 * o >= 85 * (len(x) + len(y) - o):
            assert got[2 * k] == got[2 * k + 1], (a, b)
    assert got[0] == got[1] == 0


@pytest.mark.parametrize("sizes", [{}, {"most": 16, "cluster": 4}])
def test_ngram_cells_of_any_size(spark, sizes):
    """Sets of one bucket meet in cells: the bounds of cells and clusters change the work, not the links."""
    rnd = random.Random(37)
    base = [f"b{k}" for k in range(60)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rnd.choice([1, 2, 3])):
            words[rnd.randrange(len(words))] = f"e{rnd.randrange(1 << 30)}"
        rows.append((i, " ".join(words)))
    docs, whole = spark.createDataFrame(rows, "doc_id long, text string"), ngram_join.rest_of_buckets
    try:
        ngram_join.rest_of_buckets = lambda *a: whole(*a, **sizes)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(docs, 4, 85, 100).collect()}
    finally:
        ngram_join.rest_of_buckets = whole
    assert got == brute_classes(rows, 4, 85, 100)


def test_keep_one_judges_texts_of_a_doc_id_apart(spark):
    words = [f"k{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (2, "quite another text of its own"), (3, "quite another text of its own"), (3, "a third text of its own"), (4, None), (4, None), (3, "a third text of its own")]
    kept = ngram_join.keep_one(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, _key int, component_id int"))
    assert kept.columns == ["doc_id", "text", "_key", "component_id"]
    assert sorted_rows(kept, "doc_id", "text") == sorted([rows[0], rows[2], rows[4], rows[5], rows[6]], key=repr)


def test_ngram_join_empty_and_keep_one(docs, rows, empty):
    assert ngram_join.join(empty).count() == 0
    kept = ngram_join.keep_one(docs)
    want = brute_classes(rows, 5, 80, 100)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})
    assert ids.count(None) == 2


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for e in edges if e[0] != e[1] for x in e}


def test_mixing(docs, rows, empty):
    got = mixing.taken(docs).collect()
    sizes = sorted(len(WORD.findall(t or "")) for _, t, *_ in rows)
    assert sorted(r["size"] for r in got) == sizes
    total, by = sum(sizes), collections.defaultdict(lambda: [0, 0, 0.0])
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        by[r.source][0] += r.taken
        by[r.source][1] = r.source_size
        by[r.source][2] = r.target
    for took, size, target in by.values():
        assert abs(took - target) <= 1 and target <= 3 * size + 1e-9
    assert abs(sum(x[2] for x in by.values()) - total) < 1e-6
    assert sorted_rows(mixing.taken(docs.repartition(7)), "doc_id", "taken") == sorted_rows(mixing.taken(docs), "doc_id", "taken")
    assert mixing.taken(empty).count() == 0
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    clash = docs.select("doc_id", "text", "source").selectExpr("*", "1 as _key", "2 as _copies", "3 as _slot")
    assert mixing.apply_mix(clash).columns == clash.columns and mixing.apply_mix(clash).count() == mixed.count() and mixing.apply_mix(empty).count() == 0


def test_mixing_slots(spark):
    """Slots follow the schedule, and the mix is laid out in their order: any prefix of it is near the weights."""
    rnd = random.Random(14)
    rows = [(i, prose(rnd, rnd.randint(20, 60)), "abc"[min(2, i % 5)]) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.taken(docs, block_words=64).collect()
    for r in got:
        assert (r.first_slot is None) == (r.taken == 0) and (r.first_slot is None or r.first_slot == min(x for x in r.slots if x is not None))
    mixed = mixing.apply_mix(docs, block_words=64).collect()
    share = {r.source: r.target for r in got}
    whole = sum(share.values())
    for end in (len(mixed) // 4, len(mixed) // 2, len(mixed)):
        words = collections.Counter()
        for r in mixed[:end]:
            words[r.source] += len(r.text.split())
        for name, target in share.items():
            assert abs(words[name] / sum(words.values()) - target / whole) < 0.06


def test_mixing_schedule_is_even(spark):
    aims = spark.createDataFrame([("a", 6000.0), ("b", 3000.0), ("c", 1000.0)], "source_key string, target double")
    slots = sorted((r.slot, r.source_key, r["rank"]) for r in mixing.schedule(aims, 10).collect())
    assert collections.Counter(s for _, s, _ in slots) == {"a": 600, "b": 300, "c": 100}
    for name, share in (("a", 0.6), ("b", 0.3), ("c", 0.1)):
        ranks = [r for _, s, r in slots if s == name]
        assert ranks == list(range(len(ranks)))
        for end in (100, 333, 700):
            assert abs(sum(s == name for _, s, _ in slots[:end]) - share * end) <= 12


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("shards", [1, 8, 100])
def test_sharding(docs, rows, shards):
    got = sharding.shard(docs, shards).collect()
    assert len(got) == len(rows)
    slots = collections.defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == (jump(r.doc_id or 0, shards), jump(r.doc_id or 0, shards + 1))
        assert r.grown_shard in (r.shard, shards)
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r["size"], r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, *_ in rows)


def test_jump_hash_of_negative_and_large_keys(spark):
    from pyspark.sql import functions as F

    keys = [-1, -(1 << 63), (1 << 63) - 1, 0, 12345678901234]
    for n in (3, 1000):
        got = spark.createDataFrame([(k,) for k in keys], "k long").select("k", sharding.jump_hash(F.col("k"), n).alias("j")).collect()
        assert [r.j.shard for r in got] == [jump(k % (1 << 64), n) for k in keys]


def test_top_k(spark):
    rnd = np.random.default_rng(4)
    grid = rnd.normal(size=(400, 16)).astype(np.float32)
    grid[7] = grid[300]
    rows = [(i, v.tolist(), "x", 1) for i, v in enumerate(grid)]
    rows += [(500, None, "x", 1), (600, [1.0, None] + [0.0] * 14, "x", 1), (700, [math.nan] + [0.0] * 15, "x", 1), (800, [math.inf] + [0.0] * 15, "x", 1), (None, grid[0].tolist(), "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string, rank int")
    got = topk.top_k(df, block_rows=64, query_rows=2).collect()
    q = np.floor(1024 * grid.astype(float)).astype(np.int64)
    want = []
    for i in range(0, 400, 100):
        scores = sorted(((-int(q[i] @ q[j]), j) for j in range(400) if j != i))[:10]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 100")).count() == 0


def test_top_k_eliminates(spark):
    """On vectors in neighbourhoods, most candidates are never scored, and the answer is exact; also for repeats and short vectors."""
    rnd = np.random.default_rng(9)
    centres = rnd.normal(size=(40, 16)) * 4
    vectors = centres[rnd.integers(40, size=6000)] + rnd.normal(size=(6000, 16)) * 0.05
    rows = [(i, v.tolist()) for i, v in enumerate(vectors.astype(np.float32))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = topk.top_k(df, block_rows=200, query_rows=16, work=True).collect()
    q = np.floor(1024 * vectors.astype(np.float32).astype(float)).astype(np.int64)
    for i in range(0, 6000, 100):
        want = sorted(((-int(s), j) for j, s in enumerate(q @ q[i]) if j != i))[:10]
        assert [(r["rank"], r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == i), key=lambda r: r["rank"])] == [(n + 1, j, -s) for n, (s, j) in enumerate(want)]
    evaluated = {r.query_id: r.evaluated for r in got}
    assert sum(evaluated.values()) < 0.35 * 5999 * len(evaluated)
    odd = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0]), (1, [3.0]), (2, []), (3, [0.5, 0.5, 0.5])]
    odd = topk.top_k(spark.createDataFrame(odd, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in odd) == [(0, 1, 1, 3 * 1024 * 1024), (0, 2, 1, 3 * 1024 * 1024), (0, 3, 3, 3072 * 512), (0, 4, 2, 0)]


def test_toxicity(spark, docs, empty):
    rnd = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        words = prose(rnd, 80).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(["you idiot", "moron", "snarlish", "snarling"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    table, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.learn(table, marks)
    assert {"idiot", "moron"} <= set(grammar.words)
    got = {r.doc_id: r for r in toxicity.score(table, grammar).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert sum(got[i].predicted == y for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0) >= 0.97 * sum(zlib.crc32(str(i).encode()) % 5 == 0 for i, _ in labels)
    odd = toxicity.score(docs, grammar)
    assert odd.count() == docs.count() and odd.columns.count("score") == 1
    assert toxicity.score(empty, toxicity.learn(empty, marks)).count() == 0


def test_toxic_clauses():
    grammar = toxicity.Grammar({"idiot": 4.0}, {"snarl": 3.0}, 5, (0.0,) * 5)
    features = toxicity.Clauses(grammar).features
    plain, at_you, later, negated, quoted, claimed = map(features, ("what an idiot", "you are an idiot", "an idiot you are", "you are not an idiot", 'he said "you idiot"', "he said you are an idiot"))
    assert plain[0] > 0 and plain[1] == 0 and at_you[1] > 0 and later == at_you
    assert negated[0] == 0 and negated[2] > 0 and quoted[0] == claimed[0] == 0 and quoted[2] > 0
    assert features("i will kill you")[1] > 0 and features("kill the lights")[0] == 0
    assert features("snarling")[0] > 0 and features("snarl")[0] == 0
    assert features("not so very far away an idiot")[0] > 0 and features("") == (0.0,) * 4


def signs_by_rule(signs):
    """(asserted, aimed, excused) matches of a clause, by the rules as written out."""
    target, left, state, out = "T" in signs, 0, "none", [0, 0, 0]
    for s in signs:
        negated = left > 0
        left = 3 if s == "N" else max(0, left - (s != "Q"))
        excused = negated or state in ("quote", "claim")
        if s == "R" and state != "quote":
            state = "said"
        elif s == "Q":
            state = {"said": "quote", "claim": "quote", "quote": "said"}.get(state, state)
        elif s == "T" and state == "said":
            state = "claim"
        elif s == "I" or s == "H" and target:
            out[2] += excused
            out[0] += not excused
            out[1] += not excused and target
    return tuple(out)


def test_composed_transducer():
    """Every clause of up to five signs, against the rules without transducers."""
    clauses = toxicity.Clauses(toxicity.Grammar({}, {}, 5, (0.0,) * 5))
    for n in range(1, 6):
        for signs in itertools.product("IHTNRQ-", repeat=n):
            assert clauses.weights([(s, 1.0) for s in signs]) == signs_by_rule(signs), signs


def test_toxicity_held_out(spark):
    """Precision and recall on held-out rows of all languages."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, toxicity.learn(docs, labels), keep=["doc_id"]).join(labels, "doc_id").where(toxicity.held_out(labels.doc_id))
    rows = got.groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in rows}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n[1, 1] >= 0.95 * (n[1, 1] + n.get((0, 1), 0))


def test_toxicity_of_texts_that_harp_on_a_stem(spark):
    """Few labels: two toxic texts that harp on one stem teach it; clean texts that have it once stay clean."""
    filler = [" ".join(f"w{i}x{j}" for j in range(40)) for i in range(80)]
    toxic = ["zarkonian zarkonist zarkonly " + filler[k] for k in range(2)] + [f"you idiot {filler[k]}" for k in range(2, 8)]
    clean = [f"zarkonian {filler[k]}" for k in range(8, 11)] + filler[11:80]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(toxic + clean)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(80)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels, holding_out=False)
    assert "zarko" in grammar.bursts and "zarko" not in grammar.stems
    left = {r.doc_id for r in toxicity.clean(docs, grammar).collect()}
    assert left == set(range(8, 80))


def test_toxicity_without_labels(spark, docs):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels)
    assert grammar.layer == toxicity.UNTAUGHT and set(grammar.words) == set(toxicity.INSULTS)
    rows = spark.createDataFrame([(1, "you idiot, you stupid clown", 3)], "doc_id long, text string, predicted int")
    assert [r.predicted for r in toxicity.score(rows, grammar).collect()] == [1]


def turns_of(text):
    return "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in text)


def test_chat_formatting(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (2, 0, "user", "same"), (3, 0, "user", "same"), (4, 0, None, None), (None, 0, "user", "lost"), (7, 1, "assistant", "b"), (7, 0, "user", "a")]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, n_common int")
    got = {r.pair_id: r for r in chat.format_pairs(chat.pair_neighbours(df)).collect()}
    assert sorted(got) == [0, 1, 2, 3]
    first = got[0]
    assert (first.n_common, first.prompt, first.rejected) == (1, turns_of([("user", "hi")]), turns_of([("assistant", "no")]))
    whole = first.prompt + first.chosen
    spans = [tuple(map(int, s.split("-"))) for s in first.chosen_mask.split(";")]
    assert [whole[a:b] for a, b in spans] == ["yes<|end|>"]
    assert (got[1].n_common, got[1].chosen, got[1].rejected) == (1, "", "")
    assert (got[2].n_common, got[2].rejected, got[2].chosen) == (0, None, turns_of([("", "")]))
    assert got[3].chosen is None and got[3].rejected == turns_of([("user", "a"), ("assistant", "b")])
    assert chat.format_pairs(chat.pair_neighbours(df.limit(0))).count() == 0


def brute_quality(text):
    text = text or ""
    w = WORD.findall(text)
    tri = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_quality(docs, rows, empty):
    got = quality.report(docs)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert sorted_rows(got, "doc_id", *names) == sorted(((i, *brute_quality(t)) for i, t, *_ in rows), key=repr)
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    marked = quality.apply_rules(docs)
    assert marked.columns.count("rejected_by") == 1
    assert sorted_rows(marked.where("rejected_by is null"), "doc_id") == sorted_rows(got.where("kept"), "doc_id")
    for order in (["short", "repeats", "symbols", "duplicate_lines", "word_length"], ["word_length", "duplicate_lines", "symbols", "repeats", "short"]):
        assert quality.apply_rules(docs, order).where("rejected_by is null").count() == got.where("kept").count()
    assert quality.report(empty).count() == 0 and quality.apply_rules(empty).count() == 0


def test_cascade_order(spark):
    """The rule that rejects much for little work comes first, whatever the written order; rules that reject nothing come last."""
    texts = [" ".join(f"w{i}x{k}" for k in range(12)) for i in range(40)] + [" ".join(f"v{i}x{k}" for k in range(900)) for i in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    order = quality.plan_cascade(docs, ["repeats", "word_length", "short"])
    assert order[0] == "short" and set(order) == {"repeats", "word_length", "short"}
    assert quality.plan_cascade(docs.limit(0)) == list(quality.rules(quality.measures(docs.text, docs.text)))
    marked = docs.selectExpr("*", "'own' as rejected_by")
    assert quality.kept(marked).select("rejected_by").distinct().collect()[0].rejected_by == "own" and quality.kept(marked).count() == 10


def test_chat_of_long_conversations(spark):
    turns = [(c, t, "assistant" if t % 2 else "user", ("word " * 4000 if t == 7 else f"turn {t}") + ("!" if c == 1 and t >= 500 else "")) for c in (0, 1) for t in range(900)]
    row = chat.format_pairs(chat.pair_neighbours(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert (row.n_common, row.n_chosen, row.n_rejected) == (500, 900, 900) and row.prompt == turns_of([(r, t) for c, n, r, t in turns if c == 0 and n < 500])
    whole = row.prompt + row.rejected
    spans = [tuple(map(int, x.split("-"))) for x in row.rejected_mask.split(";")]
    assert [whole[a:b] for a, b in spans] == [f"turn {n}!<|end|>" for n in range(501, 900, 2)]


def test_language_model(spark, docs, rows, empty):
    got = lm.score(docs.select("doc_id", "text", "n_tokens"), kept_words=50).collect()
    assert len(got) == len(rows)
    words = [(i, WORD.findall(lower(t or "")) + [" "]) for i, t, *_ in rows]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = collections.Counter(w for i, ws in words if not held(i) for w in ws)
    total, size = sum(c.values()), len(c)
    want = sorted((repr(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (total + size + 1)) for w in ws), 4)) for i, ws in words)
    assert sorted((repr(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == total and r.score < 0 for r in got)
    far = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in far) > sum(r.base_score for r in far)
    assert lm.score(empty).count() == 0


def test_language_model_on_gibberish_and_prose(spark):
    """Texts of invented words score under all prose; held-out texts of known words only beat the unigram base."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rnd = random.Random(1)
    junk = [(10_000_000 + i, " ".join("".join(rnd.choice("abcdefghij") for _ in range(14)) for _ in range(150))) for i in range(12)]
    vocabulary = set().union(*(WORD.findall(lower(r.text or "")) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 != 2))
    known = {r.doc_id: [w for w in WORD.findall(lower(r.text or "")) if w in vocabulary] for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 2}
    first = next(n for n in itertools.count(20_000_000) if zlib.crc32(str(n).encode()) % 7 == 2)
    held = [n for n in range(first, first + 2000) if zlib.crc32(str(n).encode()) % 7 == 2]
    junk = [(held[-1 - i], t) for i, (_, t) in enumerate(junk)]
    prose = [(held[i], " ".join(w)) for i, (_, w) in enumerate(sorted(known.items())) if len(w) >= 20]
    got = {r.doc_id: r for r in lm.score(docs.unionByName(spark.createDataFrame(junk + prose, "doc_id long, text string"))).collect()}
    rate = lambda i: got[i].score / got[i].n_tokens
    assert all(got[i].n_known <= 1 for i, _ in junk) and all(got[i].n_known == got[i].n_tokens for i, _ in prose)
    assert max(rate(i) for i, _ in junk) < min(rate(i) for i, _ in prose)
    assert sum(got[i].score for i, _ in prose) > sum(got[i].base_score for i, _ in prose)


def test_frequent_words_are_named_by_share(spark):
    """Words of a share or more of all tokens, however the texts are dealt, and short stretches name no lasting words."""
    rnd = random.Random(2)
    texts = [" ".join(f"w{min(int(rnd.expovariate(0.08)), 200)}" for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    n = collections.Counter(w.encode() for t in texts for w in t.split()) + collections.Counter({lm.END: len(texts)})
    want = {w for w, k in n.items() if 50 * k >= n.total()} - {lm.END}
    for parts in (1, 60):
        found = lm.frequent_words(spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts), 50)
        assert set(found) - {lm.END} == want


def test_language_model_walks_texts_as_arrays():
    """Tokens, their contexts and the sizes of texts, against a loop over the words of each text."""
    texts = ["The cat\tthe\x0bCAT", "", " \n ", "é\x1cÉ a\u00a0b \ud800", "cat\r\ncat the "]
    contexts = lm.Contexts([b"the", b"cat"], 3)
    hashes, numbers, path, sizes = lm.walked(texts, contexts)
    own = {lm.word_hash(b"the"): 1, lm.word_hash(b"cat"): 2}
    want = [[*(lm.word_hash(w.encode("utf-8", "replace")) for w in WORD.findall(lower(t))), lm.word_hash(lm.END)] for t in texts]
    assert sizes.tolist() == [len(x) for x in want] and hashes[numbers].tolist() == [h for x in want for h in x]
    assert path.tolist() == [c for x in want for c in (0, *(own.get(h, 3 + h % 3) for h in x[:-1]))]
    assert lm.walked([""], contexts)[1].tolist() == [0] and not lm.Contexts([], 3).hashes.size


def test_language_model_packs_its_vocabulary(spark):
    """Sweeps read some hundred thousand (word, context) pairs as one row, each word whole in one of them."""
    pairs = spark.range(3_000_000).selectExpr("id % 1000 as word", "cast(id div 1000 % 7 as int) as context", "id % 3 + 1 as n")
    rows = lm.packed(pairs, 7).collect()
    parts = [lm.flattened(lm.loose(bytes(r._data))) for r in rows]
    got = {(int(w[o]), int(c)): int(n) for w, context, counts, owner in parts for o, c, n in zip(owner, context, counts, strict=True)}
    assert got == {(r.word, r.context): r.n for r in pairs.groupBy("word", "context").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert sum(len(p[1]) for p in parts) == len(got) and sum(r.words for r in rows) == 1000 and len(rows) <= 24
    totals, (words, ones, twos, _) = lm.sums(lm.packed(spark.createDataFrame([(5, 0, 1), (5, 1, 1), (5, 0, 1), (6, 1, 1)], "word long, context int, n long"), 3), 3)
    assert totals.tolist() == [2, 2, 0] and (words, ones, twos) == (2, 2, 1)


def test_strengths():
    """The fitted strength of seatings drawn with a known one."""
    rnd = np.random.default_rng(5)
    for strength, d in ((0.5, 0.3), (8.0, 0.3), (40.0, 0.6)):
        c = np.full(200, 400.0)
        t = np.ones(200)
        for s in range(1, 400):
            t += rnd.random(200) < (strength + d * t) / (s + strength)
        assert abs(math.log(lm.strength_of(c, t, d) / strength)) < 0.25
    assert abs(lm.digamma(1.0) + 0.5772156649) < 1e-8


def test_language_model_keeps_odd_ids_apart(spark):
    rows = [(None, "one two three four"), (-1, "one two three four"), (0, "one two three four"), (5, "one two three four")]
    got = lm.score(spark.createDataFrame(rows, "doc_id long, text string"), kept_words=0).collect()
    assert all(r.n_tokens == 5 and r.n_known in (0, 5) for r in got) and len(got) == 4
    assert len({(r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in got}) == 1


def test_language_model_is_the_same_in_any_layout(spark, docs):
    """What a word draws depends on the word alone, so tasks, file splits and the kept table don't matter."""
    base = docs.select("doc_id", "text")
    rows = [sorted(((repr(r.doc_id), r.n_tokens, r.n_known, round(r.score, 2)) for r in lm.score(x, kept_words=k).collect()), key=repr) for x, k in ((base, 50), (base.repartition(11), 5000))]
    assert rows[0] == rows[1]


def test_language_model_adds_up_to_one():
    model = lm.Model(3, (0.4, 0.5), (0.7, 1.3))
    customers = np.array([7.0, 2.0])
    word, owner = np.arange(3), np.array([0, 0, 1, 2])
    context, n = np.array([0, 1, 0, 1]), np.array([4, 1, 3, 1])
    model.history.append(lm.Totals(customers, customers * 0.5, 3.0))
    tables, above, parent = model.sweep(word, context, n, owner, None, 0)
    totals = lm.Totals(customers, np.bincount(context, tables, 2), float(parent.sum()))
    base = model.parent(above, parent, totals)
    for g in range(2):
        seats = [(n[(owner == w) & (context == g)].sum(), tables[(owner == w) & (context == g)].sum()) for w in range(3)]
        known = sum(model.predict(np.array([g]), s, t, base[w], totals)[0] for w, (s, t) in enumerate(seats))
        unknown = model.predict(np.array([g]), 0, 0, model.parent(0, 0, totals), totals)[0]
        assert abs(known + unknown - 1) < 1e-9


@pytest.mark.parametrize(("n", "a", "d", "vast"), [(50, 2.0, 0.5, 9999), (64, 5.0, 0.3, 9999), (65, 5.0, 0.3, 9999), (4000, 60.0, 0.6, 9999), (4000, 60.0, 0.6, 100)])
def test_seating_follows_the_restaurant(n, a, d, vast, monkeypatch):
    """Mean tables of small, large and vast groups against customers seated one by one."""
    monkeypatch.setattr(lm, "VAST", vast)
    monkeypatch.setattr(lm, "BLOCK", 1000)
    rnd = np.random.default_rng(8)
    t = np.ones(3000)
    for s in range(1, n):
        t += rnd.random(3000) < a / (s - d * t + a)
    keys = lm.mixed(np.arange(3000, dtype=np.uint64))
    fast = lm.open_tables(np.full(3000, n), np.full(3000, a), d, keys)
    assert abs(fast.mean() - t.mean()) < 4 * (t.std() + fast.std()) / math.sqrt(3000)
    assert abs(fast.std() - t.std()) < 0.1 * t.std() + 0.05
    assert (lm.open_tables(np.full(3000, n), np.full(3000, a), d, keys)[::-1] == lm.open_tables(np.full(3000, n), np.full(3000, a), d, keys[::-1])).all()


def chinese_restaurants(pairs, vocabulary, places, discounts, strengths, rounds):
    """Predictive probabilities by brute force: every customer stands up and sits down again, by word, context and table."""
    rnd, (d0, d1), (s0, s1) = random.Random(6), discounts, strengths
    seats, parent = collections.defaultdict(list), collections.defaultdict(list)  # customers at each table

    def above(w):
        ts, customers = parent[w], sum(sum(x) for x in parent.values())
        return (sum(ts) - d0 * len(ts) + (s0 + d0 * sum(map(len, parent.values()))) / (vocabulary + 1)) / (customers + s0)

    def sit(tables, d, new):
        odds = [c - d for c in tables] + [new]
        at = rnd.choices(range(len(odds)), odds)[0]
        if at < len(tables):
            tables[at] += 1
            return False
        tables.append(1)
        return True

    def leave(tables):
        at = rnd.choices(range(len(tables)), tables)[0]
        tables[at] -= 1
        if not tables[at]:
            tables.pop(at)
            return True
        return False

    mean = collections.Counter()
    for turn in range(rounds):
        for w, c in pairs:
            if turn and leave(seats[w, c]):
                leave(parent[w])
            opened = sum(len(x) for (_, k), x in seats.items() if k == c)
            if sit(seats[w, c], d1, (s1 + d1 * opened) * above(w)):
                sit(parent[w], d0, (s0 + d0 * sum(map(len, parent.values()))) / (vocabulary + 1))
        if turn >= rounds // 3:
            for w in range(vocabulary):
                for c in range(places):
                    x, opened, customers = seats[w, c], sum(len(x) for (_, k), x in seats.items() if k == c), sum(k == c for _, k in pairs)
                    mean[w, c] += (sum(x) - d1 * len(x) + (s1 + d1 * opened) * above(w)) / (customers + s1) / (rounds - rounds // 3)
    return mean


def test_sweeps_against_brute_force(spark):
    """The parallel sweeps on a tiny corpus give the probabilities of a sampler that reseats one customer at a time."""
    rnd = random.Random(12)
    pairs = [(min(int(rnd.expovariate(0.5)), 5), rnd.randrange(3)) for _ in range(120)]
    c = collections.Counter(pairs)
    rows = [(w, [(k, c[w, k]) for k in range(3) if c[w, k]], sum(c[w, k] for k in range(3))) for w in sorted({w for w, _ in pairs})]
    model, table = lm.fit(spark.createDataFrame(rows, "word long, seats array<struct<context:int,n:long>>, n long"), 3, 4, 12)
    want = chinese_restaurants(pairs, len(rows), 3, model.discounts, model.strengths, 240)
    factors = lm.back_off(model, 3, 12)
    worst = 0
    for r in table.collect():
        p = factors @ np.array(r.above)
        for k, v in zip(r.context, r.seen, strict=True):
            p[k] += v
        worst = max(worst, *(abs(math.log10(p[k] / want[r.word, k])) for k in range(3) if c[r.word, k]))
    assert worst < 0.06


def test_sweeps_before_samples():
    assert all(inspect.signature(f).parameters["burn_in"].default >= 2 for f in (lm.fit, lm.score))


def test_registered():
    names = [f"op{n}_" for n in range(1, 14)]
    assert all(sum(q.startswith(n) for q in queries.QUERIES) == 1 for n in names)
