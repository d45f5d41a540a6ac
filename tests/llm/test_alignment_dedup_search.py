"""Alignment of tokenizers, line dedup and ranked search against brute force, on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from heddle.llm import alignment, lexical, line_dedup

SCHEMA = "doc_id long, text string, pairs string, times int, n_a string, doc long, mark string, value string, kept int, n_lines string, said int, `a.b` int"
ODD = ("p", 1, "n", 2, "m", "v", 3, "l", 4, 5)
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, *ODD) for i, t in rows], SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(11)
    words = ["the", "of", "erthing", "Ünïcode", "wörds", "don't", "中文字", "x1", "  ", "\n", "\t", "thandeed", "<|endoftext|>", "</s>", "<0x41>", "😀", "1234567"]
    plain = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    odd = [None, "", " ", "   ", "a ", " a", "\n\n", "a▁b", "▁", "\x00b", "é", "﻿x", "a\r\nb", "x" * 3000, " " * 500, "the of " * 20_000, plain[0], plain[0]]
    return list(enumerate(plain + odd)) + [(3, plain[3]), (None, plain[4]), (None, None)]


def brute_alignment(rows):
    a_lib, b_lib = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_lib.encode_special_tokens = True
    signs = {s: b for b, s in alignment.files.SIGNS.items()}
    docs, counts = [], collections.Counter()
    for i, text in rows:
        full = (" " + (text or "")).encode()
        a = a_lib.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_lib.encode(text or "")
        of_a = [bytes(signs[c] for c in a_lib.id_to_token(x)) for x in a]
        of_b = [bytes([int(p[3:5], 16)]) if b_lib.is_byte(x) else p.replace("▁", " ").encode() for x, p in ((x, b_lib.id_to_piece(x)) for x in b)]
        if not text or b"".join(of_a) != full or b"".join(of_b) != full:
            docs.append((i, 0, 0, [], []))
            continue
        ends_a, ends_b = ([sum(map(len, s[: k + 1])) for k in range(len(s))] for s in (of_a, of_b)) if len(full) < 4000 else (np.cumsum([*map(len, s)]).tolist() for s in (of_a, of_b))
        at_b = {e: k for k, e in enumerate(ends_b)}
        links = [(a[k], b[at_b[e]]) for k, e in enumerate(ends_a) if e in at_b]
        groups, p, q = [], 0, 0
        for k, e in enumerate(ends_a):
            if e in at_b:
                groups.append((a[p : k + 1], b[q : at_b[e] + 1]))
                p, q = k + 1, at_b[e] + 1
        counts.update(links)
        docs.append((i, len(a), len(b), groups, links))
    highest = collections.Counter()
    for (_, y), n in counts.items():
        highest[y] = max(highest[y], n)
    out = []
    for i, n_a, n_b, groups, links in docs:
        spelled = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        best = sum(counts[link] == highest[link[1]] for link in links)
        digest = hashlib.sha256(spelled.encode()).hexdigest() if groups else ""
        out.append((i, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), sum(len(x) * len(y) for x, y in groups), digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 3])
def test_alignment(spark, texts, most, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE", 700)
    got = alignment.align(table(spark, texts), A, B, most_pairs=most)
    assert "a.b" in got.columns and "pairs" not in got.columns and got.columns.count("n_a") == 1
    assert rows_of(got, "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups_sha256") == brute_alignment(texts)
    assert alignment.align(table(spark, texts).where("doc_id < -1"), A, B, most_pairs=most).count() == 0


def test_incidence_products():
    rnd = np.random.default_rng(2)
    for _ in range(20):
        x, y = rnd.random((rnd.integers(1, 9), 7)) < 0.4, rnd.random((7, rnd.integers(1, 9))) < 0.4
        csr = lambda m: alignment.Csr(np.concatenate(([0], np.cumsum(m.sum(1)))), np.nonzero(m)[1], m.shape[1])
        want = x.astype(int) @ y.astype(int)
        rows, columns, values = alignment.product(csr(x), csr(y))
        got = np.zeros_like(want)
        got[rows, columns] = values
        assert (got == want).all() and len(values) == (want > 0).sum()
        assert csr(x).counts_with(csr(y)) == want.sum()
        back = csr(x).transposed()
        assert (back.columns == np.nonzero(x.T)[1]).all()


def test_links_of_every_kind():
    file = alignment.files.read(A)
    with open(B, "rb") as model:
        aligner = alignment.Aligner(file, alignment.Merges.of(file), model.read())
    (a, b), = aligner.tokens(["thandeed 中文 ofthe"])
    found = aligner.links(a, b)
    spans = []
    for ids, sizes in ((a, aligner.bytes_a.size), (b, aligner.bytes_b.size)):
        stop = np.cumsum(sizes[ids])
        spans.append(list(zip(stop - sizes[ids], stop, strict=True)))
    want = {(i, j): min(p[1], q[1]) - max(p[0], q[0]) for i, p in enumerate(spans[0]) for j, q in enumerate(spans[1]) if min(p[1], q[1]) > max(p[0], q[0])}
    assert {(r, c): s for r, c, s in zip(found["row"], found["column"], found["shared"], strict=True)} == want
    groups = int(found["group_a"][-1]) + 1
    rows, columns, _ = alignment.product(alignment.Csr.of(found["group_a"], groups), alignment.Csr.of(found["group_b"], groups).transposed())
    assert set(zip(rows.tolist(), columns.tolist(), strict=True)) == {(i, j) for i in range(len(a)) for j in range(len(b)) if found["group_a"][i] == found["group_b"][j]}


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute_lines(rows, least_chars=40, least_docs=5):
    key = lambda line: ascii_lower(line.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    below = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            held[key(line)].add(below(i))
    out = []
    for i, t in rows:
        cut = (t or "").split("\n")
        gone = [len(key(x)) >= least_chars and len(held[key(x)]) >= least_docs and below(i) < max(held[key(x)]) for x in cut]
        out.append((i, len(cut), sum(gone), "\n".join(x for x, g in zip(cut, gone, strict=True) if not g)))
    return sorted(out, key=repr)


def line_rows(n, seed):
    rnd = random.Random(seed)
    common = [f"Line number {k} that stands in many documents, whole" for k in range(6)] + ["Ünïcode lïne thät stands ïn mäny öf them, döne", "short line", "x" * 39, "Y" * 40, "é" * 39, "é" * 40]
    out = []
    for i in range(n):
        cut = [rnd.choice(common) if rnd.random() < 0.5 else f"own {rnd.randrange(10 ** 9)} " + "text " * rnd.randint(0, 12) for _ in range(rnd.randint(0, 9))]
        out.append((i, "\n".join(rnd.choice(["", " ", "\t", "\x0b"]) + (x.upper() if rnd.random() < 0.2 and x.isascii() else x) + rnd.choice(["", " ", "\r"]) for x in cut)))
    hot = "the one line of them all, which a third of all rows holds"
    out = [(i, f"{t}\n{hot}\n{hot}" if i % 3 == 0 else t) for i, t in out]
    return out + [(None, None), (n, ""), (n + 1, "\n\n"), (4, out[9][1]), (4, out[9][1]), (None, f"{hot}\n{common[0]}"), (None, common[1]), (n + 2, "\n".join([common[0]] * 3000))]


@pytest.mark.parametrize(("n", "parts"), [(60, 3), (400, 40)])
def test_line_dedup(spark, n, parts):
    rows = line_rows(n, n)
    docs = table(spark, rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # many ranges, so hashes go across their ends
    try:
        got = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
        assert got.columns.count("kept") == 1 and "a.b" in got.columns
        assert rows_of(got, "doc_id", "n_lines", "n_dropped", "kept") == brute_lines(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    none = docs.where("doc_id < -1")
    assert line_dedup.apply(none, line_dedup.keep_bitmaps(none)).count() == 0


def test_line_stream_in_any_batches():
    rnd = random.Random(4)
    for _ in range(60):
        rows = sorted({(rnd.randrange(5), rnd.randrange(2), -rnd.randrange(9), 0, rnd.randrange(3)) for _ in range(rnd.randint(1, 80))})
        columns = [np.array(c, np.int64) * (-1 if k == 2 else 1) for k, c in enumerate(zip(*rows, strict=True))]
        docs = collections.defaultdict(set)
        for h1, h2, doc, *_ in zip(*columns, strict=True):
            docs[h1, h2].add(doc)
        told, at, stream = [], 0, line_dedup.Stream(3)
        while at < len(rows):
            step = rnd.randint(1, 20)
            told += list(zip(*stream.feed([c[at : at + step] for c in columns]), strict=True))
            at += step
        told += list(zip(*stream.end(), strict=True))
        first = (columns[0][0], columns[1][0])
        last = (columns[0][-1], columns[1][-1])
        gone = {tuple(map(int, r[:5])) for r in told if r[5] == line_dedup.DROPPED}
        inner = {h for h in docs if h not in (first, last)}
        want = {tuple(map(int, r)) for r in zip(*columns, strict=True) if (r[0], r[1]) != first and len(docs[r[0], r[1]]) >= 3 and r[2] < max(docs[r[0], r[1]])}
        assert gone == want
        assert {(r[0], r[1]) for r in told if r[5] != line_dedup.DROPPED} <= {first, last} and not inner & {(r[0], r[1]) for r in told if r[5] == line_dedup.UNSETTLED}


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_search(rows, items, k):
    docs = [(i, collections.Counter(TERM.findall(ascii_lower(t or "")))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n, total = len(docs), sum(s for *_, s in docs)
    df = collections.Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in docs:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in TERM.findall(ascii_lower(text or "")) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, x[3], -x[0]) for rank, x in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def search_rows():
    rnd = random.Random(9)
    vocabulary = [f"{rnd.choice('abcdefgh')}{w}ë" if w % 5 == 0 else f"{rnd.choice('ABCDefgh')}{w}" for w in range(150)]
    prose = lambda n: " ".join(vocabulary[min(149, int(rnd.expovariate(0.04)))] for _ in range(n))
    base = [prose(rnd.randint(5, 90)) for _ in range(260)]
    rows = list(enumerate(base + [base[5]] * 40 + [base[7] + " more", None, "", "!?", "-", prose(9000)]))
    rows += [(3, base[3]), (3, base[3]), (None, base[5]), (None, base[6])]
    items = [(k, t) for k, t in enumerate([*base[:12], base[5] + " " + base[5], vocabulary[149], "unheard", "", None, "!!", vocabulary[1] + " " + vocabulary[2]])]
    return rows, items


@pytest.mark.parametrize(("k", "most_terms", "sampled"), [(10, lexical.MOST_TERMS, lexical.SAMPLED), (3, 60, 20), (400, 100_000, 1)])
def test_ranked_search(spark, k, most_terms, sampled, monkeypatch):
    rows, items = search_rows()
    monkeypatch.setattr(lexical, "SEGMENT_BYTES", 1)  # 64 documents a segment
    docs = table(spark, rows)
    asked = spark.createDataFrame(items, "item_id int, text string")
    got = lexical.top_k(docs, asked, k, most_terms=most_terms, sampled=sampled)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_search(rows, items, k)
    for d, i in ((docs.where("doc_id < -1"), asked), (docs, asked.where("item_id < 0")), (docs.where("text = '!?'"), asked)):
        assert lexical.top_k(d, i, k).count() == 0


def test_search_skips_blocks():
    """In lists of documents that fall into families, most blocks stay unscored, and the result is whole."""
    rnd = np.random.default_rng(3)
    size, families = 300, 12
    home = rnd.integers(0, families, 2000)
    impact_terms = [np.unique(np.concatenate((rnd.choice(25, 8) + 25 * f, rnd.choice(size, 2), [0]))) for f in home]
    tfs = [rnd.integers(1, 4, len(t)) for t in impact_terms]
    items = [(np.sort(np.concatenate(([0], 25 * f + 1 + rnd.choice(24, 6, replace=False)))), np.ones(7, np.int64)) for f in range(families)]
    df = np.bincount(np.concatenate(impact_terms), minlength=size)
    n = np.array([t.sum() for t in tfs])
    asked = lexical.Asked(items, lexical.weights(df, 2000), 2000, int(n.sum()), 10, np.zeros(families, np.int64))
    search = lexical.Search(asked)
    search.rows = 1000
    packed = [[x.astype("<i4").tobytes() for x in xs] for xs in (impact_terms, tfs)]
    for at in range(0, 2000, 1000):
        s = slice(at, at + 1000)
        search.segment(np.arange(2000)[s], n[s], packed[0][s], packed[1][s])
    dense = np.zeros((2000, size), np.int64)
    m = 25 + (75 * n * 2000) // int(n.sum())
    for i, (t, tf) in enumerate(zip(impact_terms, tfs, strict=True)):
        dense[i, t] = asked.weight[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[i]))
    for (ids, times), (score, doc) in zip(items, search.best, strict=True):
        every = dense[:, ids] @ times
        order = np.lexsort((np.arange(2000), -every))[:10]
        assert doc.tolist() == order.tolist() and score.tolist() == every[order].tolist()
    assert search.scored < 0.5 * 2000 * families
