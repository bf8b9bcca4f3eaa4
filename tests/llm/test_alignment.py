"""Operator 11 against the tokenizers' own libraries and plain counting."""

import hashlib
import json
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from brickwork.llm import alignment, queries

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    _, entries, model = alignment.default_paths()
    a = Tokenizer.from_file(entries)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=model)
    vocab = {i: t for t, i in json.load(open(entries))["model"]["vocab"].items()}
    keep = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or c >= 174]
    byte = {chr(c): c for c in keep}
    byte.update({chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in keep)})

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[1:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def groups(text):
        if not text:
            return []
        x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        xb, yb = [bytes(byte[c] for c in vocab[i]) for i in x], [piece(i) for i in y]
        if not b"".join(xb) == b"".join(yb) == (" " + text).encode():
            return []
        out, i, j = [], 0, 0
        while i < len(x):
            p, q, m, n = i + 1, j + 1, len(xb[i]), len(yb[j])
            while m != n:
                if m < n:
                    m, p = m + len(xb[p]), p + 1
                else:
                    n, q = n + len(yb[q]), q + 1
            out.append((x[i:p], y[j:q]))
            i, j = p, q
        return out

    return groups


def expected(groups, rows):
    found = [(i, groups(t)) for i, t in rows]
    count = Counter((x[-1], y[-1]) for _, gs in found for x, y in gs)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    for i, gs in found:
        links = [(x[-1], y[-1]) for x, y in gs]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        yield (
            i, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links),
            sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if gs else "",
        )


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    rng = random.Random(2)
    signs = ["the ", "über", "\n", "\t", "  ", "<|endoftext|>", "</s>", "<0x41>", "▁", "中文", "🙂", "é", " ", "don't ", "ABC", "12345", "\r\n", "a" * 70, "﻿", "ﬁ", "​", "x"]
    texts = [None, "", " ", "  ", "a", "▁", "<unk>", "<s>", "hello world", "hello world", "\x00", "a\x00b"]
    return texts + ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(60)] + ["lorem ipsum dolor " * 3000]


def test_digests(spark, plain):
    rows = [(None if k == 3 else k % 50, t) for k, t in enumerate(odd_texts())]
    df = spark.createDataFrame([(i, t, 1, 2, b"x") for i, t in rows], "doc_id long, text string, a int, n_a long, same binary").repartition(3)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in alignment.digests(df).collect()), key=str)
    assert got == sorted(expected(plain, rows), key=str)


def test_align_gives_the_groups(spark, plain):
    rows = list(enumerate(odd_texts()))
    for r in alignment.align(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        cut = lambda ids, last: [ids[i + 1 : j + 1] for i, j in zip([-1, *last], last)]
        assert list(zip(cut(r["a"], r["a_last"]), cut(r["b"], r["b_last"]))) == plain(rows[r["doc_id"]][1])


def test_counts_and_identity(spark, plain):
    rows = list(enumerate(odd_texts()))
    links = alignment.encoded(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["a"], r["b"]): r["n"] for r in alignment.pair_counts(links).collect()}
    assert got == Counter((x[-1], y[-1]) for _, t in rows for x, y in plain(t))
    own = alignment.pair(*alignment.default_paths())
    for a, b in got:
        s, t = own.a.token[a], own.b.token[b]
        assert s.endswith(t) or t.endswith(s)
    assert len(got) < own.most_pairs()


def test_empty_table(spark):
    assert alignment.digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_identity_alignment"](spark, SF_DIR).collect())
    assert got == sorted(expected(plain, rows))
