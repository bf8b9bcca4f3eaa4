"""Operators against brute force on small tables with odd rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from brickwork.llm import bpe, decontaminate, jaccard, lines, pii, quality, queries, substrings, toxicity, urls, windows

SF_DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard int, v string"


def table(spark, texts, ids=None):
    """Documents with an extra column of a name that operators use inside."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en", None if k % 3 == 0 else "s", None if t is None else len(t), 7, "x") for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, SCHEMA)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd():
    """Null, empty, blank, repeated, periodic and long texts, and passages shared by several."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    texts = [None, "", "  \n\t ", "a", shared, shared, prose(rng, 40) + " " + shared + " " + prose(rng, 30), "é" * 40 + shared[:120], "ab" * 200, "ab" * 300]
    texts += [shared + "\n" + prose(rng, 20), "x y z " * 40, prose(rng, 6000), None, "", shared.replace("w1 ", "w2 "), "one two three\none two three\n\none two three four"]
    return texts + [prose(rng, 80) + "\n" + prose(rng, 25) for _ in range(10)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def removed_bytes(texts, length):
    first = {}
    data = [(t or "").encode() for t in texts]
    for i, b in enumerate(data):
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    for i, b in enumerate(data):
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone) if not g)
        yield i, (len(b), sum(gone), sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest())


def test_substrings(spark, odd):
    found = by_id(substrings.dedup(table(spark, odd)))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found.items()} == dict(removed_bytes(odd, 50))


def test_substrings_query(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").orderBy("doc_id").collect()
    want = {rows[i]["doc_id"]: w for i, w in removed_bytes([r["text"] for r in rows], 50)}
    found = by_id(queries.QUERIES["op1_suffix_array_dedup"](spark, SF_DIR))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in found.items()} == want


def test_many_short_texts_in_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50_000)
    try:
        texts = ["one two three four five"] + [""] * 40_000 + ["one two three four five", "six"]
        found = lines.decisions(table(spark, texts).coalesce(1)).where("n_removed > 0").collect()
        assert [(r["doc_id"], r["removed"]) for r in found] == [(40_001, [0])]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_windows(spark, odd):
    split = [[w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w] for t in odd]
    count = Counter(tuple(w[p : p + 35]) for w in split for p in range(len(w) - 34))
    found = by_id(windows.dedup(table(spark, odd)))
    for i, w in enumerate(split):
        gone = {p + k for p in range(len(w) - 34) if count[tuple(w[p : p + 35])] > 1 for k in range(35)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (found[i]["n_words"], found[i]["n_removed"], found[i]["kept_sha256"]) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()), i


def shingles(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text or "") if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def similar(a, b):
    return bool(a | b) and len(a & b) >= 0.8 * len(a | b)


def test_lines(spark, odd):
    seen, want = [], {}
    for i, t in enumerate(odd):
        want[i] = []
        for k, s in enumerate((t or "").split("\n")):
            mine = shingles(s)
            if any(similar(mine, other) for other in seen):
                want[i].append(k)
            if mine:
                seen.append(mine)
    found = by_id(lines.decisions(table(spark, odd)))
    assert {i: r["removed"] for i, r in found.items()} == want
    kept = by_id(lines.clean(table(spark, odd)))
    assert kept[0]["text"] is None and kept[16]["text"].count("one two three four") == 1
    assert all(kept[i]["text"] == "\n".join(s for k, s in enumerate(t.split("\n")) if k not in want[i]) for i, t in enumerate(odd) if t is not None)


def test_lines_told_apart(spark):
    """Short lines whose tokens agree in 42 bits, and lines of one run that differ in length."""
    texts = ["3734858", "1139579", "5689378\n7949373\n 5689378", "a a a a a", "a a a a a a a", "a a a a"]
    found = by_id(lines.decisions(table(spark, texts)))
    assert [found[i]["removed"] for i in range(len(texts))] == [[], [], [2], [], [0], []]


def test_line_tokens(monkeypatch):
    tail = b"a b c d e f"
    buf = np.frombuffer(b"\n" * (1 << 22) + tail, np.uint8)
    token, line = lines.token_sets(buf, lines.line_offsets(buf, np.array([0, len(buf)]))[0], 5)
    assert len(token) == 2 and set(line) == {1 << 22}
    same, few = np.uint64(1 << 63), np.array([5, 3, 5, 4, 5], np.uint64)  # upper bits alike
    monkeypatch.setattr(lines, "grams", lambda *_: (same | few, np.array([0, 0, 0, 1, 1])))
    token, line = lines.token_sets(buf, np.arange(3), 5)
    assert (token ^ same).tolist() == [3, 5, 4, 5] and line.tolist() == [0, 0, 1, 1]
    # One token decides: then the words do, even if all 64 bits agree.
    monkeypatch.setattr(lines, "grams", lambda buf, at, gram: (np.full(len(at) - 1, same), np.arange(len(at) - 1)))
    rows = pa.table({"c": [1, 2, 3], "own": [0, 0, 0], "i": [0, 0, 0], "j": [0, 0, 0], "words": ["a b", "c d", " a  b"]})
    assert lines._similar(rows, np.zeros(3, np.int64), 5, 0.8, (np.zeros(0, np.uint64), np.zeros(0, np.int64))).tolist() == [2]


def test_lines_compared_once(monkeypatch):
    """Lines that share many prefix tokens are compared in the group of the least of these; a shared run alone compares no sets."""
    order, rng = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), random.Random(12)

    def rows(texts):
        zeros = [0] * len(texts)
        return pa.table({"c": range(len(texts)), "own": zeros, "i": zeros, "j": zeros, "words": texts})

    line = prose(rng, 60, 10**6)
    pair = rows([line, line + " more"])
    buf = np.frombuffer((line + "\n" + line + " more").encode(), np.uint8)
    token, of = lines.token_sets(buf, np.array([0, len(line) + 1, len(buf)]), 5)
    head = [set(token[of == k][: lines.prefix(np.array([56 + k]), 0.8)[0]].view(np.int64).tolist()) for k in (0, 1)]
    both = sorted(head[0] & head[1])
    assert len(both) > 5
    assert [lines._similar(pair, np.zeros(2, np.int64), 5, 0.8, order, np.array([g])).tolist() for g in both] == [[1]] + [[]] * (len(both) - 1)
    # Repeated rows stand for each other.
    again = pa.concat_tables([pair.slice(0, 1), pair.slice(0, 1), pair.slice(1), pair.slice(1)])
    assert lines._similar(again, np.zeros(4, np.int64), 5, 0.8, order).tolist() == [2]
    compared, common = [], lines._common
    monkeypatch.setattr(lines, "_common", lambda number, start, size, x, y: (compared.append(int((size[x] + size[y]).sum())), common(number, start, size, x, y))[1])
    shared = rows([prose(rng, 5, 3) + " " + prose(rng, 95, 10**6) for _ in range(40)])
    assert lines._similar(shared, np.zeros(40, np.int64), 5, 0.8, order).tolist() == []
    assert sum(compared) == 780 * 2 * 20  # prefixes only, where sets would be 780 * 2 * 96
    # Chunks of pairs, and what the first turn did not find.
    monkeypatch.setattr(lines, "_TOKENS", 100)
    assert lines._similar(rows([line, line + " more", prose(rng, 60, 10**6), line + " more yet"]), np.zeros(4, np.int64), 5, 0.8, order).tolist() == [1, 3]


def test_lines_of_near_copies(spark):
    """Chains of edits around the threshold, with repeated rows, null ids and tokens that many lines share."""
    rng, texts = random.Random(21), []
    for _ in range(12):
        words = prose(rng, rng.choice([6, 25, 60, 150]), 10**5).split(" ")
        for _ in range(14):
            kept = list(words)
            for _ in range(rng.randrange(4)):
                kept[rng.randrange(len(kept))] = f"w{rng.randrange(9)}"
            texts.append(rng.choice(["", "a b c d e f "]) + " ".join(kept[rng.randrange(3) :] + ["t"] * rng.randrange(12)))
    rng.shuffle(texts)
    docs = ["\n".join(texts[k : k + 4]) for k in range(0, len(texts), 4)]
    seen, want = [], {}
    for i, t in [*enumerate(docs[:-1]), (None, docs[-1])]:
        want[i] = []
        for k, s in enumerate(t.split("\n")):
            mine = shingles(s)
            if any(similar(mine, other) for other in seen):
                want[i].append(k)
            seen.append(mine)
    rows = [*enumerate(docs[:-1]), (None, docs[-1]), *[(i, docs[i]) for i in range(0, 30, 3)] * 2]
    found = lines.decisions(table(spark, [t for _, t in rows], [i for i, _ in rows])).collect()
    assert len(found) == len(rows) and 40 < sum(len(w) for w in want.values()) < 160
    assert all(r["removed"] == want[r["doc_id"]] for r in found)


def test_jaccard(spark):
    rng = random.Random(8)
    base = prose(rng, 120).split(" ")
    texts = [None, "", "a b", "a b", "  ", " ".join(base)]
    for k in range(400):  # a group beyond one block
        other = list(base)
        other[rng.randrange(len(other))] = f"n{k}"
        texts.append(" ".join(other))
    texts += [prose(rng, 50) for _ in range(20)]
    sets = [shingles(t) for t in texts]
    found = by_id(jaccard.join(table(spark, texts)))
    links = [sum(similar(a, b) for j, b in enumerate(sets) if texts[j] != texts[i] and a) for i, a in enumerate(sets)]
    got = [found[i]["n_links"] for i in range(len(texts))]
    assert got == links
    assert {found[i]["group_id"] for i in range(5, 406)} == {5} and found[3]["class_id"] == 2 and found[3]["n_copies"] == 2
    kept = {r["doc_id"] for r in jaccard.representatives(table(spark, texts)).collect()}
    assert kept == {found[i]["group_id"] for i in range(len(texts))}


def test_recall():
    for rows in (3, 5, 8):
        bands, r = jaccard.bands_for(0.8, 0.995, rows)
        assert 1 - (1 - 0.8**r) ** bands >= 0.995 > 1 - (1 - 0.8**r) ** (bands - 1)


def test_bpe(spark, odd):
    path = bpe.vocabulary_path()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", "a", "'s", "'re", "'", "é", "1", "٣", ".", "!", "𝒳", "Ⅷ", "\x1c", "\x85", "the", "中", "'v", "e"]
    texts = odd + ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)] + ["a" * 3000 + "!?" * 500 + " " * 700]
    docs = table(spark, texts)
    want = [own.encode_ordinary(t or "") for t in texts]
    found = by_id(bpe.decode(bpe.encode(docs)))
    assert all(found[i]["ids"] == w and bytes(found[i]["decoded"]) == (texts[i] or "").encode() for i, w in enumerate(want))
    for i, r in by_id(bpe.digests(docs)).items():
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want[i]), hashlib.sha256(" ".join(map(str, want[i])).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((texts[i] or "").encode()).hexdigest()


def test_digests_in_sql(spark, odd):
    """Texts through Spark SQL alone give the digests of the main path, which ``test_bpe`` holds against the library."""
    texts = [t for t in odd if t is None or len(t) < 1000] + ["I'll don't 've  \u00a0\u2003x\n\n y\t", "中文🙂 naïve ½ ² 12345", "x" * 70, " "]
    docs = table(spark, texts, [k % 9 or None for k in range(len(texts))])
    assert sorted(bpe.digests_by_words(docs).collect(), key=str) == sorted(bpe.digests(docs).collect(), key=str)


def test_bpe_in_sql(spark):
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.ranks(bpe.vocabulary_path()), special_tokens={})
    words = [" thonnd", "Erheing", " the", "a", "é", " Straße", "!!!"]
    found = bpe.encode_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()
    assert {r["word"]: r["ids"] for r in found} == {w: own.encode_ordinary(w) for w in words}


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        total = sum(d if k % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for k, d in enumerate(reversed(digits)))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(pii.KINDS[k], a, b) for a, k, b in sorted(out)]


def test_pii(spark, odd):
    rng = random.Random(3)
    parts = ["a@b.co", "x_y+1@mail.example.com_z@q.de", "@", ".", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "4111 1111 1111 1111", "4337166598464399", "+1 (724) 555-7058", "é", " ", "-", "12", "\n", "word"]
    texts = odd + ["".join(rng.choice(parts) for _ in range(rng.randrange(10))) for _ in range(2000)] + ["(724) 555-7058 is it, call (724) 555-7058 now."]
    model = pii.train(pii.labelled_table(spark))
    found = by_id(pii.find(table(spark, texts), model))
    for i, t in enumerate(texts):
        base = [tuple(s) for s in found[i]["base"]]
        spans = [tuple(s) for s in found[i]["spans"]]
        assert base == base_spans(t or "")
        assert set(base) <= set(spans) and all(0 <= a < b <= len(t) for _, a, b in spans)
    assert any(s["kind"] == "phone" for s in found[len(texts) - 1]["spans"])  # not found by the patterns
    rows = queries.QUERIES["op3_personal_data"](spark, SF_DIR).collect()
    docs = by_id(spark.read.parquet(f"{SF_DIR}/documents.parquet"))
    for r in rows:
        want = base_spans(docs[r["doc_id"]]["text"])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in want) for k in pii.KINDS]


def labelled_part(spark, sf_dir, rest):
    """Labels of the rows with a remainder, never the held-out one."""
    assert rest != 1
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == rest).select("doc_id", "toxic")


def test_toxicity(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, labelled_part(spark, sf_dir, 0))
    scored = toxicity.score(docs, model).join(labelled_part(spark, sf_dir, 2), "doc_id")
    right = Counter((r["toxic"], r["predicted"]) for r in scored.select("toxic", "predicted").collect())
    assert right[0, 1] <= 0.01 * (right[0, 0] + right[0, 1]) and right[1, 1] >= 0.5 * (right[1, 0] + right[1, 1])


def test_toxicity_learns_nothing_from_held_out_labels(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{n}.parquet") for n in ("documents", "labels"))
    turned = F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.withColumn("toxic", turned.cast(labels.schema["toxic"].dataType)).write.parquet(f"{tmp_path}/labels.parquet")
    one, two = ({r["doc_id"]: r["score"] for r in queries.QUERIES["op5_toxicity"](spark, d).collect()} for d in (SF_DIR, str(tmp_path)))
    assert one == two and len(set(one.values())) > 1


def test_ftrl_against_plain_updates():
    rng = random.Random(6)
    examples = [(np.array(sorted(rng.sample(range(40), rng.randrange(0, 12))), np.int64), float(rng.random() < 0.4)) for _ in range(150)]
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0.0 if i == "bias" else toxicity.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for f, y in examples:
            names = [*f.tolist(), "bias"]
            w = {i: weight(i) for i in names}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y
            for i in names:
                sigma = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA
                z[i] += g - sigma * w[i]
                n[i] += g * g
    at, w, bias = toxicity.fit_rows(examples)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert at.tolist() == sorted(want) and 0 < len(want) < 40
    assert np.allclose(w, [want[i] for i in sorted(want)]) and np.isclose(bias, weight("bias"))


def test_toxicity_labels_by_key(spark):
    """A table of labels, with repeated and null keys, gives the rows that a plain join gives."""
    rows = [(1, "hot text")] * 50 + [(1, f"other {k}") for k in range(20)] + [(k, f"text {k}") for k in range(2, 12)] + [(None, "x"), (3, None)]
    docs = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (3, None), (None, 1), (99, 1)], "doc_id long, toxic int")
    joined = docs.select("doc_id", "text").join(labels, "doc_id")
    for most in (1, 30, 1000):
        one, two = (sorted(tuple(r) for r in toxicity.training_rows(*a, max_rows=most).collect()) for a in ((docs, labels), (joined,)))
        assert one == two and len(one) == min(most, 74)


def test_toxicity_odd_rows(spark, odd):
    docs = table(spark, odd)
    none = toxicity.train(docs.select("doc_id", "text", F.lit(None).cast("int").alias("toxic")))
    scored = by_id(toxicity.score(docs, none))
    assert all(0 <= r["score"] < 0.7 and r["predicted"] == 0 for r in scored.values())
    some = toxicity.train(docs.select("doc_id", "text", (F.col("doc_id") % 2).alias("toxic")))
    again = by_id(toxicity.score(docs, some))
    assert again[4]["score"] == again[5]["score"] and toxicity.keep(docs, none).count() == len(odd)


def test_toxicity_training_rows(spark):
    rows = [(1, "hot text", 1)] * 50 + [(1, f"other {k}", 0) for k in range(20)] + [(k, f"text {k}", 0) for k in range(2, 12)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert [toxicity.training_rows(labelled, max_rows=n).count() for n in (1, 7, 30, 79, 80, 100)] == [1, 7, 30, 79, 80, 80]


def test_decontamination(spark, odd):
    rng = random.Random(9)
    item = prose(rng, 30)
    swapped = item.split(" ")
    swapped[4], swapped[15], swapped[26] = "other", "words", "here"
    docs = table(spark, [*odd, "Before, " + item.upper() + " after.", "so " + " ".join(swapped) + " on", item[:40], "so " + " ".join(swapped) + " on"], [*range(len(odd)), None, 901, 902, 901])
    tests = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    found = decontaminate.judge(docs, tests).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found if r["contaminated"]) == [(False, 901), (False, 901), (True, None)]
    assert len(found) == len(odd) + 4 and decontaminate.clean(docs, tests).count() == len(odd) + 1
    assert decontaminate.clean(docs, tests.limit(0)).columns == docs.columns


def test_items_without_id_and_with_two_texts(spark):
    rng = random.Random(21)
    one, two, three = (prose(rng, 30) for _ in range(3))
    tests = spark.createDataFrame([(None, one), (7, two), (7, three)], "item_id long, text string")
    docs = table(spark, [f"so {one} on", f"{two} and {three}", f"{three}!", "clean words only", f"{one} {two}"])
    found = by_id(decontaminate.judge(docs, tests))
    assert {i: (r["contaminated"], r["n_items"], r["item_id"]) for i, r in found.items()} == {
        0: (True, 1, None), 1: (True, 1, 7), 2: (True, 1, 7), 3: (False, 0, None), 4: (True, 2, None)
    }
    assert [r["doc_id"] for r in decontaminate.clean(docs, tests).collect()] == [3]


def test_items_and_pages_with_more_columns(spark):
    item = prose(random.Random(2), 30)
    tests = spark.createDataFrame([(1, item, "x", 2, 3)], "item_id long, text string, _item string, share int, seed int")
    docs = table(spark, [item, "clean"])
    assert {i: r["contaminated"] for i, r in by_id(decontaminate.judge(docs, tests)).items()} == {0: True, 1: False}
    pages = spark.createDataFrame([(1, "http://example.org/es/a", "", "x", 4, 5), (2, None, None, "x", 4, 5)], "page_id long, url string, html string, host string, node int, verdict int")
    assert {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()} == {1: "block", 2: "allow"}


def test_columns_named_as_those_inside(spark, odd):
    docs = table(spark, odd)
    for name in ("_rid", "_removed", "_RID", "_id", "_print", "rid", "line", "_keeper", "c"):
        named = docs.withColumn(name, F.lit(3))
        for operator in (jaccard.representatives, lines.clean):
            out = operator(named)
            assert out.columns == named.columns and {r[name] for r in out.select(name).collect()} == {3}
            if name == "_removed":
                assert sorted(map(str, out.drop(name).collect())) == sorted(map(str, operator(docs).collect()))


def test_spans_in_long_sentences(spark):
    call = "call (724) 555-7058"
    texts = [" ".join(["word"] * n + [call]) + " now" for n in (100, 480, 508, 509, 510, 511, 512, 1022, 5000)]
    texts.append(" ".join(["word"] * 700))
    model = pii.train(pii.labelled_table(spark))
    found = by_id(pii.find(table(spark, texts), model))
    for i, t in enumerate(texts[:-1]):
        assert [tuple(s) for s in found[i]["spans"]] == [("phone", t.index("("), t.index(" now"))], i
    assert not found[len(texts) - 1]["spans"]


def test_labels_in_parts():
    rng = np.random.default_rng(4)
    exact = lambda *size: (rng.integers(-512, 512, size) / 256).astype(np.float32)  # noqa: E731  (sums without rounding)
    table = [exact(50, pii._STATES) * k for k in (0.25, 2, 0.25)]
    pair, shape = exact(pii._STATES, pii._STATES), rng.integers(0, 50, 6000)
    first = np.zeros(6000, bool)
    first[[0, 10, 700, 701, 4000]] = True
    assert (pii.labels(table, pair, shape, first) == pii.viterbi(table, pair, shape, first)).all()


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 5):
        table = [rng.normal(size=(6, pii._STATES)).astype(np.float32) for _ in range(3)]
        pair, shape = rng.normal(size=(pii._STATES, pii._STATES)), rng.integers(0, 6, n)
        first = np.zeros(n, bool)
        first[0] = True

        def total(y):
            own = sum(table[1][shape[i]][y[i]] for i in range(n))
            before = sum(table[0][shape[i - 1]][y[i]] for i in range(1, n))
            after = sum(table[2][shape[i + 1]][y[i]] for i in range(n - 1))
            return own + before + after + sum(pair[y[i - 1]][y[i]] for i in range(1, n))

        best = max(itertools.product(range(pii._STATES), repeat=n), key=total)
        assert tuple(pii.viterbi(table, pair, shape, first)) == best


def test_decontamination_masks():
    every = set(decontaminate.MASKS)
    for size in range(1, decontaminate.VERIFIED + 1):
        masks = decontaminate.MASKS[max(n for n in every if n <= size)]
        placed = [sum(1 << (k + j) for j, c in enumerate(m) if c == "1") for m in masks for k in range(size - len(m) + 1)]
        differ = max(k for k in range(size) if (size - k) / size >= decontaminate.MIN_SHARE)
        for gone in itertools.combinations(range(size), differ):
            assert any(not p & sum(1 << g for g in gone) for p in placed), (size, gone)


def test_decontamination_against_sliding(spark):
    rng = random.Random(12)
    items = [[f"i{n}x{k}" for k in range(n)] for n in (1, 2, 3, 4, 5, 7, 9, 10, 12, 14, 15, 17, 19, 20, 23, 30, 45, 59)]
    texts = []
    for item in items:
        n = len(item)
        for k in range(8):
            copy = list(item)
            gone = range(k, n, 5) if k < 5 else rng.sample(range(n), min(n, rng.choice([n // 5, n // 5 + 1])))
            for g in gone:
                copy[g] = "other"
            before, after = rng.choice([[], ["a", "b", "c"]]), rng.choice([[], ["d"]])
            texts.append(before + copy + after if k != 6 else copy[n // 6 :])
    found = by_id(decontaminate.judge(table(spark, [" ".join(t) for t in texts]), spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")))
    hit = 0
    for i, text in enumerate(texts):
        best = []
        for number, item in enumerate(items):
            size = min(len(item), decontaminate.VERIFIED)
            for shift in range(-len(item) + 1, len(text)):
                same = [0 <= j + shift < len(text) and text[j + shift] == w for j, w in enumerate(item)]
                share = max(sum(same[a : a + size]) for a in range(len(item) - size + 1)) / size
                if share >= decontaminate.MIN_SHARE:
                    best.append((-share, number))
        want = (True, len({b[1] for b in best}), min(best)[1], -min(best)[0]) if best else (False, 0, None, 0.0)
        assert (found[i]["contaminated"], found[i]["n_items"], found[i]["item_id"], found[i]["share"]) == want, i
        hit += bool(best)
    assert 0 < hit < len(texts)


def test_quality_odd_rows(spark, odd):
    found = by_id(quality.judge(table(spark, odd)))
    assert found[0]["n_words"] == 0 and found[0]["base_failed"] and not found[0]["kept"]
    assert found[11]["n_repeat_words"] == 120 and found[16]["n_dup_lines"] == 1
    bad = spark.createDataFrame([(k, "spam", "short") for k in range(40)] + [(k, "spam", prose(random.Random(k), 30)) for k in range(40, 45)] + [(k, "good", prose(random.Random(k), 30)) for k in range(50, 90)], "doc_id long, source string, text string")
    verdict = by_id(quality.judge(bad))
    assert not any(r["kept"] for i, r in verdict.items() if i < 45) and all(r["kept"] for i, r in verdict.items() if i >= 50)


def hosts_that_differ():
    """Documents of hosts that fail by words, by symbols, by lines, hardly ever, and of no host."""
    rng = random.Random(31)
    make = {
        "short": lambda k: "too short" if k % 10 else prose(rng, 30),
        "signs": lambda k: prose(rng, 30) + " " + "#*$" * 30 if k % 5 else prose(rng, 30),
        "lines": lambda k: "\n".join([prose(random.Random(3), 8)] * 3 + [prose(rng, 60)]) if k % 4 else prose(rng, 30),
        "good": lambda k: prose(rng, 30) if k % 20 else "too short",
        "tiny": lambda k: "too short" if k < 2 else prose(rng, 30),
        None: lambda k: "too short" if k % 2 else prose(rng, 30),
    }
    rows = [(host, of(k)) for host, of in make.items() for k in range(3 if host == "tiny" else 60)]
    return [(i, t, host, 1, "x") for i, (host, t) in enumerate(rows)]


def test_hosts_that_differ(spark, tmp_path):
    rows = hosts_that_differ()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n long, rule string")
    found = by_id(quality.judge(docs))
    rate = {h["source"]: h for h in quality.host_rates(spark.createDataFrame(list(found.values())).withColumn("source", F.col("source"))).collect()}
    assert rate["short"]["base_failed_rate"] > 0.5 and rate["signs"]["symbols_failed_rate"] > 0.5 and rate["lines"]["lines_failed_rate"] > 0.5
    own = {h: sum(found[i]["base_failed"] for i, _, s, *_ in rows if s == h) for h in ("good", "tiny")}
    assert own["good"] / 60 < rate["good"]["base_failed_rate"] < 0.2 and 0.3 < rate["tiny"]["base_failed_rate"] < own["tiny"] / 3  # drawn in
    gone = {"short", "signs", "lines"} | ({"tiny"} if rate["tiny"]["base_failed_rate"] > 0.5 else set())
    for i, _, host, *_ in rows:
        assert found[i]["kept"] == (not found[i]["base_failed"] and host not in gone)
    # The query's SQL tells these hosts apart as well.
    import compare

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = compare.duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare.difference(queries.QUERIES["op8_host_rules"](spark, str(tmp_path)), con, queries.ORACLE["op8_host_rules"]) is None


def test_redirects(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://a.example.com/de/1", None), (2, "https://www.other.net/x/?utm_source=q#top", '<link rel="canonical" href="http://a.example.com/de/1">'),
            (3, "http://other.net/x.html", ""), (4, None, None), (5, "no scheme", "x"), (6, "http://b.net/y", '<meta http-equiv="refresh" content="0;url=http://other.net/x">'),
            (7, "http://c.org/1", None), (8, "http://c.net/1", '<link rel="canonical" href="http://c.org/1">'), (9, "http://c.net/1", '<link href="http://a.example.com/de/1" rel="canonical">'),
            (10, "http://example.org/es/1", None), (11, "HTTP://Sub.Example.ORG/en/12", None), (12, "http://lone.net", None), (3, "http://other.net/x.html", ""),
        ],
        "page_id long, url string, html string",
    )
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect()}
    # 7 is allowed by a rule and linked (through 8 and 9) with 1, 2, 3 and 6: allow goes ahead, so nothing spreads.
    assert found[2] == ("www.other.net", "/x/", None, "allow") and found[1][2:] == ("com/de/", "block")
    assert found[4] == ("", "", None, "allow") and found[5] == ("", "", None, "allow")
    assert found[10][2:] == ("example.org/es/", "block") and found[11] == ("sub.example.org", "/en/12", "example.org/en/1", "block")
    without = {r["page_id"]: r["verdict"] for r in urls.judge(pages.where("page_id not in (7, 8, 9)")).collect()}
    assert without[2] == without[3] == without[6] == "block" and without[12] == "allow"


def test_redirect_targets(spark):
    tags = lambda *targets: "".join(f'<link rel="canonical" href="{t}">' for t in targets)
    blocked = "http://a.example.com/de/1"
    pages = spark.createDataFrame(
        [
            (1, blocked, None), (2, "http://q.net/2", tags("//a.example.com/de/1")), (3, "http://q.net/3", tags("/none", blocked)), (4, "http://q.net/x/y/4", tags("../../2")),
            (5, "http://q.net/5?k=1", tags("2")), (6, "http://q.net/6", tags("./5?k=1&amp;ref=z")), (7, "http://q.net/7", tags("mailto:a@b.c") + '<meta http-equiv="refresh" content="0"><meta http-equiv="refresh" content="0;url=5?k=1">'),
            (8, "http://r.net/8?a=1&b=2", tags(blocked)), (9, "http://r.net/9", tags("http://r.net/8?a=1&amp;b=2")), (10, "http://r.net", tags("x/../../8?a=1&#38;b=2")), (11, "http://r.net/11", tags("mailto:a@b.c", "data:,x")),
            (12, "http://r.net/12?w=1", None), (13, "http://r.net/13", tags("12")), (14, "no scheme", tags("2")),
        ],
        "page_id long, url string, html string",
    )
    found = {r["page_id"]: r["verdict"] for r in urls.judge(pages).collect()}
    assert {i for i, v in found.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8, 9, 10}


def test_components(spark):
    from brickwork.llm.components import components

    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(None, 1), (5, 5)]
    parent = {n: n for p in links for n in p if n is not None}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        if a is not None:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {n: root(n) for n in found} and set(found) >= {a for a, b in links if a is not None and a != b}


def test_empty_tables(spark):
    none = table(spark, []).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (substrings.dedup(none), windows.dedup(none), lines.decisions(none), lines.clean(none), jaccard.join(none), bpe.digests(none), decontaminate.judge(none, bench), quality.judge(none)):
        assert df.count() == 0
    model = toxicity.train(none.withColumn("toxic", F.lit(1)))
    assert toxicity.score(none, model).count() == 0 and toxicity.keep(none, model).count() == 0
    some = spark.createDataFrame([(1, "one two three")], "item_id long, text string")
    assert jaccard.representatives(none).count() == 0 and decontaminate.clean(none, some).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF_DIR)
        assert out.count() == 0 and (stage is corpus_pipeline.STAGES[-1][1] or out.columns == none.columns)
    assert pii.find(none, pii.train(pii.labelled_table(spark))).count() == 0
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, docs, SF_DIR)
        assert after.schema.simpleString() == docs.schema.simpleString(), k
        docs = corpus_pipeline.materialize(after, "test")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = by_id(corpus_pipeline.run(spark, SF_DIR))
    assert {i: r["decoded_sha256"] for i, r in found.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
    assert 0 < len(found) < spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(queries.ORACLE) <= set(entry.oracle_sql())
