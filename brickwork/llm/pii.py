"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field labels every word as other, email, ip, card or phone. It is trained here
from a small labelled table by gradient ascent and decoded by Viterbi, both in NumPy over many sentences at a time.
A run of words with one label becomes a span unless it touches a base span; base spans always stay.

Sentences end at a line feed or after a word that ends in ``.``, ``!`` or ``?``; a sentence of over 512 words is
decoded in parts that overlap. Null and empty texts have no spans. Offsets count code points, the end is exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brickwork.llm import kernels as K

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match begins inside a run of digits that has none at its start; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: The labelled table: words in double brackets carry the label before the bar.
LABELLED = (
    "write to [[email|anna.lee@example.com]] before noon",
    "mail [[email|j_doe42@mail3.example.com,]] or call [[phone|+1 (724) 555-7058]] today",
    "contact: [[email|office@example]] for the keys",
    "send it to [[email|sam@intranet]] please",
    "reach me at [[email|kim@localhost]] or in the hall",
    "the address [[email|<p.wu@example.org>]] is old",
    "call [[phone|(724) 555-7058]] after five",
    "call [[phone|(212) 555-0199]] now",
    "phone [[phone|724-555-7058]] or write",
    "phone: [[phone|212-555-0143]] ask for Max",
    "tel [[phone|+44 20 7946 0958]] in the morning",
    "fax [[phone|(030) 555-2211,]] room 12",
    "our number is [[phone|+1 (652) 555-5229]] since May",
    "ring [[phone|555-867-5309]] twice",
    "the server [[ip|42.144.35.254]] is down",
    "ping [[ip|10.0.0.1]] and [[ip|192.168.1.77]] again",
    "host [[ip|10.0.0.12:8080]] answers",
    "from [[ip|172.16.4.9/24]] to the gate",
    "route [[ip|203.0.113.7,]] then stop",
    "card [[card|4111 1111 1111 1111]] expires soon",
    "card [[card|5500-0000-0000-0004]] is lost",
    "pay with [[card|4337166598464399]] at the desk",
    "number [[card|4273 9337 4494 4324]] was used",
    "the card [[card|4041894974608795]] belongs to her",
    "the cat sat on the mat in 2021 and slept",
    "In 1999 we sold 1,250 units for 3.50 each",
    "version 2.4.1 came out on 12-05-2020 at noon",
    "see pages 12-15 and table 3 of the book",
    "The quick brown fox jumps over it",
    "a total of 100000 people voted in 2016",
    "order 84-1129 has 3 parts, see (b) or (c)",
    "rooms 101 102 103 and 104 are free",
    "on 2020-11-30 the price was 12.99 or so",
    "she scored 10 of 12 points (83 percent)",
    "commit a41d82b07cb9b9f1fcb7cce52fad63a992695314 broke it",
    "key sk-a8f3e21bc9d07 must stay secret",
    "WARNING!! READ!! THIS!! NOW!!",
    "http://www.example.com/en/450?page=2 is the page",
    "ratio 3:2 and time 10:30 on day 4",
    "de la casa y el sol con 12 flores",
    "die Katze und der Hund im Jahr 1987",
    "le chat est dans la maison depuis 3 jours",
    "follow @sunny and @rain_99 there",
    "a+b=c and x-y (see 4.2) hold",
    "line 17 of 1200, column 8, sum 4500.25",
    "the the of and to in a is that it",
    "Anders ongly therin eroundth. Thes, whou of",
    "item 000123456789012345678901234567890123 in stock",
)

#: What is known of a word's shape: attribute and number of its values.
_ATTRIBUTES = {"digits": 10, "letters": 3, "at": 2, "dots": 5, "dash": 3, "plus": 2, "round": 2, "other": 2, "edge": 2, "share": 2}
_SIZES = np.array(list(_ATTRIBUTES.values()))
_SHAPES = int(_SIZES.prod())
_COLUMNS = int(_SIZES.sum())
_STRIDE = np.r_[1, np.cumprod(_SIZES)[:-1]]
_FIRST = np.r_[0, np.cumsum(_SIZES)[:-1]]
_STATES = len(KINDS) + 1
#: Words that are decoded at a time, and on either side of them those that are decoded with them.
_LONGEST, _AROUND = 512, 32

_DIGIT = np.array([48 <= b <= 57 for b in range(256)])
_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_KNOWN = np.array([chr(b) in "@.-+()" or b >= 128 or chr(b).isalnum() for b in range(256)])
_STOP = np.array([chr(b) in ".!?" for b in range(256)])
_DIGITS_TO = np.array([0, 1, 2, 3, 4, 5, 5, 5, 5, 6, 6, 6, 7] + [8] * 7 + [9])


def shapes(buf: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """One number for the shape of each word."""
    if len(begin) == 0:
        return np.zeros(0, np.int32)

    def count(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(mask, out=total[1:])
        return total[end] - total[begin]

    digits, letters = count(_DIGIT[buf]), count(_LETTER[buf])
    size = (end - begin).astype(np.int32)
    first, last = buf[begin], buf[end - 1]
    plain = (letters == size) | ((letters == size - 1) & (_STOP[last] | (last == 44)))
    out = np.minimum(letters, 2) * int(_STRIDE[1])
    hard = np.flatnonzero(~plain)
    if len(hard):
        b, e, s = begin[hard], end[hard], size[hard]
        total = np.zeros(len(hard), np.int64)
        part = np.repeat(np.arange(len(hard)), s)
        at = buf[K.ranges(b, s.astype(np.int64))]
        n = lambda mask: np.bincount(part, mask, len(hard)).astype(np.int64)
        values = {
            "digits": _DIGITS_TO[np.minimum(digits[hard], 20)],
            "letters": np.minimum(letters[hard], 2),
            "at": n(at == 64) == 1,
            "dots": np.minimum(n(at == 46) - (last[hard] == 46), 4),
            "dash": np.minimum(n(at == 45), 2),
            "plus": first[hard] == 43,
            "round": (first[hard] == 40) | (last[hard] == 41),
            "other": n(~_KNOWN[at]) > 0,
            "edge": (first[hard] == 64) | (last[hard] == 64),
            "share": digits[hard] * 2 >= s,
        }
        for k, name in enumerate(_ATTRIBUTES):
            total += np.asarray(values[name]).astype(np.int64) * int(_STRIDE[k])
        out[hard] = total
    return out


def _known(shape: np.ndarray) -> np.ndarray:
    """Columns of the attributes of each shape."""
    return _FIRST + shape[:, None] // _STRIDE % _SIZES


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _read_label(row: str) -> tuple[list[str], list[int]]:
    found, labels = [], []
    for part in re.split(r"(\[\[.*?\]\])", row):
        label = 0
        if part.startswith("[["):
            kind, part = part[2:-2].split("|")
            label = 1 + KINDS.index(kind)
        for w in part.split():
            found.append(w)
            labels.append(label)
    return found, labels


def fit(rows: list[str], steps: int = 300, rate: float = 0.1, decay: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Weights of (neighbour, attribute, label) and of label pairs: gradient ascent, all sentences side by side."""
    read = [(w, y) for w, y in map(_read_label, rows) if w]
    longest, many = max((len(y) for _, y in read), default=0), len(read)
    real, label = np.zeros((many, longest), bool), np.zeros((many, longest), np.int64)
    known = np.zeros((many, longest, len(_SIZES)), np.int64)
    for k, (found, y) in enumerate(read):
        buf, starts = K.flat(pa.array([" ".join(found)]))
        begin, end, _ = K.words(buf, starts)
        known[k, : len(y)], real[k, : len(y)], label[k, : len(y)] = _known(shapes(buf, begin, end)), True, y
    w, pair = np.zeros((3, _COLUMNS, _STATES)), np.zeros((_STATES, _STATES))
    w2, pair2 = np.full_like(w, 1e-8), np.full_like(pair, 1e-8)
    joined = real[:, 1:]
    truth = np.eye(_STATES)[label] * real[..., None]
    pairs = np.zeros_like(pair)
    np.add.at(pairs, (label[:, :-1][joined], label[:, 1:][joined]), 1)
    for _ in range(steps if many else 0):
        score = w[1][known].sum(2)
        score[:, 1:] += w[0][known[:, :-1]].sum(2)
        score[:, :-1] += w[2][known[:, 1:]].sum(2) * joined[..., None]
        a, b = np.zeros_like(score), np.zeros_like(score)
        a[:, 0] = score[:, 0]
        for t in range(1, longest):
            step = _log_sum(a[:, t - 1, :, None] + pair, 1) + score[:, t]
            a[:, t] = np.where(real[:, t, None], step, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            step = _log_sum(pair + (score[:, t + 1] + b[:, t + 1])[:, None], 2)
            b[:, t] = np.where(real[:, t + 1, None], step, 0)
        whole = _log_sum(a[:, -1], 1)[:, None, None]
        miss = (truth - np.exp(a + b - whole)) * real[..., None]
        gw, gp = -decay * w, pairs - decay * pair
        sides = ((known[:, :-1][joined], miss[:, 1:][joined]), (known[real], miss[real]), (known[:, 1:][joined], miss[:, :-1][joined]))
        for k, (x, m) in enumerate(sides):
            np.add.at(gw[k], x.ravel(), np.repeat(m, x.shape[1], 0))
        both = np.exp(a[:, :-1, :, None] + pair + (score[:, 1:] + b[:, 1:])[:, :, None] - whole[..., None])
        gp -= (both * joined[..., None, None]).sum((0, 1))
        w2 += gw * gw
        pair2 += gp * gp
        w += rate * gw / np.sqrt(w2)
        pair += rate * gp / np.sqrt(pair2)
    return w, pair


def train(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Fit the field in a task, from the small table of labelled rows (column ``row``)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        w, pair = fit(sorted(r for r in rows["row"] if r))
        return pd.DataFrame({"w": [w.tobytes()], "pair": [pair.tobytes()]})

    model = labelled.groupBy().applyInPandas(run, "w binary, pair binary").first()
    if model is None:
        return np.zeros((3, _COLUMNS, _STATES)), np.zeros((_STATES, _STATES))
    return np.frombuffer(model["w"]).reshape(3, _COLUMNS, _STATES), np.frombuffer(model["pair"]).reshape(_STATES, _STATES)


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in LABELLED], "row string")


def emission_tables(w: np.ndarray) -> np.ndarray:
    """Score of every shape at the word before, the word itself and the word after, by label."""
    known = _known(np.arange(_SHAPES))
    return np.stack([w[k][known].sum(1) for k in range(3)]).astype(np.float32)


def viterbi(table: np.ndarray, pair: np.ndarray, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Best label of each word; ``first`` marks the words that begin a sentence. All sentences advance together."""
    n = len(shape)
    if n == 0:
        return np.zeros(0, np.uint8)
    score = table[1][shape]
    joined = ~first[1:]
    score[1:][joined] += table[0][shape[:-1][joined]]
    score[:-1][joined] += table[2][shape[1:][joined]]
    heads = np.flatnonzero(first)
    size = np.diff(np.r_[heads, n])
    order = np.argsort(-size, kind="stable")
    heads, size = heads[order], size[order]
    back, pair = np.zeros((n, _STATES), np.uint8), pair.astype(np.float32)
    best = score[heads].copy()
    last = np.zeros(len(heads), np.uint8)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # sentences of at least t words
    for t in range(1, int(size[0]) + 1):
        k = alive[t] if t < len(alive) else 0
        was = alive[t - 1]
        last[k:was] = best[k:was].argmax(1)
        if k == 0:
            break
        top, come = best[:k, 0, None] + pair[0], np.zeros((k, _STATES), np.uint8)
        for s in range(1, _STATES):
            other = best[:k, s, None] + pair[s]
            better = other > top
            top = np.where(better, other, top)
            come[better] = s
        back[heads[:k] + t] = come
        best[:k] = top + score[heads[:k] + t]
    out = np.zeros(n, np.uint8)
    at = last
    out[heads + size - 1] = at
    for t in range(int(size[0]) - 1, 0, -1):
        k = alive[t]
        # sentence j has reached word t only if it is long enough
        now = out[heads[:k] + t]
        out[heads[:k] + t - 1] = back[heads[:k] + t, now]
    return out


def labels(table: np.ndarray, pair: np.ndarray, shape: np.ndarray, first: np.ndarray) -> np.ndarray:
    """As :func:`viterbi`; a sentence of over ``_LONGEST`` words in parts that share ``_AROUND`` words with their neighbours.

    Each part is decoded with the words around it, whose labels then come from the part that they belong to.
    """
    n, heads = len(shape), np.flatnonzero(first)
    size = np.diff(np.r_[heads, n])
    if n == 0 or size.max() <= _LONGEST:
        return viterbi(table, pair, shape, first)
    parts = -(-size // _LONGEST)
    owner = np.repeat(np.arange(len(heads)), parts)
    begin = heads[owner] + K.ranges(np.zeros(len(heads), np.int64), parts) * _LONGEST
    end = np.minimum(begin + _LONGEST, (heads + size)[owner])
    low, high = np.maximum(begin - _AROUND, heads[owner]), np.minimum(end + _AROUND, (heads + size)[owner])
    at = K.ranges(low, high - low)
    new = np.zeros(len(at), bool)
    new[np.cumsum(high - low) - (high - low)] = True
    found = viterbi(table, pair, shape[at], new)
    return found[(at >= np.repeat(begin, high - low)) & (at < np.repeat(end, high - low))]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) << (k & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, found from their ``@``: the same as scanning, without the scan."""
    found, done = [], 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        tail = _DOMAIN.match(text, at) if begin < at else None
        if tail:
            found.append((begin, tail.end()))
            done = tail.end()
            at = text.find("@", done)
        else:
            at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of what the fixed patterns find."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    found.sort()
    return found


def _field_spans(buf: np.ndarray, starts: np.ndarray, table: np.ndarray, pair: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By text of the batch: first byte, kind and last byte of each run of words with one label."""
    begin, end, first_of = K.words(buf, starts)
    if len(begin) == 0:
        return {}
    head = np.zeros(len(begin) + 1, bool)
    head[first_of] = True
    lines = np.zeros(len(buf) + 1, np.int32)
    np.cumsum(buf == 10, out=lines[1:])
    head[1:-1] |= _STOP[buf[end[:-1] - 1]] | (lines[begin[1:]] > lines[end[:-1]])
    head = head[:-1]
    label = labels(table, pair, shapes(buf, begin, end), head)
    hit = np.flatnonzero(label)
    if len(hit) == 0:
        return {}
    new = np.r_[True, (hit[1:] != hit[:-1] + 1) | (label[hit[1:]] != label[hit[:-1]]) | head[hit[1:]]]
    a, b = hit[new], hit[np.r_[np.flatnonzero(new)[1:] - 1, len(hit) - 1]]
    doc = np.searchsorted(first_of, a, side="right") - 1
    out: dict[int, list[tuple[int, int, int]]] = {}
    for d, x, y, k in zip(doc.tolist(), begin[a].tolist(), end[b].tolist(), label[a].tolist()):
        while y > x + 1 and buf[y - 1] in b".,;:!?>)":
            y -= 1
        while x + 1 < y and buf[x] in b"<,;:":
            x += 1
        out.setdefault(d, []).append((x, k - 1, y))
    return out


def find(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, ``base`` and ``spans``, both arrays of (kind, start, end) by start, then kind."""
    table, pair = emission_tables(model[0]), model[1]
    span = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([docs.schema[key], T.StructField("base", span), T.StructField("spans", span)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    name = lambda rows: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in rows]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in K.slices(whole):
                buf, starts = K.flat(batch.column("text"))
                fields = _field_spans(buf, starts, table, pair)
                base, spans = [], []
                for d, value in enumerate(batch.column("text")):
                    own = base_spans(value.as_py() or "")
                    every = own
                    if d in fields:
                        raw = buf[starts[d] : starts[d + 1]]
                        place = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]  # code points before a byte
                        more = [(int(place[a - starts[d]]), k, int(place[b - starts[d]])) for a, k, b in fields[d]]
                        more = [m for m in more if all(m[2] <= o[0] or m[0] >= o[2] for o in own)]
                        every = sorted(own + more)
                    base.append(name(own))
                    spans.append(name(every))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, arrow), pa.array(spans, arrow)], names=[key, "base", "spans"])

    return docs.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)


def joined(spans: str):
    """``kind:start:end`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: str, kind: str):
    """Number of spans of one kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
