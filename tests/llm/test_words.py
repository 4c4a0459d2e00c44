"""Periodic runs, importance resampling and token counts against brute force,
on tables with nulls, empty and very long texts, ties, repeated rows, columns
whose names the operators use themselves, and no rows at all."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
import sentencepiece

from proofmill.llm import periodic, piecemerge, resample
from proofmill.llm.queries import CORPUS_QUERIES, piece_model, replanted

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, n_words long, score long, rank long, place long, fit boolean, runs string, n_tokens string, `_range` int"


def table(spark, rows, path=None):
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, True, "r", "t", 5) for i, t in rows], DOCS)
    if path:
        df.write.parquet(path)
    return df


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    some = lambda n, a=400: " ".join(f"w{rng.randrange(a)}" for _ in range(n))
    out = [(i, some(rng.randint(1, 90), rng.choice([2, 3, 400]))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n\t\x0b"), (103, "one"), (5, out[5][1]), (None, some(40)), (None, "a b " * 30)]
    out += [(104, some(30) + " " + "Über Straße Ⅷ " * 9 + some(9)), (105, "same " * 5000), (106, some(9000)), (107, "y" * 60000)]
    out += [(108 + i, "ein wort\tnoch\neins " * (4 + i)) for i in range(12)]
    return out


def runs_by_hand(x, least=periodic.LEAST):
    n, out = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_runs_are_those_of_all_periods(letters):
    rng = random.Random(letters)
    for _ in range(250):
        x = [rng.randrange(letters) for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, len(x))
            x = x[:a] + x[a:a + rng.randint(1, 9)] * rng.randint(1, 5) + x[a:]
        assert periodic.runs(np.array(x, np.int64)) == runs_by_hand(x)
        assert periodic.runs(np.array(x, np.int64), 4) == runs_by_hand(x, 4)


def test_long_runs_take_little_time():
    assert periodic.runs(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    assert periodic.runs(np.arange(200_000) % 7) == [(0, 200_000, 7)]
    x = np.arange(200_000)
    x[150_000:] = x[100_000:150_000]
    assert periodic.runs(x) == [(100_000, 100_000, 50_000)]


def test_run_query(spark, rows, tmp_path):
    table(spark, rows, f"{tmp_path}/documents.parquet")
    got = Counter(map(tuple, CORPUS_QUERIES["op11_periodic_runs"](spark, str(tmp_path)).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()))
    want = Counter()
    for i, text in rows:
        words = [w.encode() for w in WORDS.findall(text or "")]
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            a = h // 10 % len(words)
            p = 1 + (len(words) - a) // (3 + h // 10 % 8)
            words = words[:a] + [words[a + (k - a) % p] for k in range(a, len(words))]
        assert words == replanted(i, [w.encode() for w in WORDS.findall(text or "")])
        found = [(0, 5000, 1)] if i == 105 else runs_by_hand(words) if len(words) < 5000 else []
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        best = min(((-n, s, q) for s, n, q in found), default=None)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        longest = (best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4
        want[(i, len(found), *longest, digest, hashlib.sha256(kept).hexdigest())] += 1
    assert got == want
    assert sum(r[1] > 0 for r in want) > 10


def features(text):
    words = re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").encode().lower())
    return words, [b" ".join(words[i:i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def test_buckets_do_not_depend_on_the_head(rows):
    texts = [resample.words_of(t) for _, t in rows]
    want = [sorted(zlib.crc32(f) % resample.BUCKETS for f in features(t)[1]) for _, t in rows]
    singles, doubles = Counter(w for t in texts for w in t), Counter(p for t in texts for p in pairwise(t))
    for most in (0, 1, 30, 10_000):
        head = resample.head_of([w for w, _ in singles.most_common(most) if len(w) <= resample.HEAD_BYTES],
                                [p for p, _ in doubles.most_common(most)])
        bucket, own = resample.buckets(texts, head)
        assert [sorted(bucket[own == i].tolist()) for i in range(len(texts))] == want


def test_draw(spark, rows, tmp_path):
    target = [(1, rows[3][1]), (2, None), (3, "Über straße ⅷ w1 w2 w3 " * 20), (3, "")]
    table(spark, rows, f"{tmp_path}/documents.parquet")
    table(spark, target, f"{tmp_path}/benchmark.parquet")
    got = Counter(map(tuple, CORPUS_QUERIES["op12_importance_resampling"](spark, str(tmp_path)).select("doc_id", "n_features", "weight", "score", "rank").collect()))
    s, t = (Counter(zlib.crc32(f) % 10_000 for _, text in side for f in features(text)[1]) for side in (rows, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    scored = []
    for i, text in rows:
        words, own = features(text)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(zlib.crc32(f) % 10_000) for f in own)
        scored.append((len(words) >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), i, len(own), weight))
    fit = sorted((x for x in scored if x[0]), key=lambda x: (-x[1], x[2] is None, x[2] or 0, x[3], x[4]))
    most = 5 * len(fit) // 100
    assert most >= 2
    want = Counter((i, n, w, sc, k if k <= most else None) for k, (_, sc, i, n, w) in enumerate(fit, 1))
    want += Counter((i, n, w, sc, None) for ok, sc, i, n, w in scored if not ok)
    assert got == want


def test_a_crowded_count_drops_only_rare_entries(spark, monkeypatch):
    monkeypatch.setattr(resample, "COUNTED", 50)
    rng = random.Random(2)
    docs = table(spark, [(i, "often here " + " ".join(f"w{rng.randrange(3000)}" for _ in range(20))) for i in range(200)]).coalesce(1)
    assert {b"often", b"here"} <= set(resample.head(docs).place)


def test_token_counts(spark, rows):
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    some = rows + [(500, "<s> </s> <unk> <0x0A> \x00 ▁ ▁▁a"), (501, "a" + " " * 4097 + "b"), (502, "ﬁ ① 梦 𝔘 é " * 40), (503, "\n\n\t  x")]
    got = Counter(map(tuple, piecemerge.token_counts(table(spark, some), piece_model(), 100).collect()))
    want = Counter()
    for i, text in some:
        n = len(library.encode(text or ""))
        want[(i, len((text or "").encode()), n, n > 100)] += 1
    assert got == want


def test_merges_in_the_order_of_the_library():
    library = sentencepiece.SentencePieceProcessor(model_proto=piece_model())
    pieces, rng = piecemerge.vocabulary(piece_model()), random.Random(5)
    names = [library.id_to_piece(i) for i in range(259, library.vocab_size())]
    texts = ["".join(rng.choice(names) for _ in range(rng.randint(1, 12))) for _ in range(1500)]
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(1, 70))) for _ in range(800)]
    texts += ["".join(rng.choice("ab \n=") for _ in range(rng.randint(1, 60))) for _ in range(800)]
    texts += [front + " " * k + end for k in range(1, 70) for front in ("", "x") for end in ("", "y", "\n")]
    texts += ["aaaa" * 3000, "=-" * 2000, "".join(rng.choice("abcdefghijklmnop") for _ in range(30_000))]
    assert piecemerge.counted(pieces, texts)[1].tolist() == [len(x) for x in library.encode(texts)]


def test_other_vocabularies_are_refused():
    with pytest.raises(Exception):
        piecemerge.Pieces(b"no model")
