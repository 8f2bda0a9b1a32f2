import random

import numpy as np
import pytest
import tiktoken

from quern.llm import bpe
from quern.llm.encode import count_tokens, encode_texts
from quern.llm.mix import mix, solve_rates
from quern.llm.split import oversized, split_text, split_texts


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def reference(encoder):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


HARD = ["", " ", "  ", "a", " a  b \n\n c\t", "it's we'll I'M", "中文。句子！", "🎉👩‍👩‍👧", "x\0y z", "<|endoftext|>", "ab" * 3000, "\r\n" * 50, "1234567890" * 30, " a  b\x1c c"]


def test_same_ids_as_the_public_library(encoder, reference):
    rng = random.Random(5)
    texts = HARD + ["".join(rng.choice(" \n\tab'sélé中日🎉  01.,-​\x00\x85") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        ids = reference.encode_ordinary(t)
        assert encoder.encode(t).tolist() == ids, repr(t)
        assert encoder.count(t) == len(ids)
    assert encoder.encode(None).tolist() == [] and encoder.count(None) == 0


def test_long_pretoken(encoder, reference):
    t = "".join(random.Random(1).choice("abcdefgh") for _ in range(60_000))
    assert encoder.encode(t).tolist() == reference.encode_ordinary(t)


def test_caches_stay_small(encoder):
    rng = random.Random(7)
    some = bpe.Encoder(bpe.read_vocabulary(bpe.DEFAULT_VOCABULARY))
    for k in range(300):  # texts without blanks, and with a NUL, are one piece each
        text = "".join(rng.choice("的一是在不了有和人这中大为上个国我以要他") for _ in range(2000)) + "\0" * (k % 2)
        assert len(some.encode(text)) == some.count(text)
    assert len(some.pieces) == len(some.counts) == 0 and sum(map(len, some.pretokens)) < 300 * 20
    pieces = bpe.Pieces(lambda x: x.encode(), most=10_000)
    for k in range(2000):
        assert pieces[f"piece {k}"] == f"piece {k}".encode()
    assert 0 < len(pieces) < 60 and pieces.held <= 10_000


def test_frames(spark, encoder):
    df = spark.createDataFrame([(1, "some text", 0), (1, None, 0), (None, "", 0)], "doc_id long, text string, ids int")
    rows = {(r.doc_id, tuple(r.ids)) for r in encode_texts(df, "doc_id", "text").collect()}
    assert rows == {(1, tuple(encoder.encode("some text").tolist())), (1, ()), (None, ())}
    assert sorted(r.n_tokens for r in count_tokens(df, "text", ["doc_id"]).collect()) == [0, 0, 2]
    assert encode_texts(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize("limit,overlap", [(40, 8), (17, 0), (5, 4), (2, 1)])
def test_pieces_cover_the_text(encoder, limit, overlap):
    rng = random.Random(limit)
    words = ["alpha", "beta,", "gamma.", "δέλτα", "中文。", "🎉🎉", "x" * 90, "\n\n", "\n", "  ", "1234567"]
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))
        raw, pieces = text.encode(), split_text(encoder, text, limit, overlap)
        if not text:
            assert pieces == []
            continue
        assert pieces[0][0] == 0 and pieces[-1][1] == len(raw)
        assert (len(pieces) > 1) == (encoder.count(text) > limit)
        for (a, b, n), nxt in zip(pieces, [*pieces[1:], None]):
            piece = raw[a:b].decode()  # never inside a character
            assert n == encoder.count(piece) and (n <= limit or limit < 6)
            if nxt:
                assert a < nxt[0] <= b < nxt[1]


def test_natural_boundaries(encoder):
    text = "\n\n".join("This is sentence one. Here is another one! And a third?" for _ in range(40))
    raw, pieces = text.encode(), split_text(encoder, text, 100, 10)
    assert all(raw[:b].endswith(b"\n\n") for _, b, _ in pieces[:-1])
    text = "One more sentence is here. " * 60
    pieces = split_text(encoder, text, 100, 10)
    assert all(text[:b].endswith(".") for _, b, _ in pieces[:-1])


def test_split_frames(spark, encoder):
    long = "word " * 3000
    df = spark.createDataFrame([(1, long, 1), (2, "short", 1), (3, None, 1), (4, "", 1), (1, long, 1)], "doc_id long, text string, piece int")
    assert sorted(r.doc_id for r in oversized(df, "doc_id", "text").collect()) == [1, 1]
    rows = split_texts(df, "doc_id", "text").collect()
    assert {r.doc_id for r in rows} == {1, 2} and max(r.n_tokens for r in rows) <= 1024
    assert all(r.piece_text.encode() == (long if r.doc_id == 1 else "short").encode()[r.start_byte : r.end_byte] for r in rows)
    assert split_texts(df.limit(0), "doc_id", "text").count() == 0


def bisect(f, low, high):
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if f(middle) < 0 else (low, middle)
    return (low + high) / 2


@pytest.mark.parametrize("weight", ["documents", "tokens"])
@pytest.mark.parametrize("total", [None, 9000.0])
def test_rates_against_a_plain_solver(spark, weight, total):
    """Nested bisection on the conditions themselves: each source's tokens, and shares times lambdas that sum to 0."""
    rng = np.random.default_rng(4)
    caps, share = {"a": 1.0, "b": 3.0, "c": 8.0}, {"a": 0.5, "b": 0.3, "c": 0.2}
    n = {s: rng.integers(1, 80, k).astype(float) for s, k in (("a", 400), ("b", 80), ("c", 15))}
    q = {s: rng.choice([0.3, 1.0, 2.5], len(n[s])) for s in n}

    def rates(s, x):
        return np.minimum(caps[s], q[s] * np.exp(np.minimum(x * (n[s] if weight == "documents" else 1), 700)))

    def dual(t):
        return {s: bisect(lambda x: (n[s] * rates(s, x)).sum() - share[s] * t, -50, 50) for s in n}

    largest = min(caps[s] * n[s].sum() / share[s] for s in n)
    t = total or bisect(lambda t: sum(share[s] * x for s, x in dual(t).items()), 1, largest * (1 - 1e-9))
    counts = spark.createDataFrame([(s, float(a), float(b), 1.0) for s in n for a, b in zip(n[s], q[s])], "source string, n double, prior double, c double")
    found, got, passes = solve_rates(counts, share, caps, total, weight)
    assert got == pytest.approx(t, rel=1e-6) and passes < 40
    for s, x in dual(t).items():
        assert rates(s, found[s]) == pytest.approx(rates(s, x), rel=1e-4, abs=1e-6)
        assert (n[s] * rates(s, found[s])).sum() == pytest.approx(share[s] * t, rel=1e-6)


def test_rates_are_tilted_by_document(spark):
    counts = spark.createDataFrame([("a", 5.0, 1.0, 50.0), ("a", 50.0, 1.0, 50.0), ("b", 5.0, 1.0, 10.0), ("b", 20.0, 1.0, 10.0)], "source string, n double, prior double, c double")
    found, total, _ = solve_rates(counts, {"a": 0.5, "b": 0.5}, {"a": 5.0, "b": 9.0})
    assert found["a"] < 0 < found["b"] and found["a"] + found["b"] == pytest.approx(0, abs=1e-9)
    assert 250 < total < 2750


def test_mixture(spark):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randint(1, 60), s, 0) for i, s in enumerate(rng.choices(["a", "b", "c", "d", None], [60, 25, 5, 10, 3], k=3000))]
    docs = spark.createDataFrame(rows + [(9999, None, "a", 0), (9998, "", "b", 0)], "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("a", 0.4, 2), ("b", 0.35, 3), ("c", 0.15, 6), ("none", 0.1, 5)], "source string, target_share double, max_repeats int")
    for more in ({}, {"weight": "tokens"}, {"total_tokens": 1e12}):
        mixture, shares = mix(docs, targets, **more)
        got = {r.source: r for r in shares.collect()}
        assert got["none"].actual_share == 0 and set(got) == {"a", "b", "c", "none"}
        for s, x in (("a", 0.4), ("b", 0.35), ("c", 0.15)):
            assert abs(got[s].actual_share - x / 0.9) < 0.003
            assert got[s].most_copies <= got[s].max_repeats
        assert mixture.where("copies < 1 or source = 'd' or source is null").count() == 0
    # beyond what the caps allow: the source that is the shortest comes whole, as often as it may
    assert max(got[s].mixed_tokens / (got[s].max_repeats * got[s].source_tokens) for s in "abc") == pytest.approx(1, abs=0.01)
    small = {r.source: r for r in mix(docs, targets, total_tokens=5000)[1].collect()}
    assert sum(r.mixed_tokens for r in small.values()) == pytest.approx(5000, rel=0.05)
    empty = mix(docs.limit(0), targets)
    assert empty[0].count() == 0 and [r.actual_share for r in empty[1].collect()] == [0.0] * 4
