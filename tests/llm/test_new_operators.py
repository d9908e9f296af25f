"""Filter audit, hard negatives and SentencePiece coding against brute force."""

import itertools
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from panelwright.llm import filter_audit, negatives, pieces
from panelwright.llm.queries import piece_model

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n, distinct=400):
    deal = random.Random(seed)
    return " ".join(f"w{deal.randrange(distinct)}" for _ in range(n))


# Filter audit ---------------------------------------------------------------------


def audit_by_hand(docs, labels):
    """Every order applied document by document."""
    failed = []
    for i, text, lang in docs:
        t = text or ""
        words = GAP.findall(t)
        copy = i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)
        failed.append((lang or "", {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy,
        }, any(j == i and q == 1 for j, q, _ in labels if i is not None), any(j == i and x == 1 for j, _, x in labels if i is not None)))
    rows = {}
    for part in {f[0] for f in failed}:
        mine = [f for f in failed if f[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                total[name] += len(gone)
                rows[part, "".join(order), step] = [
                    len(left), len(gone), sum(f[1][name] for f in mine) - len(gone),
                    sum(f[1][name] and sum(f[1].values()) == 1 for f in mine), sum(f[2] for f in gone), sum(f[3] for f in gone)]
        for (p, order, step), row in rows.items():
            if p == part:
                row.append(total[order[step - 1]])
    return rows


@pytest.fixture(scope="module")
def audited():
    long = "Hot $ " * 150_000
    texts = [prose(1, 300), prose(1, 300), prose(2, 250) + " #", prose(3, 300, 20), "", None, "ALL CAPS", prose(4, 100), long, long,
             prose(5, 300).upper(), "é漢 " * 300, "a\x0bb\tc"]
    docs = [(k, t, lang) for k, (t, lang) in enumerate(zip(texts * 2, itertools.cycle(["en", None, "", "de", "en"])))]
    docs += [(3, texts[3], "en"), (None, texts[0], "en"), (None, None, None), (7, "another", "de")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(20)] + [(4, None, 1), (None, 1, 1), (1, 0, 0)]
    return docs, labels


def test_filter_audit_is_that_of_every_order(spark, audited):
    docs, labels = audited
    table = spark.createDataFrame([(*d, 1, "x", None) for d in docs], "doc_id long, text string, lang string, n int, part string, failed int")
    names = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, n int")
    found = filter_audit.audit(table, names).collect()
    expected = audit_by_hand(docs, labels)
    assert len(found) == len(expected) == 600 * 3
    for r in found:
        assert expected[r["part"], r["filter_order"], r["step"]] == [
            r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")]
    assert filter_audit.audit(table.limit(0), names).count() == 0
    assert {r["good_lost"] for r in filter_audit.audit(table, names.limit(0)).collect()} == {0}


def test_least_squares_gives_shapley_values():
    deal = random.Random(3)
    for m in (1, 2, 3, 5):
        value = [0, *(deal.randrange(10**12) for _ in range(2**m - 1))]
        for k, found in enumerate(filter_audit.shapley_values(value, m)):
            mean = Fraction(0)
            for order in itertools.permutations(range(m)):
                before = sum(1 << x for x in order[: order.index(k)])
                mean += Fraction(value[before | 1 << k] - value[before], math.factorial(m))
            assert found == mean


# Hard negatives -------------------------------------------------------------------


def negatives_by_hand(rows, is_anchor, positives=5, negative=5):
    valid = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.append((i, label, tuple(math.floor(256 * x) for x in v)))
    found = set()
    for i, label, v in set(valid):
        if not is_anchor(i):
            continue
        scores = sorted({(-sum(x * y for x, y in zip(v, w)), j, k == label) for j, k, w in valid if j != i})
        same = list(dict.fromkeys((s, j) for s, j, eq in scores if eq))[:positives]
        for s, j in same:
            window = dict.fromkeys((t, n) for t, n, eq in scores if not eq and 80 * -s <= 100 * -t <= 100 * -s)
            for rank, (t, n) in enumerate(list(window)[:negative], 1):
                found.add((i, j, rank, n, -s, -t))
    return found


def vector_rows(seed, n, dim, scale=1.0, labels=3):
    deal = np.random.default_rng(seed)
    base = deal.normal(size=dim)
    return [(k, int(deal.integers(labels)), [float(np.float32(x)) for x in scale * (base + 0.6 * deal.normal(size=dim))]) for k in range(n)]


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, label int, embedding array<float>, rank int, id string")
    names = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return [tuple(r) for r in negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **options).select(*names).collect()]


def test_hard_negatives_by_brute_force(spark, monkeypatch):
    odd = [
        (900, 1, None), (910, None, [1.0, 2.0]), (None, 1, [1.0, 2.0]), (920, 1, [float("nan"), 1.0]), (930, 1, [float("inf")]),
        (940, 1, []), (950, 2, [0.5]), (951, 2, [None, 1.0]),
    ]
    plain = vector_rows(1, 150, 7)
    ties = [(k + 200, r[1], r[2]) for k, r in enumerate(plain[:60])]
    for rows in (plain + odd + plain[:20] + ties, vector_rows(2, 90, 700, 30.0), [(k, k % 2, [1.0, -2.0]) for k in range(60)],
                 [(k, 1, [float(k)]) for k in range(30)], [(10, 1, [1.0]), (10, 2, [1.0]), (11, 1, [1.0]), (12, 2, [1.0])]):
        found = mined(spark, rows)
        assert len(found) == len(set(found)) and set(found) == negatives_by_hand(rows, lambda i: i % 10 == 0)
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", 28)
    rows = plain + ties
    assert set(mined(spark, rows)) == negatives_by_hand(rows, lambda i: i % 10 == 0)


def test_hard_negatives_without_rows_or_beyond_bounds(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, 1, [1.0]), (2, 0, [1.0])]) == []
    with pytest.raises(ValueError, match="56 bits"):
        mined(spark, [(10, 1, [1e30]), (11, 2, [1e30])])


def test_scores_from_residues_are_exact():
    deal = np.random.default_rng(4)
    for dim, top in ((1, 1), (64, 256), (1000, 70_000), (3, 2**27), (5000, 3)):
        a, b = deal.integers(-top, top + 1, (9, dim)), deal.integers(-top, top + 1, (11, dim))
        a[0], b[0], b[1] = top, top, -top
        primes = negatives.moduli(top * top * dim)
        assert (negatives.exact_scores(negatives.residues(a, primes), negatives.residues(b, primes), primes) == a @ b.T).all()


# SentencePiece --------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model())


def odd_texts():
    deal = random.Random(7)
    letters = " ▁\n\t\r\x00ab<>e0é漢\U0001f600　﻿{}();,'\"/*the"
    found = ["", " ", "a", " a", "  a  b ", "<s> </s> <unk> <0x0A>", "x" * 5000, " " * 300 + "a", "ab" * 3000, "lorem ipsum " * 20_000]
    found += ["".join(deal.choice(letters) for _ in range(deal.randint(0, 60))) for _ in range(400)]
    found += ["".join(chr(deal.choice([deal.randint(1, 0x2FF), deal.randint(0x3000, 0xD7FF), 0x1F600, 32, 10])) for _ in range(40)) for _ in range(200)]
    return found


def test_pieces_are_those_of_the_library(spark, library):
    texts = odd_texts()
    rows = [(k, t, "old", b"old") for k, t in enumerate(texts)] + [(3, None, None, None), (3, texts[3], "x", None), (None, "null id", "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, ids binary").repartition(3)
    for coded in (pieces.round_trip(docs, piece_model()), pieces.decode(pieces.encode(docs, piece_model()), piece_model())):
        found = coded.collect()
        assert len(found) == len(rows)
        for r in found:
            ids = library.encode(r["text"] or "", add_bos=True, add_eos=True)
            assert np.frombuffer(r["ids"], "<u4").tolist() == ids and r["decoded"] == library.decode(ids)
    assert pieces.round_trip(docs.limit(0), piece_model()).count() == 0


def test_any_ids_decode_as_in_the_library(library):
    deal = random.Random(8)
    rows = [[deal.choice([deal.randint(0, 300), deal.randrange(32_000)]) for _ in range(deal.randint(0, 12))] for _ in range(1500)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    table = pieces.pieces(piece_model())
    found = table.decode(np.array(sum(rows, []), np.uint32), offsets).to_pylist()
    assert found == [library.decode(r) for r in rows]
    assert table.decode(np.array([40_000], np.uint32), np.array([0, 1])).to_pylist() == [pieces.UNKNOWN_TEXT]


def test_missing_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert pieces.decode(df, piece_model()).first()["decoded"] == ""


def test_blocks_do_not_change_ids(library):
    table = pieces.pieces(piece_model())
    texts = odd_texts()
    joined, offsets = table.encode(pa.array(texts))
    for k in (3, 5, 100, 500):
        assert table.encode(pa.array([texts[k]]))[0].tolist() == joined[offsets[k] : offsets[k + 1]].tolist()


def test_piece_query_on_whole_documents(spark, library):
    import hashlib

    from panelwright.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_pieces"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = library.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
