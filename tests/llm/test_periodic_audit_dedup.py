"""Periodic runs, the filter audit and exact duplicates."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabwarden.llm import byte_transducer, exact_dedup, filter_audit, periodic_runs, queries
from tabwarden.llm.recompression import extensions, grammar, mirrored
from tests_support import SF_DIR, soup, words  # noqa: I001

SHA_EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(x, min_length=6, min_exponent=4):
    smallest, number = {}, {}
    x = np.array([number.setdefault(w, len(number)) for w in x])
    for p in range(1, len(x) // min_exponent + 1):
        edges = np.diff(np.concatenate([[0], x[:-p] == x[p:], [0]]).astype(int))
        for s, t in zip(np.flatnonzero(edges > 0).tolist(), np.flatnonzero(edges < 0).tolist(), strict=True):
            if t - s + p >= max(min_length, min_exponent * p):
                smallest.setdefault((s, t - s + p), p)
    return sorted((s, n, p) for (s, n), p in smallest.items())


def plain_cycle(w, seed):
    n = len(w)
    if seed is None or n == 0 or seed % 10:
        return w
    g = seed // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def plain_row(doc_id, text):
    seed = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    w = plain_cycle(words(text), seed)
    runs = plain_runs(w)
    dropped = {i for s, n, p in runs for i in range(s + p, s + n)}
    top = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *((top[0], top[1], top[2], 1000 * top[1] // top[2]) if top else (None,) * 4),
        hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
        hashlib.sha256(" ".join(v for i, v in enumerate(w) if i not in dropped).encode()).hexdigest(),
    )


def runs_rows(df):
    seed = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    found = periodic_runs.run_digests(periodic_runs.find_runs(df, seed=seed)).select(*columns)
    assert [t for _, t in found.dtypes[1:6]] == ["bigint"] * 5
    return sorted(map(repr, map(tuple, found.collect())))


@given(st.lists(st.integers(0, 2), min_size=2, max_size=120), st.integers(0, 60))
@settings(max_examples=150, deadline=None)
def test_extensions_equal_letter_by_letter(string, seed):
    body = string * (1 + seed % 3)
    x = np.array([50, *body, 51])
    i, j = np.triu_indices(len(x), 1)
    i, j = i[seed % 7 :: 3], j[seed % 7 :: 3]
    for levels, y in ((grammar(x, 1 + seed % 9), x), (mirrored(grammar(x, 6)), x[::-1])):
        got = extensions(levels, i, j).tolist()
        for a, b, n in zip(i.tolist(), j.tolist(), got, strict=True):
            want = 0
            while b + want < len(y) and y[a + want] == y[b + want]:
                want += 1
            assert n == want


@given(st.lists(st.lists(st.integers(0, 2), max_size=60), min_size=1, max_size=4), st.sampled_from([(6, 4), (2, 2), (9, 3)]), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_runs_equal_brute_force(texts, limits, copies):
    texts = [t * copies for t in texts]
    string, firsts = [9], []
    for k, t in enumerate(texts):
        firsts.append(len(string))
        string += [*t, 10 + k]
    got = periodic_runs.runs_in(np.array(string), max(map(len, texts)), *limits)
    want = sorted((s + f, n, p) for f, t in zip(firsts, texts, strict=True) for s, n, p in plain_runs(t, *limits))
    assert list(zip(*(a.tolist() for a in got), strict=True)) == [(s, n, p) for s, n, p in sorted(want, key=lambda r: (r[0], r[2]))]


def test_runs_of_odd_documents(spark, odd_documents, no_documents):
    rng = random.Random(3)
    long = soup(rng, 20_000, 3000)
    more = [(100, "a " * 20_000), (101, "a b c " * 5 + "x " + "a b c " * 5), (102, "a b " * 3), (103, "a b " * 4), (104, "é é é é é é"), (105, long)]
    more += [(i, soup(rng, 90, 2)) for i in range(200, 260)] + [(200, "a a a a a a"), (200, "a a a a a a")]
    df = odd_documents.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    assert runs_rows(df) == sorted(repr(plain_row(*r)) for r in df.collect())
    assert runs_rows(odd_documents) == sorted(repr(plain_row(r.doc_id, r.text)) for r in odd_documents.collect())
    assert runs_rows(no_documents) == []


def test_runs_are_kept_as_spans_and_text(spark):
    df = spark.createDataFrame([(1, "x a b a b a b a b y", 7)], "doc_id long, text string, runs int")
    row = periodic_runs.find_runs(df, carry=("doc_id", "text")).first()
    assert [tuple(r) for r in row.runs] == [(1, 8, 2)] and row.collapsed == "x a b y" and row.n_words == 10
    assert periodic_runs.find_runs(df, min_length=9).first().runs == []
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, min_exponent=1)


def test_runs_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op11_periodic_runs(spark, SF_DIR).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(plain_row(*r)) for r in docs)


def plain_measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall("[#$%&*|]", text))


@given(st.lists(st.text(alphabet="aB \t\n\r\x0b\x0c\x1f\x85\xa0é中😀#|$", max_size=60), max_size=6), st.booleans())
@settings(max_examples=200, deadline=None)
def test_transducer_equals_regular_expressions(texts, colliding):
    hashes = byte_transducer._span_hashes
    try:
        if colliding:
            byte_transducer._span_hashes = lambda data, starts, ends, owner: np.zeros(len(starts), np.uint64)
        m = byte_transducer.measure([t.encode() for t in texts])
    finally:
        byte_transducer._span_hashes = hashes
    assert list(zip(*(m[k].tolist() for k in filter_audit.MEASURES), strict=True)) == [plain_measures(t) for t in texts]


def plain_audit(documents, labels):
    """By applying every order to the rows themselves."""
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    parts = defaultdict(list)
    for doc_id, text, lang in documents:
        n_words, distinct, capitals, points, symbols = plain_measures(text or "")
        same = any((t or "") == (text or "") and i is not None and doc_id is not None and i < doc_id for i, t, _ in documents)
        fails = {"A": n_words < 100, "B": 100 * distinct < 80 * n_words, "C": 100 * capitals > 10 * points, "D": symbols > 0, "E": same}
        parts[lang or ""].append((doc_id, {k for k, v in fails.items() if v}))
    rows = []
    for part, docs in parts.items():
        removed_by = defaultdict(int)
        own = []
        for order in permutations("ABCDE"):
            left, gone = list(docs), []
            for step, letter in enumerate(order, 1):
                out = [d for d in left if letter in d[1]]
                left = [d for d in left if letter not in d[1]]
                removed_by[letter] += len(out)
                own.append((
                    part, "".join(order), step, len(left), len(out), sum(letter in d[1] for d in gone),
                    sum(d[1] == {letter} for d in docs), sum(d[0] in good for d in out), sum(d[0] in toxic for d in out), letter,
                ))
                gone += out
        rows += [(*r[:-1], removed_by[r[-1]]) for r in own]
    return rows


def test_audit_equals_applying_every_order(spark, texts):
    rng = random.Random(7)
    langs = ["en", "", None, "de"]
    docs = [(i, t, langs[i % 4]) for i, t in enumerate(texts)]
    long = " ".join(f"w{k}" for k in range(120))
    docs += [(50 + i, rng.choice([long, long + " #", long + " AB" * 300, "w w", None]), rng.choice(langs)) for i in range(60)]
    docs += [(50, docs[-60][1], "en"), (None, long, "en"), (None, long, "en"), (None, None, None), (200, "v " * 20_000, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(50, 1, 0), (None, 1, 1), (999, 1, 1)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, lang string, n int, part int")
    marks = spark.createDataFrame([(*m, "x") for m in labels], "doc_id long, quality int, toxic int, text string")
    columns = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    got = filter_audit.audit_filters(frame, marks).select(*columns)
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    # A label row without an id belongs to no document.
    want = plain_audit(docs, [m for m in labels if m[0] is not None])
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert filter_audit.audit_filters(frame.where("false"), marks).count() == 0
    unlabelled = filter_audit.audit_filters(frame, marks.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(unlabelled) == (0, 0)


@pytest.mark.parametrize("bits", [1 << 26, 1])
def test_exact_groups(spark, odd_documents, no_documents, bits):
    rng = random.Random(11)
    head = soup(rng, 200)
    more = [(100 + i, head + rng.choice([" a", " b", " c", ""])) for i in range(60)]
    more += [(200 + i, "é" if i % 2 else "ab") for i in range(6)] + [(300, "twice"), (300, "twice"), (None, "twice"), (None, None)]
    more += [(400, "x " * 20_000), (401, "x " * 20_000), (402, "x " * 19_999 + "y ")]
    df = odd_documents.select("doc_id", "text", "key").unionByName(spark.createDataFrame([(*m, 1) for m in more], "doc_id long, text string, key int"))
    rows = [(r.doc_id, r.text or "") for r in df.collect()]
    members = defaultdict(list)
    for doc_id, text in rows:
        members[text].append(doc_id)
    for everything in (True, False):
        got = exact_dedup.exact_groups(df, bitmap_bits=bits, digest_all=everything).collect()
        seen = defaultdict(list)
        for r in got:
            seen[(r.keep_id, r.group_size, r.text_sha256 or "")].append(r)
        if everything:
            digests = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in members.items()}
            assert len(got) == len(rows) and {r.text_sha256 for r in got} == set(digests)
            for digest, ids in digests.items():
                own = [r for r in got if r.text_sha256 == digest]
                top = max((i for i in ids if i is not None), default=None)
                assert sorted(map(str, (r.doc_id for r in own))) == sorted(map(str, ids))
                assert all(r.keep_id == top and r.group_size == len(ids) for r in own)
                assert [r.doc_id for r in own if r.kept] == [top]
        elif bits > 1:
            assert {r.text_sha256 is None for r in got if r.group_size > 1} == {False}
            assert any(r.text_sha256 is None for r in got)
    assert exact_dedup.exact_groups(no_documents).count() == 0
    folded = exact_dedup.exact_groups(df.where("doc_id >= 200 AND doc_id < 206"), normalised=F.lit("same")).collect()
    assert {(r.keep_id, r.group_size) for r in folded} == {(205, 6)} and sum(r.kept for r in folded) == 1


def test_exact_dedup_stays_in_the_jvm_and_moves_no_text(spark):
    found = queries.op13_exact_dedup(spark, SF_DIR)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "documents.parquet" not in plan
    assert found.where("text_sha256 IS NULL").count() == 0 and SHA_EMPTY not in plan
