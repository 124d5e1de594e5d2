"""Archive, repeats, packing, similarity, toxicity and the pipeline."""

import base64
import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tabwarden.llm import bwt_merge, jaccard_join, packing, repeats, token_counts, toxicity, warc_archive
from tabwarden.llm.components import component_roots
from tests_support import SF_DIR, soup, words  # noqa: I001


def test_archive_ties_nulls_and_repeated_rows(spark):
    rows = [
        (1, "u1", "same"), (2, "u2", "same"), (2, "u2", "same"), (2, "u0", "same"), (None, "u", "same"),
        (3, "u\r\n3", None), (4, None, ""), (5, "u5", "ünïcode\r\n\r\nWARC-Type: no"), (None, "n", "alone"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc_archive.archive_pages(pages).collect()
    assert len(got) == len(rows)
    for row in got:
        assert row.record_type in ("response", "revisit")
    by = defaultdict(list)
    for r in got:
        by[r.payload_digest].append(r)
    for html in ("same", "", "alone", rows[7][2]):
        raw = html.encode()
        own = by[base64.b32encode(hashlib.sha1(raw).digest()).decode()]
        ids = [r[0] for r in rows if (r[2] or "") == html]
        top = max((i for i in ids if i is not None), default=None)
        assert sorted(map(str, (r.page_id for r in own))) == sorted(map(str, ids))
        assert [r.page_id for r in own if r.record_type == "response"] == [top]
        assert all(r.refers_to == top for r in own if r.record_type == "revisit")
        assert all(r.payload_bytes == len(raw) for r in own)
    small = warc_archive.archive_pages(pages, min_bytes=5).where("record_type = 'revisit'")
    assert small.count() == 0
    assert warc_archive.archive_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize(
    "before, after, fault",
    [("x same", "x sane", "digest"), ("Length: 6", "Length: 5", "long"), ("x same", "x same+", "long")],
)
def test_records_are_read_from_their_own_bytes(spark, tmp_path, before, after, fault):
    pages = spark.createDataFrame([(1, "u1", "x same"), (2, "u2", "x same"), (3, "u3", "x")], "page_id long, url string, html string")
    restored = warc_archive.restore(warc_archive.write_archive(pages, str(tmp_path / "archive")), spark)
    assert sorted((r.page_id, r.payload_bytes) for r in warc_archive.read_records(restored).collect()) == [(1, 6), (2, 6), (3, 1)]
    broken = F.encode(F.replace(F.decode("warc", "utf-8"), F.lit(before), F.lit(after)), "utf-8")
    with pytest.raises(Exception, match=fault):
        warc_archive.read_records(restored.withColumn("warc", broken)).collect()


def test_a_record_whose_payload_is_gone_fails_the_reading(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u1", "same"), (2, "u2", "same"), (3, "u3", "x")], "page_id long, url string, html string")
    archive = warc_archive.write_archive(pages, str(tmp_path / "archive"))
    stored = warc_archive.Archive.payloads
    monkeypatch.setattr(warc_archive.Archive, "payloads", lambda self, session: stored(self, session).where("octet_length(payload) > 1"))
    with pytest.raises(Exception, match="there is no payload"):
        warc_archive.read_records(warc_archive.restore(archive, spark)).collect()


def removal(raws, length):
    starts = defaultdict(int)
    for raw in raws:
        for p in range(len(raw) - length + 1):
            starts[raw[p : p + length]] += 1
    out = []
    for raw in raws:
        covered = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if starts[raw[p : p + length]] > 1:
                covered[p : p + length] = True
        kept = np.frombuffer(raw, np.uint8)[~covered].tobytes()
        spans = int((covered[1:] & ~covered[:-1]).sum() + covered[:1].sum())
        out.append((len(raw), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("crowded", [20_000, 1])
def test_repeats_against_every_window(spark, odd_documents, texts, crowded):
    rule = repeats.RepeatRule(crowded=crowded)
    rows = odd_documents.select("doc_id", "text").collect()
    want = removal([(r.text or "").encode() for r in rows], rule.length)
    got = repeats.repeat_digests(repeats.remove_repeats(odd_documents, rule)).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(
        (str(r.doc_id), *w) for r, w in zip(rows, want, strict=True)
    )


def test_merged_transforms_equal_one_built_whole():
    rng = np.random.default_rng(3)
    blocks = [rng.integers(0, 6, 500).astype(np.uint64) for _ in range(3)]
    whole = bwt_merge.build(blocks, np.arange(500))
    parts = [bwt_merge.build([b[a:e] for b in blocks], np.arange(a, e)) for a, e in ((0, 120), (120, 130), (130, 500))]
    merged = bwt_merge.merge(bwt_merge.merge(parts[0], parts[1]), parts[2])
    assert (merged.windows == whole.windows).all() and (merged.fresh == whole.fresh).all()
    assert all((a == b).all() for a, b in zip(merged.before, whole.before, strict=True))


def test_packing_loses_nothing_and_fits(spark, odd_documents):
    rule = packing.Capacities((8, 16, 64), overhead=2, group=50)
    packed = packing.pack_documents(odd_documents, rule=rule).collect()
    tokens, bins = defaultdict(int), defaultdict(list)
    for r in packed:
        tokens[r.doc_id] += r.n_tokens
        bins[r.bin_id].append(r)
    want = defaultdict(int)
    for r in odd_documents.collect():
        if words(r.text):
            want[r.doc_id] += len(words(r.text))
    assert tokens == want
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        used = sum(r.n_tokens for r in own)
        assert own[0].bin_capacity == rule.smallest(used) and {r.bin_tokens for r in own} == {used}
        assert [r.bin_offset for r in own] == [sum(x.n_tokens for x in own[:i]) for i in range(len(own))]


def test_best_fit_is_the_plain_one():
    rng = random.Random(4)
    for _ in range(30):
        sizes = sorted((rng.randrange(1, 65) for _ in range(60)), reverse=True)
        left, contents = [], []
        for size in sizes:
            fits = [(room, -i) for i, room in enumerate(left) if room >= size]
            if fits:
                i = -min(fits)[1]
            else:
                left.append(64)
                contents.append(0)
                i = len(left) - 1
            left[i] -= size
            contents[i] += size
        mine = packing.best_fit(sizes, packing.Capacities((16, 64)), 64)[1]
        assert sorted(mine) == sorted(contents)


def partitions(sizes):
    """All ways to lay pieces into bins, as sums of the bins."""
    if not sizes:
        yield []
        return
    for rest in partitions(sizes[1:]):
        yield [sizes[0], *rest]
        for i in range(len(rest)):
            yield [*rest[:i], rest[i] + sizes[0], *rest[i + 1 :]]


def test_packing_against_every_packing():
    rng = random.Random(7)
    rule = packing.Capacities((8, 12, 20), overhead=3)
    optimal = 0
    for _ in range(60):
        sizes = [rng.randrange(1, 21) for _ in range(rng.randrange(1, 8))]
        least = min(
            sum(rule.cost(rule.smallest(s)) for s in sums) for sums in partitions(sizes) if max(sums) <= rule.lengths[-1]
        )
        bins, final = packing.pack_group(sizes, rule)
        used = [sum(s for s, b in zip(sizes, bins, strict=True) if b == i) for i in range(len(final))]
        assert final == [rule.smallest(u) for u in used]
        mine = sum(map(rule.cost, final))
        assert least <= mine
        optimal += mine == least
    assert optimal >= 45


def test_packing_is_never_dearer_than_bins_opened_alike():
    rng = random.Random(1)
    cheaper = 0
    for _ in range(300):
        rule = packing.Capacities((8, 12, 20), overhead=rng.choice([0, 1, 3]))
        sizes = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(5, 40))), reverse=True)
        alike = [sum(rule.cost(rule.smallest(c)) for c in packing.best_fit(sizes, rule, one)[1]) for one in rule.lengths]
        mine = sum(map(rule.cost, packing.pack_group(sizes, rule)[1]))
        assert mine <= min(alike)
        cheaper += mine < min(alike)
    assert cheaper


def test_a_bin_opens_with_the_least_cost_per_token():
    rng = random.Random(8)
    rule = packing.Capacities((8, 12, 20), overhead=3)
    for _ in range(200):
        coming = sorted((rng.randrange(1, 21) for _ in range(rng.randrange(0, 8))), reverse=True)
        size = rng.randrange(max(coming, default=1), 21)
        costs = []
        for capacity in rule.lengths:
            held = size
            for other in coming:
                held += other if held + other <= capacity else 0
            if size <= capacity:
                costs.append((rule.cost(rule.smallest(held)) / held, capacity))
        kinds = Counter(coming)
        assert packing.least_cost_opening(size, sorted(kinds), kinds, rule) == min(costs)[1]


def test_packing_takes_token_counts_and_an_empty_table(spark, odd_documents):
    counted = token_counts.count_tokens(odd_documents, token_counts.tokenizer_path("word_bpe_49k.json"))
    packed = packing.pack_documents(counted, F.col("n_tokens")).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"))
    want = counted.groupBy("doc_id").agg(F.sum("n_tokens").alias("n")).where("n > 0")
    assert {tuple(r) for r in packed.collect()} == {tuple(r) for r in want.collect()}
    assert packing.pack_documents(odd_documents.limit(0)).isEmpty()


def brute_components(rows, width=5):
    sets = []
    for _, text in rows:
        w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(str(d), len(s), str(least.get(find(i)) if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


@pytest.mark.parametrize("members", [4096, 3])
def test_similar_documents_against_all_pairs(spark, odd_documents, members):
    rng = random.Random(6)
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    shared = soup(rng, 55, 900)
    for group in range(6):
        base = soup(rng, rng.choice([12, 60, 150, 300]), 3000).split()
        for _ in range(7):
            text = list(base)
            for _ in range(rng.randrange(1 + len(text) // 25)):
                text[rng.randrange(len(text))] = f"e{rng.randrange(9)}"
            rows.append((100 + len(rows), " ".join(text) + (" " + shared if group % 2 else "")))
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_documents(documents, jaccard_join.JaccardRule(members=members)).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(brute_components(rows))


def test_large_regions_of_unlinked_documents_meet_in_small_parts(spark, monkeypatch):
    rng = random.Random(11)
    shared = {of: soup(rng, of, 10**9) for of in (80, 125)}
    rows = [f"{shared[of]} {soup(rng, 150 - of, 10**9)}" for of in (80, 125) for _ in range(70)]
    for at in (3, 20, 90, 120):  # near copies, one a chain of two
        changed = rows[at].split()
        changed[140] = "changed"
        rows.append(" ".join(changed))
        changed[:8] = ["start"] * 8
        rows.append(" ".join(changed))
    rows = list(enumerate(rows))
    members, compare = 16, jaccard_join.region_links

    def bounded(nodes, sets, rule):
        if len(nodes) > 2 * members:
            raise ValueError(f"{len(nodes)} members in one part")
        return compare(nodes, sets, rule)

    monkeypatch.setattr(jaccard_join, "region_links", bounded)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.similar_documents(documents, jaccard_join.JaccardRule(members=members)).collect()
    want = brute_components(rows)
    assert len({component for _, _, component in want}) == 140
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted(want)


def test_one_of_each_component_stays(spark, odd_documents, no_documents):
    left = jaccard_join.one_of_each(odd_documents)
    assert left.columns == odd_documents.columns
    ids = sorted(str(r.doc_id) for r in left.collect())
    want = brute_components([tuple(r) for r in odd_documents.select("doc_id", "text").collect()])
    assert ids == sorted(set(c if n else d for d, n, c in want))
    assert jaccard_join.one_of_each(no_documents).count() == 0


def test_components_of_chains_and_loops(spark):
    edges = [("a", "b"), ("c", "b"), ("c", "d"), ("x", "x"), ("y", "z"), ("b", "a")] + [(f"n{i:03}", f"n{i + 1:03}") for i in range(40)]
    roots = {r.a: r.b for r in component_roots(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert roots == {"b": "a", "c": "a", "d": "a", "z": "y"} | {f"n{i:03}": "n000" for i in range(1, 41)}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_toxicity_on_the_held_out_fold(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.train(documents, labels)
    scored = toxicity.score(documents, model).where(toxicity.held_out()).join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) >= 0.93 * len(scored)
    others = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    assert toxicity.choose_voters(documents, others, toxicity.ToxicityRule()) == toxicity.choose_voters(documents, labels, toxicity.ToxicityRule())


def test_toxicity_without_labels_or_rows(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, toxic int")
    model = toxicity.train(odd_documents, labels)
    assert {r.predicted for r in toxicity.score(odd_documents, model).collect()} <= {0, 1}
    assert toxicity.score(no_documents, toxicity.train(no_documents, labels)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_stages(spark):
    from tabwarden.session import persisted_copy

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs, seen = documents, {r.doc_id for r in documents.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = persisted_copy(stage(spark, docs, SF_DIR), name)
        assert docs.columns == documents.columns
        ids = [r.doc_id for r in docs.collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        seen = set(ids)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect() if words(r.text)}
