import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from helixframe.llm import cells, components, cuckoo, line_dedup, shared, simhash, substring_dedup

NONE = "doc_id bigint, text string"


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


@pytest.fixture(scope="module")
def mixed(spark):
    """Copies, near copies, shared lines and passages, one of them in a third of all documents."""
    rnd = random.Random(4)
    vocabulary = [f"w{k}" for k in range(300)]
    common = " ".join(rnd.choices(vocabulary, k=30))
    docs = []
    for d in range(240):
        body = [" ".join(rnd.choices(vocabulary, k=rnd.randint(3, 25))) for _ in range(rnd.randint(1, 6))]
        if d % 3 == 0:
            body.insert(rnd.randint(0, len(body)), common)
        docs.append((d * 7 % 1000, "\n".join(body)))
    for d in range(60):
        words = docs[d][1].split(" ")
        if d % 2:
            words[rnd.randrange(len(words))] = "changed"
        docs.append((5000 + d, " ".join(words)))
    docs += [(9000 + k, docs[0][1]) for k in range(120)]
    rnd.shuffle(docs)
    return spark.createDataFrame(docs, NONE).repartition(6)


@pytest.mark.parametrize("which", ["mixed", "odd_documents", "no_documents"])
def test_lines(request, which):
    docs = request.getfixturevalue(which)
    out, _ = line_dedup.dedup_lines(docs)
    assert sorted(((r.id, r.n_lines, r.n_dropped, r.kept) for r in out.collect()), key=key) == sorted(brute.dedup_lines(pairs(docs)), key=key)


def test_line_index_grows_and_shrinks(spark, mixed):
    first, rest = mixed.where("doc_id % 2 = 0"), mixed.where("doc_id % 2 = 1")
    one = line_dedup.LineIndex.empty(spark, 400_000).insert(shared.stored(line_dedup.line_refs(first), "t"))
    both = one.insert(shared.stored(line_dedup.line_refs(rest), "t"))
    whole = line_dedup.LineIndex.empty(spark, 400_000).insert(shared.stored(line_dedup.line_refs(mixed), "t"))
    assert both.counts.exceptAll(whole.counts).count() == whole.counts.exceptAll(both.counts).count() == 0
    undone = both.delete(rest.select("doc_id"))
    assert undone.counts.exceptAll(one.counts).count() == one.counts.exceptAll(undone.counts).count() == 0
    filters = {r.shard: [cuckoo.CuckooFilter.from_bytes(bytes(x.blob)) for x in undone.filters.where(F.col("shard") == r.shard).collect()] for r in undone.filters.select("shard").distinct().collect()}
    held = undone._shard(one.counts).toPandas()
    for shard, own in held.groupby("shard"):
        hi, lo = (own[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))
        assert np.logical_or.reduce([f.contains(hi, lo) for f in filters[shard]]).all()
    gone = undone._shard(both.counts.join(one.counts.select("hi", "lo"), ["hi", "lo"], "left_anti")).toPandas()
    said = sum(int(np.logical_or.reduce([f.contains(*(own[c].to_numpy().view(np.uint64) for c in ("hi", "lo"))) for f in filters[shard]]).sum()) for shard, own in gone.groupby("shard"))
    assert len(gone) > 100 and said < 0.05 * len(gone)


def test_later_batches_lose_lines_of_earlier_ones(spark):
    a = spark.createDataFrame([(1, "a line that is long enough\nmine alone, also long")], NONE)
    b = spark.createDataFrame([(2, "A line that is long enough\nsomething new and long")], NONE)
    _, index = line_dedup.dedup_lines(a)
    out, index = line_dedup.dedup_lines(b, index=index)
    assert out.first().kept == "something new and long"
    back = index.delete(spark.createDataFrame([(1,)], "doc_id bigint"))
    assert back.drops(line_dedup.line_refs(b)).count() == 0


def key_refs(spark, first, last, per=100):
    """References to made-up keys, ``per`` keys a document."""
    half = F.xxhash64(F.lit("k"), "id")
    return shared.stored(spark.range(first, last).select(half.alias("hi"), F.xxhash64(F.lit("l"), "id").alias("lo"), F.floor(F.col("id") / per).alias("id")), "t")


def absent(index):
    """Keys of the exact table that their shard's filter doesn't hold."""
    filters = {r.shard: cuckoo.CuckooFilter.from_bytes(bytes(r.blob)) for r in index.filters.collect()}
    held = index._shard(index.counts).toPandas()
    return sum(int((~filters[shard].contains(*(own[c].to_numpy().view(np.uint64) for c in ("hi", "lo")))).sum()) for shard, own in held.groupby("shard"))


@pytest.mark.parametrize("shard_keys", [10**7, 30_000])
def test_no_live_key_is_lost_by_deletion(spark, monkeypatch, shard_keys):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard_keys)
    one = line_dedup.LineIndex.empty(spark).insert(key_refs(spark, 0, 20_000))
    both = one.insert(key_refs(spark, 20_000, 160_000))  # the filter is too full, or shards are too few
    assert absent(one) == absent(both) == 0 and both.counts.count() == 160_000
    assert both.filters.count() == both.filters.select("shard").distinct().count() == (1 if shard_keys > 10**6 else 6)
    left = both.delete(spark.range(200, 1600))
    assert absent(left) == 0 and left.counts.count() == 20_000
    again = left.insert(shared.stored(key_refs(spark, 0, 20_000).withColumn("id", F.col("id") + 10_000), "t"))
    assert again.counts.count() == 20_000 and again.counts.where("n = 2 and owner < 200").count() == 20_000


def test_documents_held_already_are_left_out(spark):
    refs = key_refs(spark, 0, 500)
    one = line_dedup.LineIndex.empty(spark).insert(refs)
    again = one.insert(key_refs(spark, 0, 700))
    assert again.counts.count() == 700 and again.counts.where("n > 1").count() == 0 and again.refs.count() == 700


def test_blank_index(spark):
    blank = line_dedup.LineIndex.empty(spark)
    refs = key_refs(spark, 0, 10)
    assert blank.delete(spark.range(5)).refs.count() == 0 and blank.drops(refs).count() == 0 and blank.filters.count() == 0
    assert blank.delete(spark.range(5)).insert(refs).counts.count() == 10


def test_filters_decide_what_is_looked_up(spark, mixed, monkeypatch):
    """Without its marks a filter would make the second batch's keys pass for new."""
    want = sorted((r.id, r.n_dropped) for r in line_dedup.dedup_lines(mixed)[0].collect())
    monkeypatch.setattr(line_dedup, "build", lambda high, low: cuckoo.CuckooFilter.of_size(len(high)))
    monkeypatch.setattr(line_dedup, "_build", lambda key, keys: line_dedup._row(key[0].as_py(), cuckoo.CuckooFilter.of_size(keys.num_rows).to_bytes()))
    assert sorted((r.id, r.n_dropped) for r in line_dedup.dedup_lines(mixed)[0].collect()) != want


def test_common_lines_are_joined_apart(spark, mixed, monkeypatch):
    want = sorted(tuple(r) for r in line_dedup.dedup_lines(mixed)[0].collect())
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 20)
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 1)
    out, index = line_dedup.dedup_lines(mixed)
    assert sorted(tuple(r) for r in out.collect()) == want
    total = index.counts.where("n > 1").agg(F.sum("n")).first()[0]
    assert 0 < index.counts.where(F.col("n") > total // 20).count() < 20


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    high, low = (rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2))
    f = cuckoo.build(high, low)
    assert f.contains(high, low).all()
    other = [rng.integers(0, 2**63, 20_000, dtype=np.uint64) for _ in range(2)]
    assert f.contains(*other).mean() < 0.01
    f.delete(high[:5000], low[:5000])
    assert f.contains(high[5000:], low[5000:]).all() and f.contains(high[:5000], low[:5000]).mean() < 0.05
    again = cuckoo.CuckooFilter.from_bytes(f.to_bytes())
    assert (again.table == f.table).all()
    assert not cuckoo.CuckooFilter(64).insert(high, low)  # too many keys: it says so


@pytest.mark.parametrize("which", ["mixed", "odd_documents", "no_documents"])
def test_substrings(request, which, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 8_000)
    monkeypatch.setattr(substring_dedup, "SHARD_BYTES", 20_000)
    docs = request.getfixturevalue(which)
    out, _ = substring_dedup.dedup_substrings(docs)
    assert sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in out.collect()), key=key) == sorted(brute.dedup_substrings(pairs(docs)), key=key)


def test_substrings_in_batches_equal_one_batch(spark, mixed, monkeypatch):
    monkeypatch.setattr(substring_dedup, "RANGE_BYTES", 8_000)
    cut = 400
    early, index = substring_dedup.dedup_substrings(mixed.where(f"doc_id < {cut}"), index=substring_dedup.FingerprintIndex(4), update=True)
    late, index = substring_dedup.dedup_substrings(mixed.where(f"doc_id >= {cut}"), index=index, update=True)
    assert index.runs.count() == 4  # one compacted run for each shard
    want = list(brute.dedup_substrings(pairs(mixed)))
    assert sorted(tuple(r) for r in early.select("id", "n_words", "n_removed", "kept").union(late.select("id", "n_words", "n_removed", "kept")).collect()) == sorted(want)


def test_runs_round_trip_and_verify():
    rng = np.random.default_rng(1)
    high = np.sort(rng.integers(0, 2**64, 500, dtype=np.uint64))
    check = rng.integers(0, 2**16, 500, dtype=np.uint16)
    h, c = substring_dedup.unpack_run(substring_dedup.pack_run(high, check))
    assert (h == high).all() and (c == check).all()
    empty = substring_dedup.unpack_run(substring_dedup.pack_run(high[:0], check[:0]))
    assert not len(empty[0])
    wrong = check ^ np.uint16(1)  # same sort keys, other check bits: no match
    answers, merged = substring_dedup.merge_runs([(0, substring_dedup.pack_run(high, check)), (1, substring_dedup.pack_run(high, wrong))])
    assert answers == [] and len(substring_dedup.unpack_run(merged)[0]) == 1000
    answers, merged = substring_dedup.merge_runs([(0, substring_dedup.pack_run(high, check)), (1, substring_dedup.pack_run(high[10:], check[10:]))])
    assert [a[0] for a in answers] == [1] and len(substring_dedup.unpack_run(merged)[0]) == 500


@pytest.mark.parametrize("which", ["mixed", "odd_documents", "no_documents"])
def test_simhash(request, which):
    docs = request.getfixturevalue(which)
    rows = pairs(docs)
    got = [(r.id, r.fp % 2**64, r.component_id) for r in simhash.simhash_components(docs).collect()]
    fps = [(d, brute.simhash(t)) for d, t in rows]
    known = [(d, f) for d, f in fps if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(known) for b, y in known[:i] if (x ^ y).bit_count() <= 4]
    root = brute.components({d for d, _ in known}, links)
    assert sorted(got, key=key) == sorted([(d, f, root.get(d)) for d, f in fps], key=key)


def test_pigeonring_loses_no_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, k % 5, replace=False)) for k in range(3000)], np.uint64)
    for depth in (2, 3, 4):
        found = np.zeros(3000, bool)
        for start, mask in simhash.chain_keys(4, depth):
            same = (flips & np.uint64(mask)) == 0
            found |= same & simhash.close(flips, start, 4)
        assert found.all()
    far = np.array([sum(1 << int(b) for b in rng.choice(64, 5, replace=False)) for _ in range(500)], np.uint64)
    assert not any(simhash.close(far, s, 4).any() for s in range(5))
    assert (base ^ flips ^ base == flips).all()


def test_large_groups_are_cut_into_cells(spark):
    rng = np.random.default_rng(5)
    centre = 0x0123456789ABCDEF
    fps = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(64, (1500, 2))}
    rows = [(k, f - 2**64 if f >> 63 else f) for k, f in enumerate(sorted(fps))]
    edges = simhash.simhash_links(spark.createDataFrame(rows, "id bigint, fp bigint"), limit=100)
    tops = components.components(edges)
    assert tops.count() == len(rows) and tops.select("root").distinct().count() == 1
    assert edges.count() < 40 * len(rows)  # stars, not pairs


def test_cells_hold_each_pair_once(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("key"), F.col("id").alias("member"))
    dealt = cells.dealt(rows, "key", "member", 7).collect()
    met = {}
    for r in dealt:
        met.setdefault(r.cell, []).append(r)
    seen = {}
    for own in met.values():
        for i, a in enumerate(own):
            for b in own[:i]:
                if a.key == b.key and (a.chunk != b.chunk or a.chunk == a.other):
                    p = frozenset((a.member, b.member))
                    seen[p] = seen.get(p, 0) + 1
    assert len(seen) == 2 * 25 * 24 // 2 and set(seen.values()) == {1}


def test_components_of_paths_stars_and_nothing(spark):
    path = [(k, k + 1) for k in range(0, 60)]
    star = [(1000, 1000 + k) for k in range(1, 200)]
    edges = spark.createDataFrame([*path, *star, (7, 7), (60, 59)], "a bigint, b bigint")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {**{k: 0 for k in range(61)}, **{1000 + k: 1000 for k in range(200)}}
    assert components.components(edges.limit(0)).count() == 0


def test_range_numbers(spark):
    bounds = [-3, 0, 5, 5_000_000_000]
    ids = spark.createDataFrame([(v,) for v in (-9, -3, -2, 0, 1, 5, 6, 2**40, None)], "i bigint")
    got = {r.i: r.n for r in ids.select("i", shared.range_number(F.col("i"), bounds).alias("n")).collect()}
    assert {i: n for i, n in got.items() if i is not None} == {i: sum(b < i for b in bounds) for i in got if i is not None}


def test_similar_documents(spark, odd_documents, no_documents):
    rnd = random.Random(6)
    docs, want = [], {}
    for g in range(60):
        words = [f"v{rnd.randrange(4000)}" for _ in range(rnd.randint(150, 400))]
        for copy in range(4):
            own = list(words)
            if copy:
                own[rnd.randrange(len(own))] = "other"  # Jaccard of five-word shingles above 0.93
            docs.append((g * 10 + copy, " ".join(own)))
            want[g * 10 + copy] = g * 10
    half = [f"u{k}" for k in range(400)]
    docs += [(7000, " ".join(half)), (7001, " ".join(half[:200] + [f"t{k}" for k in range(200)]))]  # a third in common: not similar
    docs += [(8000 + k, docs[0][1]) for k in range(150)]
    want |= {7000: 7000, 7001: 7001} | {8000 + k: 0 for k in range(150)}
    got = {r.id: r.component_id for r in simhash.similar_components(spark.createDataFrame(docs, NONE), limit=30).collect()}
    assert got == want
    odd = [(r.id, r.component_id) for r in simhash.similar_components(odd_documents).collect()]
    assert sorted(odd, key=key) == sorted([(1, 1), (2, 2), (2, 2), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (8, 8), (9, 9), (10, 10), (-5, -5), (2**62, 2**62), (None, None), (None, None)], key=key)
    assert simhash.similar_components(no_documents).count() == 0


def test_keys_hold_their_recall():
    rng = np.random.default_rng(9)
    share = np.arccos(2 * 0.8 / 1.8) / np.pi
    flips = rng.random((4000, simhash.WIDE_BITS)) < share  # pairs right at the threshold
    for rows in (1000, 10**8):
        places = simhash.key_tables(0.8, simhash.key_bits(rows))
        assert places.shape[1] == (18 if rows == 1000 else 23)
        found = np.zeros(len(flips), bool)
        for own in places:
            found |= ~flips[:, own].any(axis=1)
        assert found.mean() >= 0.95  # keys of one fingerprint depend on each other a little


def test_wide_pigeonring_equals_the_distance():
    rng = np.random.default_rng(10)
    for share in (0.05, 0.15, 0.2, 0.25):
        flips = np.packbits(rng.random((3000, simhash.WIDE_BITS)) < share, axis=1).view(np.uint64)
        assert (simhash.ring_close(flips, 55) == np.flatnonzero(np.bitwise_count(flips).sum(axis=1) <= 55)).all()


def shingles(text, n=5):
    words = brute.WORDS.findall((text or "").translate(brute.ASCII_LOWER))
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


def pairs_around(rnd, least, most, each):
    """Pairs of 300 shingles each; from ``least`` to ``most`` of them differ."""
    docs = []
    for x in range(least, most + 1):
        for _ in range(each):
            a = [f"p{rnd.randrange(10**9)}" for _ in range(304)]
            at = rnd.randrange(4, 300 - x)
            b = a[:at] + [f"q{rnd.randrange(10**9)}" for _ in range(x - 4)] + a[at + x - 4 :]
            docs += [(len(docs), " ".join(a)), (len(docs) + 1, " ".join(b))]
    return docs


def test_similar_pairs_on_both_sides_of_the_threshold(spark):
    docs = pairs_around(random.Random(12), 22, 55, 12)  # Jaccard 0.69 to 0.86
    sets = {d: shingles(t) for d, t in docs}
    near = {d for d in sets if d % 2 and jaccard(sets[d], sets[d - 1]) >= 0.8}
    assert 100 < len(near) < len(docs) // 2 - 100
    found = {r.id for r in simhash.similar_components(spark.createDataFrame(docs, NONE)).collect() if r.component_id != r.id}
    assert not found - near  # nothing below the threshold
    assert len(found) >= 0.98 * len(near)


def test_dense_groups_are_verified(spark):
    rnd = random.Random(13)
    docs = []
    for g in range(3):  # variants of one text, each with its own passage: alike with about 0.7, some with 0.8 and more
        base = [f"g{g}w{k}" for k in range(204)]
        for _ in range(60):
            own, at, n = list(base), rnd.randrange(0, 150), rnd.choice((4, 9, 14, 20))
            own[at : at + n] = [f"v{rnd.randrange(10**9)}" for _ in range(n)]
            docs.append((len(docs), " ".join(own)))
    sets = {d: shingles(t) for d, t in docs}
    want = brute.components(sets, [(a, b) for a in sets for b in range(a) if jaccard(sets[a], sets[b]) >= 0.8])
    for limit in (20, 4096):
        got = {r.id: r.component_id for r in simhash.similar_components(spark.createDataFrame(docs, NONE), limit=limit).collect()}
        assert got == want


def test_repeated_shingles_vote_once(spark):
    rnd = random.Random(14)

    def fresh(n):
        return [f"r{rnd.randrange(10**9)}" for _ in range(n)]

    docs = []
    for k in range(0, 60, 2):  # one shingle in common, repeated: not similar
        line = fresh(5)
        docs += [(k + e, " ".join(fresh(200) + line * 40)) for e in (0, 1)]
    for k in range(60, 120, 2):  # a copy with one more line, repeated
        words, line = fresh(300), fresh(5)
        docs += [(k, " ".join(words)), (k + 1, " ".join(words + line * 20))]
    sets = {d: shingles(t) for d, t in docs}
    assert all((jaccard(sets[d], sets[d - 1]) >= 0.8) == (d > 60) for d in sets if d % 2)
    got = {r.id: r.component_id for r in simhash.similar_components(spark.createDataFrame(docs, NONE)).collect()}
    assert got == {d: d - d % 2 if d >= 60 else d for d in sets}
    alone, many = (simhash.wide_fingerprint(" ".join(x).encode(), 1) for x in (("a", "b", "c"), ("a", "b", "a", "a", "c", "a")))
    assert alone == many
