import base64
import hashlib
import random
import uuid
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixframe.llm import byte_bpe, packing, token_files, tokens

ALPHABET = [" ", "  ", "\n", "\t", "a", "B", "the", "é", "é", "'s", "'S", ",", ".", "1", "²", "Σ", "İ", "日", "ß", " ", "　", "\x1c", "<|endoftext|>", "\0", "🙂"]


def reference(name):
    made = Tokenizer.from_file(P.path(name))
    made.encode_special_tokens = True
    return lambda text: made.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def bpe():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize(("name", "drops"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_parts_encode_as_the_library_does(name, drops):
    want, rnd = reference(name), random.Random(1)
    texts = ["", " ", "  a", "a  b", "\n", "a\n", "\na", *["".join(rnd.choices(ALPHABET, k=rnd.randint(1, 14))) for _ in range(1500)]]
    for limit in (10, 10_000):
        encoder = tokens.PartEncoder(tokens.LibraryWords(P.path(name), drops, limit), drops, limit)
        for _ in range(2):
            ids, at = encoder.encode(texts)
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [want(t) for t in texts]
        assert len(encoder.known) <= limit


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(), min_size=1, max_size=5))
def test_any_text_round_trips(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    model = byte_bpe.loaded(byte_bpe.RANKS, P.PATTERN)
    ids, at = model.parts.encode(texts)
    assert [model.decode(ids[a:b]).decode() for a, b in zip(at[:-1], at[1:], strict=True)] == texts


def test_vocabulary_is_reached_by_merges(bpe):
    model = byte_bpe.loaded(byte_bpe.RANKS, P.PATTERN)
    got = model.model.encode([model._chars(t) for t in model.ranks], num_threads=1)
    assert all(model.whole.get(model._chars(t)) or ids == [k] for k, (t, ids) in enumerate(zip(model.ranks, got, strict=True)))


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_byte_bpe(request, bpe, which):
    docs = request.getfixturevalue(which)
    out = byte_bpe.decode(byte_bpe.encode(docs)).collect()
    want = sorted((str(r.doc_id), np.array(bpe.encode_ordinary(r.text or ""), "<u4").tobytes(), (r.text or "").encode()) for r in docs.collect())
    assert sorted((str(r.id), bytes(r.ids), bytes(r.decoded)) for r in out) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in out)
    at_once = byte_bpe.encode(docs, decoded=True).collect()
    assert sorted((str(r.id), bytes(r.ids), bytes(r.decoded)) for r in at_once) == want


def test_ranks_must_be_complete(tmp_path):
    (tmp_path / "r").write_bytes(base64.b64encode(b"a") + b" 1\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "r"))


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_packing(request, which):
    docs = request.getfixturevalue(which)
    want = reference("byte_bpe_50k.json")
    rows = packing.pack(docs).collect()
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append(r)
        by_doc.setdefault(r.doc_id, []).append(r)
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and len(r.ids) == 4 * r.length
            at += r.length
        assert at == own[0].sequence_tokens <= 2048 and not at & (at - 1)
    expected = {}
    for r in docs.collect():
        expected.setdefault(r.doc_id, []).append([*want(r.text or ""), 1])
    assert set(by_doc) == set(expected)
    for doc, lists in expected.items():
        if len(lists) == 1:
            ids = b"".join(bytes(r.ids) for r in sorted(by_doc[doc], key=lambda r: r.start))
            assert ids == np.array(lists[0], "<u4").tobytes() and {r.doc_tokens for r in by_doc[doc]} == {len(lists[0])}
    assert sum(r.length for r in rows) == sum(len(x) for lists in expected.values() for x in lists)


def test_packer_is_exact_for_any_lengths():
    rnd = random.Random(2)
    packer, made, given_ids = packing.Packer(), [], 0
    for d in range(400):
        n = rnd.choice([1, 2, 100, 127, 128, 129, 2047, 2048, 2049, 5000, rnd.randint(1, 3000)])
        given_ids += n
        made += packer.add(d, np.arange(n, dtype=np.uint32))
        if d % 50 == 49:
            made += packer.pack()
            assert sum(n for n, _, _ in packer.pool) < 2048
    made += packer.pack(last=True)
    assert sum(len(p) for row in made for p in row) == given_ids
    sizes = [sum(map(len, row)) for row in made]
    assert all(not s & (s - 1) and s <= 2048 for s in sizes) and sum(s < 128 for s in sizes) <= 8
    assert {128, 256, 512, 1024, 2048} <= set(sizes)
    for row in made:
        for p in row:
            assert (p.ids == np.arange(p.start, p.start + len(p))).all()
    with pytest.raises(ValueError):
        packing.Packer((2048, 1000))


@pytest.mark.parametrize("tasks", [1, 16])
def test_step_groups_hold_equal_tokens(spark, tasks):
    docs = spark.createDataFrame([(k, "some words of a text " * (1 + k % 90)) for k in range(800)], "doc_id bigint, text string").repartition(tasks)
    rows = packing.pack(docs, step_tokens=8192).select("sequence_id", "sequence_tokens", "step_group").distinct().collect()
    sums = {}
    for r in rows:
        sums.setdefault((r.sequence_tokens, r.step_group), []).append(r.sequence_tokens)
    assert len({g for _, g in sums}) == len(sums)  # a group has one length
    for length in {n for n, _ in sums}:
        assert sum(sum(v) < 8192 for (n, _), v in sums.items() if n == length) <= 1
    assert max(map(sum, sums.values())) == 8192


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700), st.sampled_from([0, 9, 20, 31]), st.sampled_from([8, 16, 100, 256]))
def test_blocks_round_trip(values, shift, block):
    ids = np.array(values, np.uint64).astype(np.uint32) >> np.uint32(shift)
    data, starts = token_files.encode_blocks(ids, block)
    assert (token_files.decode_blocks(data, starts, len(ids), block) == ids).all()
    image = token_files.write_segment([5, None], np.array([len(ids), 0]), ids, block)
    docs, sizes, back = token_files.read_segment(image)
    assert docs == [5, None] and sizes.tolist() == [len(ids), 0] and (back == ids).all()
    for k in range(-(-len(ids) // block)):
        assert (token_files.read_block(image, k) == ids[k * block : (k + 1) * block]).all()


def test_exceptions_keep_blocks_narrow():
    ids = np.tile(np.arange(16, dtype=np.uint32), 160)
    ids[::100] = 40_000
    data, _ = token_files.encode_blocks(ids)
    assert len(data) < len(ids)  # four bits an id, not sixteen


@pytest.mark.parametrize("which", ["odd_documents", "no_documents"])
def test_token_files(request, spark, scratch, which):
    docs = request.getfixturevalue(which)
    want = reference("word_bpe_49k.json")
    to = f"{scratch}/tokens-{uuid.uuid4().hex}"
    token_files.write_tokens(docs, to, segment_ids=5000)
    got = sorted(((r.start, r.doc_id, r.n_tokens, bytes(r.ids)) for r in token_files.read_tokens(spark, to).collect()), key=lambda r: r[0])
    at, expected = 0, []
    for d, t in sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*want(t or ""), 1]
        expected.append((at, d, len(ids), np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert got == expected


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        token_files.read_segment(b"x" * 64)


def test_queries_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = reference("word_bpe_49k.json")
    at = 0
    rows = {r.doc_id: r for r in token_files.op7(spark, sf).collect()}
    for d in sorted(docs):
        ids = np.array([*want(docs[d]), 1], "<u4").tobytes()
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += len(ids) // 4
    for r in byte_bpe.op10(spark, sf).collect():
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    pieces = packing.op6(spark, sf).collect()
    assert {p.doc_id for p in pieces} == set(docs) and "ids_crc32" in pieces[0].asDict()
