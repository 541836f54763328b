"""Cached encoding, token files and packing against the plain library and brute force."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from runlens.llm import token_files
from runlens.llm.packing import cut, pack, pack_documents, plan_packing
from runlens.llm.token_files import decode_chunk, decode_ranks, encode_chunk, encode_ranks, read_tokens, write_tokens
from runlens.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, extra string"


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(PATH)


ENCODER = Encoder(PATH)
ODD = ["", " ", "  a", " a  b \n c", "a <|endoftext|> b", "日本語 テスト 1234", "'s it's  don't x \x1c y", "a b  c", "½ ² ٣ x", "é è\tx \r\n y", "😀 😀😀 á b"]


def plain_ids(plain, text):
    return plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ODD)
def test_odd_texts_encode_as_a_whole(plain, text):
    assert np.frombuffer(ENCODER.batch([text])[0], "<u4").tolist() == plain_ids(plain, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 '\n\t.,éß日 <|>"), max_size=60))
def test_any_text_encodes_as_a_whole(text):
    assert np.frombuffer(ENCODER.batch([text])[0], "<u4").tolist() == plain_ids(_plain(), text)


def _plain(cache=[]):  # noqa: B006
    if not cache:
        cache.append(Tokenizer.from_file(PATH))
    return cache[0]


def test_slices_and_cache_generations_change_nothing(plain, monkeypatch):
    from runlens.llm import tokens

    monkeypatch.setattr(tokens, "SLICE_CHARS", 50)
    monkeypatch.setattr(tokens, "CACHE_ENTRIES", 3)
    encoder = Encoder(PATH)
    texts = ["the quick  brown fox, jumps over the lazy dog. " * 20, "x" * 300, None, "a b"]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for b in encoder.batch(texts)]
        assert got == [plain_ids(plain, t or "") for t in texts]


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        for top in (10, 300, 70_000, 2**25, 2**32 - 1):
            ranks = rng.integers(0, top, n, dtype=np.uint32, endpoint=True)
            assert (decode_ranks(*encode_ranks(ranks), n) == ranks).all()
    control, data = encode_ranks(np.array([1, 255, 256, 65_535, 65_536], np.uint32))
    assert len(control) == 2 and len(data) == 1 + 1 + 2 + 2 + 3


def test_chunk_refuses_damage():
    content = encode_chunk(np.array([5]), np.array([3]), np.array([1, 2, 3], np.uint32), 7)
    assert decode_chunk(content + b"\n")[3] == 7
    with pytest.raises(ValueError):
        decode_chunk(b"XXXX" + content[4:])
    with pytest.raises(ValueError):
        decode_chunk(content[:-1])


def expected(rows, plain):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*plain_ids(plain, text or ""), 0], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_read_back(spark, plain, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 40)
    rows = [(9, "zz top", "x"), (3, None, "x"), (4, "", None), (7, "word " * 200, "x"), (None, "no id", "x"), (3, "again", "x"), (8, "zz top", "x")]
    folder, ranks = write_tokens(spark.createDataFrame(rows, SCHEMA), PATH)
    got = sorted((tuple(r) for r in read_tokens(spark, folder, ranks, digest=True).collect()), key=lambda r: r[1])
    order = [(None, "no id"), (3, None), (3, "again"), (4, ""), (7, "word " * 200), (8, "zz top"), (9, "zz top")]
    assert got == expected(order, plain)
    whole = {r.start: list(r.ids) for r in read_tokens(spark, folder, ranks).collect()}
    assert whole[0] == [*plain_ids(plain, "no id"), 0]
    table = [r.id for r in spark.read.parquet(ranks).orderBy("rank").collect()]
    assert table[0] == plain_ids(plain, "a word")[1]  # the most frequent id


def test_files_of_an_empty_table(spark):
    folder, ranks = write_tokens(spark.createDataFrame([], SCHEMA), PATH)
    assert read_tokens(spark, folder, ranks, digest=True).count() == 0


def test_cut_puts_the_rest_first():
    doc, piece, start, length = cut(np.array([1, 10, 25, 20]), 10)
    assert list(zip(doc, piece, start, length)) == [(0, 0, 0, 1), (1, 0, 0, 10), (2, 0, 0, 5), (2, 1, 5, 10), (2, 2, 15, 10), (3, 0, 0, 10), (3, 1, 10, 10)]


def best(items, capacity):
    items, found = sorted(items, reverse=True), [len(items)]

    def place(i, rooms):
        if len(rooms) >= found[0]:
            return
        if i == len(items):
            found[0] = len(rooms)
            return
        for j in {r: j for j, r in enumerate(rooms) if r >= items[i]}.values():
            rooms[j] -= items[i]
            place(i + 1, rooms)
            rooms[j] += items[i]
        place(i + 1, [*rooms, capacity - items[i]])

    place(0, [])
    return found[0]


def test_plan_is_valid_and_as_good_as_the_optimum_on_small_instances():
    random.seed(3)
    worse = 0
    for t in range(300):
        capacity, n = random.choice([10, 17, 30]), random.randint(1, 10)
        items = [random.randint(1 if t % 2 else capacity // 4, capacity) for _ in range(n)]
        plan = plan_packing({x: items.count(x) for x in items}, capacity)
        held, ranks = {}, {}
        for length, rank, count, first, offset in plan.placed:
            for i in range(count):
                held.setdefault(first + i, []).append((offset, length))
                ranks.setdefault(length, []).append(rank + i)
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= capacity
        assert {k: sorted(v) for k, v in ranks.items()} == {x: list(range(items.count(x))) for x in items}
        assert len(held) == plan.sequences
        worse += plan.sequences > best(items, capacity)
    assert worse <= 3


def test_reduction_fixes_exact_pairs_and_lone_pieces():
    plan = plan_packing({7: 2, 3: 1, 9: 1}, 10)
    assert plan.fixed == plan.sequences == 3


def gapless(frame, capacity):
    for _, rows in frame.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == (rows.length.cumsum() - rows.length).tolist() and rows.length.sum() <= capacity


def test_pack_spreads_and_places_every_piece(spark):
    rows = [(i, 700 if i % 3 else 1 + i % 90) for i in range(900)] + [(900, None), (901, 0), (902, 700), (902, 700)]
    got = pack(spark.createDataFrame(rows, "id long, length long"), 1500, ["id"]).toPandas()
    assert len(got) == len(rows)
    assert got[got.sequence_id.isna()].id.tolist() == [900, 901]
    full = got.dropna()
    gapless(full, 1500)
    assert full.sequence_id.nunique() == 301  # two long pieces each, the short ones beside them


def test_too_long_a_piece_fails(spark):
    with pytest.raises(Exception, match="longer than the capacity"):
        pack(spark.createDataFrame([(1, 11)], "id long, length long"), 10, ["id"]).collect()


def test_documents_in_pieces(spark, plain):
    rows = [(1, "word " * 60, "x"), (2, None, "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "c", "x")]
    got = pack_documents(spark.createDataFrame(rows, SCHEMA), PATH, 25).toPandas()
    gapless(got, 25)
    ids = [*plain_ids(plain, "word " * 60), 0]
    own = got[got.doc_id == 1].sort_values("piece")
    assert own.length.sum() == len(ids) and own.length.tolist()[1:] == [25] * (len(own) - 1)
    assert own.ids_crc32.tolist() == [zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length)]
    assert len(got) == len(own) + 4
    assert pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0
