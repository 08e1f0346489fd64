"""Packing: identifiers by the library, exact cover, and the number of sequences."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from swardshift.llm import packing, queries

from .odd import ROWS, documents, no_documents


def library_ids(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(queries.byte_vocabulary()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def wanted(rows, capacity=2048):
    """(doc_id, piece, start, length, crc) of every piece, by the library."""
    out = []
    for (own, _), ids in zip(rows, library_ids([t for _, t in rows]), strict=True):
        ids = np.array([*ids, 0], dtype="<u4")
        count = -(-len(ids) // capacity)
        ends = [len(ids) - capacity * k for k in range(count)][::-1]
        out += [(own, p, a, b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
    return sorted(out, key=str)


def check(got, rows, capacity=2048):
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == wanted(rows, capacity)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), -(-sum(r.length for r in got) // capacity)


@pytest.mark.parametrize("search", [{}, {"block_pieces": 64, "islands": 3, "epochs": 2, "rounds": 3, "crossovers": 20}])
def test_tables_documents(spark, search):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    used, least = check(packing.pack_documents(docs, queries.byte_vocabulary(), **search).collect(), rows)
    assert used <= least + 1


def test_odd_documents(spark):
    docs = documents(spark)
    check(packing.pack_documents(docs, queries.byte_vocabulary()).collect(), [(r[0], r[1]) for r in ROWS])
    assert packing.pack_documents(no_documents(spark), queries.byte_vocabulary()).collect() == []


def test_special_strings_and_boundaries(spark):
    """Special strings are their id; documents of exactly 2047, 2048, 2049 ids and an end."""
    texts = ["a<|endoftext|> b<|endoftext|", "<|endoftext|>" * 3, "x" * 100 + " " * 5000, "日本\U0001f600é\x00", "don't we'LL 's"]
    texts += [" the" * n for n in (2046, 2047, 2048, 4095, 4096, 9000)]
    rows = list(enumerate(texts))
    check(packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string"), queries.byte_vocabulary()).collect(), rows)


def test_identifiers_of_many_texts():
    rng = random.Random(2)
    signs = [32, 10, 9, 0xA0, 0x3000, 0x2028, 0x85, 0x1C, 65, 0x1F600, 0xE9, 0x301, 48, 0x661, 39, 115, 116, 60, 124]
    texts = ["".join(chr(rng.choice(signs)) for _ in range(rng.randint(0, 400))) for _ in range(400)] + [" " * 50_000, "ab" * 20_000, "\n" * 9999]
    encoder = packing.byte_level_encoder(queries.byte_vocabulary())
    assert [encoder.encode(t, allowed_special="all") for t in texts] == library_ids(texts)


def test_evolution_beats_best_fit():
    """Many pieces of three lengths, as large groups of copies give, leave gaps to best fit decreasing."""
    won = 0
    for seed in range(6):
        rng = random.Random(seed)
        lengths = [rng.choice([423, 611, 797]) for _ in range(200)] + [rng.randint(100, 1200) for _ in range(400)]
        order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
        plain = len(packing.best_fit([], [], order, lengths, 2048))
        found = packing.evolve(lengths, [], 2048, 400, seed)
        assert sorted(i for b in found.bins for i in b) == list(range(len(lengths)))
        assert max(found.fills) <= 2048 and len(found.bins) <= plain
        won += len(found.bins) < plain
    assert won >= 4


def test_crossover_keeps_injected_bins_whole():
    rng = random.Random(8)
    lengths = [rng.randint(1, 900) for _ in range(300)]
    order = list(range(300))
    a = packing.Packing(packing.best_fit([], [], order, lengths, 2048), lengths, 2048)
    b = packing.Packing(packing.best_fit([], [], order[::-1], lengths, 2048), lengths, 2048)
    for _ in range(30):
        child = packing.cross(a, b, lengths, 2048, rng)
        assert sorted(i for x in child.bins for i in x) == order and max(child.fills) <= 2048
        assert {frozenset(x) for x in b.bins} & {frozenset(x) for x in child.bins} or len(b.bins) < 3


def test_same_result_again(spark):
    rng = random.Random(6)
    rows = [(k, rng.randint(200, 900)) for k in range(2000)]
    pieces = spark.createDataFrame(rows, "key long, length long")
    once = sorted(packing.pack_pieces(pieces.repartition(3), 2048, block_pieces=300).collect())
    assert once == sorted(packing.pack_pieces(pieces.repartition(7), 2048, block_pieces=300).collect())
    fills = defaultdict(int)
    for k, b in once:
        fills[b] += dict(rows)[k]
    assert sorted(k for k, _ in once) == list(range(2000)) and max(fills.values()) <= 2048
    assert len(fills) <= -(-sum(n for _, n in rows) // 2048) + 4
