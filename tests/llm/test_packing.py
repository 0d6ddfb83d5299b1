import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from ledgerloom.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, docs, window):
    library = Tokenizer.from_file(PATH)
    wanted = sorted((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids + [1])) for r in docs)
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at and length > 0
            at += length
        assert at <= window
    rebuilt = defaultdict(dict)
    for p in pieces:
        rebuilt[p.doc_id, p.doc_tokens].setdefault(p.start, []).append(p.ids)
    got = []
    for (doc_id, total), parts in rebuilt.items():
        copies = {len(v) for v in parts.values()}
        assert len(copies) == 1
        ids = np.frombuffer(b"".join(bytes(parts[s][0]) for s in sorted(parts)), "<u4")
        assert len(ids) == total
        got += [(doc_id, tuple(ids.tolist()))] * copies.pop()
    assert sorted(got) == wanted
    return by_sequence


def test_pieces_rebuild_documents(spark, odd_docs):
    check(op.pack(odd_docs, PATH, window=64, group=4).collect(), odd_docs.collect(), 64)


def test_whole_table_packs_tightly(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = op.pack(docs, PATH).collect()
    sequences = check(pieces, docs.collect(), 2048)
    total = sum(p.length for p in pieces)
    assert len(sequences) * 2048 <= 1.02 * total + 8 * 2048
    digests = op.op5_packing(spark, sf_dir).collect()
    assert {(p.doc_id, p.start, p.ids_crc32) for p in digests} == {(p.doc_id, p.start, zlib.crc32(p.ids)) for p in pieces}


def test_differencing_keeps_all_and_balances():
    draw = random.Random(5)
    for n, m in ((1, 1), (1, 4), (7, 3), (200, 40), (512, 170)):
        sizes = [draw.randint(1, 2047) for _ in range(n)]
        found = op.differencing(sizes, m)
        assert sorted(i for one in found for i in one) == list(range(n)) and len(found) <= m
        sums = [sum(sizes[i] for i in one) for one in found]
        assert max(sums) - min(sums + [0] * (m - len(sums))) <= max(sizes)
    assert op.windows_of([1000, 1000, 1000], 2048) == op.windows_of([1000, 1000, 1000], 2048)
    assert len(op.windows_of([1500, 1500, 1500], 2048)) == 3  # the least number, 3, holds; 2 windows cannot


def test_empty_table(no_docs):
    assert op.pack(no_docs, PATH).collect() == []
