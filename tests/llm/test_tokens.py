"""Token ids, packing and token codes against the tokenizers library and plain bookkeeping."""
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pressweave.llm import queries as q
from pressweave.llm.packing import Packer, pack
from pressweave.llm.token_codes import Codes, encode_codes, read_codes, write_codes
from pressweave.llm.tokens import Encoder
from pressweave.sources.tables import shared_dir

SF = "/root/testdata/sf0.001"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ENCODERS = {p: Encoder(p, learnt_bytes=20_000) for p in (BYTE, WORD)}
PLAIN = {p: Tokenizer.from_file(p) for p in (BYTE, WORD)}


def plain(path, text):
    return np.array(PLAIN[path].encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("path", [BYTE, WORD])
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t'.,sStreé9ßÑ²«—|<>"), st.characters(codec="utf-8"))))
def test_ids_equal_the_library(path, text):
    assert ENCODERS[path].ids(text) == plain(path, text)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_known_rules_are_recognised(path):
    assert ENCODERS[path].quick is not None


def check_pieces(rows, ids_of):
    """Every id in exactly one piece, sequences gapless, lengths allowed, checksums right."""
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
        assert any(ids[r.start:r.start + r.length].tobytes() and zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
                   and len(ids) == r.doc_tokens for ids in ids_of[r.doc_id])
    padding = 0
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and all(r.sequence_length == at for r in pieces)
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert sum(r.length for r in rows) == sum(len(ids) for copies in ids_of.values() for ids in copies)
    return padding


def test_packing_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    ids_of = defaultdict(list)
    for d in docs:
        ids_of[d.doc_id].append(np.frombuffer(plain(BYTE, d.text) + b"\0\0\0\0", "<u4"))
    rows = q.op3_packing(spark, SF).collect()
    assert check_pieces(rows, ids_of) == 0
    covered = defaultdict(list)
    for r in rows:
        covered[r.doc_id].append((r.start, r.length))
    for doc_id, parts in covered.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids_of[doc_id][0])


def test_packing_of_hard_rows(nasty, no_docs):
    ids_of = defaultdict(list)
    for d in nasty.collect():
        ids_of[d.doc_id].append(np.frombuffer(plain(BYTE, d.text) + b"\0\0\0\0", "<u4"))
    rows = pack(nasty, BYTE).collect()
    assert check_pieces(rows, ids_of) == 0
    assert all(len(r.ids) == r.length for r in rows)
    assert pack(no_docs, BYTE).count() == 0


def test_long_windows_are_filled_from_shorter_tiers_and_steps_are_even():
    packer = Packer(0)
    rng = np.random.default_rng(1)
    for i in range(400):
        packer.add(i, np.arange(rng.integers(1, 1500), dtype="<u4"))
    packer.close()
    steps = defaultdict(dict)
    for row in packer.rows:
        steps[row[9]][row[5]] = row[7]
    totals = sorted(sum(s.values()) for s in steps.values())
    assert totals[len(totals) // 2] == 8192
    filled = defaultdict(set)
    for row in packer.rows:
        filled[row[5]].add(row[2])
    assert any(len(lengths) > 2 for lengths in filled.values())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1) | st.integers(0, 300), max_size=2000))
def test_codes_give_every_id_and_range(ids):
    codes = Codes(encode_codes(np.array(ids, np.uint32), [1], [len(ids)]))
    assert [codes[i] for i in range(0, len(ids), 7)] == ids[::7]
    assert codes.range(len(ids) // 3, len(ids)).tolist() == ids[len(ids) // 3:]
    assert codes.document(0).tolist() == ids and len(codes) == len(ids)


def test_code_files_of_the_table(spark):
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda d: d.doc_id)
    want, at = [], 0
    for d in docs:
        raw = plain(WORD, d.text) + b"\1\0\0\0"
        want.append((d.doc_id, at, len(raw) // 4, zlib.crc32(raw)))
        at += len(raw) // 4
    got = sorted(tuple(r) for r in q.op10_token_codes(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == want


def test_code_files_of_hard_rows_in_many_files(spark, nasty, no_docs):
    path = shared_dir(spark, "codes")
    manifest = write_codes(nasty, path, WORD, file_ids=100)
    assert manifest.count() > 4
    got = sorted(read_codes(manifest, path).collect(), key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys) and len(got) == nasty.count()
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:i]) for i in range(len(got))]
    want = sorted(zlib.crc32(plain(WORD, d.text) + b"\1\0\0\0") for d in nasty.collect())
    assert sorted(r.ids_crc32 for r in got) == want and all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    path = shared_dir(spark, "codes")
    assert read_codes(write_codes(no_docs, path, WORD), path).count() == 0
