import collections
import json
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from quire.llm import packing
from tests.llm.conftest import SCHEMA, make_text

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_tokenizers(tokenizer, corpus):
    encoder = packing.WordEncoder(PATH, cache_words=300)
    odd = ["it's 'll don't we'VE", "ÀÉ ß ĲŁ ſ ½²", "a\x1cb", "é́", "<|endoftext|> a", "naïve café!!! ok...", "x" * 300, "İ",
           "soft­hyphen", "\x7f del", "'", "a'", "'sa", "É'S"]
    texts = odd + [r[1] or "" for r in corpus]
    for text, ids in zip(texts, encoder.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:40]


def test_pieces_tile_documents_and_sequences(table, tokenizer, corpus):
    rows = packing.pack(table(corpus, extra=True)).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
    for doc_id, pieces in by_doc.items():
        texts = [r[1] or "" for r in corpus if r[0] == doc_id]
        ids = [*tokenizer.encode(texts[0], add_special_tokens=False).ids, 1]
        pieces.sort(key=lambda r: r.start)
        assert sum(r.length for r in pieces) == len(ids) * len(texts)
        if len(texts) == 1:
            assert [i for r in pieces for i in np.frombuffer(r.ids, "<u4")] == ids
            assert [r.start for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        assert {r.doc_tokens for r in pieces} == {len(ids)}
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *(r.length for r in pieces)])[:-1])
        total = sum(r.length for r in pieces)
        assert total <= 2048 and total & (total - 1) == 0 and {r.tier for r in pieces} == {total}


@pytest.mark.parametrize("files", [1, 8])
def test_step_groups_are_balanced_over_the_whole_result(table, files):
    rng = random.Random(files)
    docs = [(d, make_text(rng, rng.choice([20, 100, 300, 600, 3000]), 3000), "en", "src0", 0) for d in range(300)]
    rows = packing.pack(table(docs, files=files), step_tokens=16384, with_ids=False).collect()
    assert len({r.sequence_id >> packing.SEQUENCE_BITS for r in rows}) > (1 if files > 1 else 0)
    sums, tiers = collections.Counter(), collections.defaultdict(collections.Counter)
    for r in rows:
        sums[r.step_group] += r.length
        tiers[r.tier][r.step_group] += r.length
    total = sum(sums.values())
    groups = -(-total // 16384)
    assert sorted(sums) == list(range(groups)) and groups > 5
    assert all(abs(n - total / groups) <= 2 * 2048 for n in sums.values())
    for t, each in tiers.items():
        assert all(abs(each[g] - sum(each.values()) / groups) <= t for g in range(groups))
    assert all(len({r.step_group for r in rows if r.sequence_id == s}) == 1 for s in {r.sequence_id for r in rows})


def test_a_vocabulary_beyond_16_bits_is_refused(tmp_path):
    vocab = {f"w{k}</w>": k for k in range((1 << 16) + 1)}
    (tmp_path / "t.json").write_text(json.dumps({"model": {"vocab": vocab, "end_of_word_suffix": "</w>"}}))
    with pytest.raises(ValueError, match="16 bits"):
        packing.WordEncoder(str(tmp_path / "t.json"))


def test_empty_table_and_bad_tiers(table):
    assert packing.pack(table([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table([], SCHEMA), tiers=(100, 2048))
