import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foldsmith.llm import rans
from foldsmith.session import scratch_path

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts):
    tok = Tokenizer.from_file(PATH)
    return [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_word_encoder_equals_the_library():
    texts = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\n b c", "x  y  z", "it's we'll  'tis", "don't, stop.** now", "<|endoftext|> a <|endoftext|>b", "  é漢 字,\t\t q", "a   b    c\r\n d", "12 3a4 b5, c?!", "\x1c a \x1f b", "a \u00a0b \u3000 c \u2003",  "Ünï çodé's,"] * 2
    enc = rans.WordEncoder(PATH, 2)
    ids, lens = enc.encode(texts)
    cuts = np.cumsum(lens)
    assert [ids[b - n : b].tolist() for b, n in zip(cuts, lens)] == plain(texts)


def test_blocks_round_trip():
    rnd = np.random.default_rng(1)
    blocks = [rnd.zipf(1.3, n).clip(0, 999).astype(np.uint32) for n in (1, 5, 255, 256, 257, 70000, 3)]
    counts = np.bincount(np.concatenate(blocks), minlength=1000)
    for bits in (12, 18, 24):
        freq = rans.quantise(counts, bits)
        assert int(freq.sum()) == 1 << bits and ((freq > 0) == (counts > 0)).all()
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        coded = rans.encode_blocks(blocks, freq, cum, bits)
        slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        back = rans.decode_blocks([(*c, len(b)) for c, b in zip(coded, blocks)], freq, cum, slots, bits)
        assert all((a == b).all() for a, b in zip(back, blocks))
        one = rans.decode_blocks([(*coded[5], len(blocks[5]))], freq, cum, slots, bits)  # any block alone
        assert (one[0] == blocks[5]).all()


def test_files_against_the_library(spark, odd):
    rows = sorted(((r.doc_id, r.text or "") for r in odd.select("doc_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want, start = [], 0
    for (who, _), ids in zip(rows, plain([t for _, t in rows])):
        want.append((who, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = rans.token_digest(odd, PATH)
    assert [tuple(r) for r in sorted(got.collect(), key=lambda r: r.start)] == want


def test_empty_and_damage(spark, odd, empty):
    assert rans.token_digest(empty, PATH).collect() == []
    path = scratch_path(spark, "t")
    rans.write_tokens(odd, path, PATH)
    assert len(rans.read_tokens(spark, path).collect()) == odd.count()
    blocks = spark.createDataFrame(spark.read.parquet(f"{path}/blocks").collect(), rans.CODED)
    broken = scratch_path(spark, "t")
    blocks.withColumn("ids_crc32", blocks.ids_crc32 + 1).write.parquet(f"{broken}/blocks")
    for t in ("table", "manifest"):
        spark.read.parquet(f"{path}/{t}").write.parquet(f"{broken}/{t}")
    with pytest.raises(Exception, match="checksum"):
        rans.read_tokens(spark, broken).collect()
