import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest_llm import docs_of
from tokenizers import Tokenizer

from cohortlens.llm import token_files as op, wavelet
from cohortlens.llm.wavelet import WaveletMatrix, build

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("n,bits", [(0, 3), (1, 1), (513, 5), (5000, 16)])
def test_wavelet_matrix(n, bits):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 1 << bits, n).astype(np.uint32) % 37
    m = WaveletMatrix(build(ids, bits, [5, None], [n // 2, n - n // 2]))
    assert m.tokens().tolist() == ids.tolist() and m.keys == [5, None] and m.counts.sum() == n
    assert [m.access(i) for i in range(0, n, 7)] == ids[::7].tolist()
    for token in (0, 3, 36, 1 << 20):
        for a, b in ((0, n), (n // 3, 2 * n // 3)):
            places = [i for i in range(a, b) if ids[i] == token]
            assert m.count(token, a, b) == len(places) and m.occurrences(token, a, b) == places


def test_wavelet_matrix_of_several_blocks(monkeypatch):
    ids = np.random.default_rng(4).integers(0, 1 << 9, 5000).astype(np.uint16)
    whole = build(ids, 9)
    monkeypatch.setattr(wavelet, "BLOCK", 384)
    assert build(ids, 9) == whole
    assert WaveletMatrix(whole).tokens().tolist() == ids.tolist()


def test_chunks_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(op, "CACHED_CHUNKS", 3000)
    with open(FILE, encoding="utf-8") as file:
        encoder = op.Encoder(file.read())
    rng = random.Random(1)
    parts = [*"abz AB.'’,!?-_<|>09é ÉİıſKÅß\x1c\x1f\x85  ́̈ΣσςΑ\n\t\r\x0b\x0c𝔄中文ﬁ½²\x00\x7f", "'s", "'LL", "<|endoftext|>", "th", " the ", "ing", "zzz" * 700]
    plain = [p for p in parts if encoder.plain(p)]
    texts = ["".join(rng.choices(rng.choice((parts, plain)), k=rng.randint(0, 14))) for _ in range(6000)]
    assert encoder.by_chunk and 5000 > sum(map(encoder.plain, texts)) > 2000
    for i in range(0, len(texts), 500):
        ids, counts = encoder.encode(pa.array(texts[i:i + 500]))
        got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [encoder.whole(t).tolist() for t in texts[i:i + 500]]


def test_other_files_are_encoded_whole(spark, tmp_path):
    file = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Two  words", "<|endoftext|> x", None]
    op.write_shards(docs_of(spark, texts), file, str(tmp_path / "shards"))
    tokenizer = Tokenizer.from_file(file)
    got = {r.doc_id: r.ids_crc32 for r in op.read_texts(spark, str(tmp_path / "shards")).collect()}
    for i, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, op.END_ID], dtype="<u4")
        assert got[i] == zlib.crc32(ids.tobytes())


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "SHARD_TOKENS", 50)
    monkeypatch.setattr(op, "PARTITION_BYTES", 400)
    texts = ["Hello there.", None, "", "word " * 300, "çé <|endoftext|> x", *(f"text {i} of some" for i in range(40))]
    docs = docs_of(spark, texts).unionByName(docs_of(spark, ["again"])).withColumnsRenamed({"lang": "part", "source": "number"})
    op.write_shards(docs, FILE, str(tmp_path / "shards"))
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op.read_texts(spark, str(tmp_path / "shards")).collect())
    tokenizer, at, want = Tokenizer.from_file(FILE), 0, []
    for key, text in sorted([*((i, t or "") for i, t in enumerate(texts)), (0, "again")]):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, op.END_ID], dtype="<u4")
        want.append((key, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    assert spark.read.parquet(str(tmp_path / "shards")).count() > 5


def test_empty_table(spark, tmp_path):
    op.write_shards(docs_of(spark, []), FILE, str(tmp_path / "none"))
    assert op.read_texts(spark, str(tmp_path / "none")).count() == 0


def test_each_distinct_chunk_is_looked_up_once():
    class Counting(dict):
        asked = 0

        def __contains__(self, key):
            Counting.asked += 1
            return super().__contains__(key)

        def __getitem__(self, key):
            Counting.asked += 1
            return super().__getitem__(key)

        def get(self, *args):
            Counting.asked += 1
            return super().get(*args)

    with open(FILE, encoding="utf-8") as file:
        encoder = op.Encoder(file.read())
    encoder.known = Counting()
    texts = ["one two, one Three", "two four one"]
    found = [encoder.encode(pa.array([t]))[0].tolist() for t in texts]
    assert Counting.asked == 3 + 3
    assert found == [Tokenizer.from_file(FILE).encode(t, add_special_tokens=False).ids for t in texts]


def test_chunks_that_stand_once_are_not_remembered():
    with open(FILE, encoding="utf-8") as file:
        encoder = op.Encoder(file.read())
    tokenizer = Tokenizer.from_file(FILE)
    for i in range(3):
        texts = [f"often seen, once{chr(97 + i)}{chr(97 + j)} again" for j in range(20)]
        ids, counts = encoder.encode(pa.array(texts))
        got = [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        assert set(encoder.known) == {"often", "seen,", "again"}
        assert len(encoder.starts) == len(encoder.counts) == 3 and len(encoder.ids) == encoder.counts.sum()


def test_large_partition_is_encoded_in_bounded_memory():
    """What a fresh process holds after each slice of 24 MB of ever new words: some 370 MB more than at its start when all were remembered, 95 now."""
    code = f'''
import re, sys
sys.path.insert(0, {str(Path(op.__file__).resolve().parents[2])!r})
import numpy as np, pyarrow as pa
from cohortlens.llm import token_files as op

def held():
    return sum(map(int, re.findall(r"(?:Anonymous|Pss_Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

rng = np.random.default_rng(1)
encoder = op.Encoder(open({FILE!r}, encoding="utf-8").read())
before = most = held()
for _ in range(-(-(24 << 20) // op.SLICE_BYTES)):
    letters = rng.integers(97, 123, op.SLICE_BYTES, dtype=np.uint8)
    letters[::9] = 32
    encoder.encode(pa.array([letters.tobytes().decode()]))
    most = max(most, held())
print(most - before)
'''
    found = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=300).stdout
    assert int(found) < 220


def test_shards_lie_in_row_groups_of_some_megabytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op, "SHARD_TOKENS", 1 << 18)
    monkeypatch.setattr(op, "SHARD_OPTIONS", getattr(op, "SHARD_OPTIONS", {}) | {"parquet.block.size": 1 << 20}, raising=False)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(20_000)) for _ in range(50)]
    op.write_shards(docs_of(spark, texts), FILE, str(tmp_path / "shards"))
    groups = [pq.ParquetFile(f).metadata for f in (tmp_path / "shards").glob("*.parquet")]
    sizes = [(m.row_group(i).num_rows, m.row_group(i).total_byte_size) for m in groups for i in range(m.num_row_groups)]
    assert max(n for n, _ in sizes) <= 4 < sum(n for n, _ in sizes)
