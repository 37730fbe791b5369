import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from fleetops.llm.packing import pack, pieces, place, plan, sequences
from fleetops.llm.token_files import TokenFile, decode_blocks, encode_blocks, encode_file, read_token_files, write_token_files
from fleetops.llm.tokens import Encoder, default_path
from tests.llm.helpers import AWKWARD, documents

ODD = [
    "Straße İstanbul ǅ ﬁ ẞ ΑΣ ΑΣ' a's we'll ①② x²",
    "<|endoftext|> hi <|startoftext|>a<|endoftext|>b",
    "ΟΔΥΣΣΕΥΣ. a​b 👍🏽 é é \x00\x85x\x1cy ﻿ 123 a1b2 __x--",
]


def library_ids(texts):
    library = Tokenizer.from_file(default_path())
    return [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_ids_are_those_of_the_library(spark):
    rng = random.Random(0)
    texts = [t or "" for t in AWKWARD] + ODD
    texts += ["".join(rng.choice("aé'sÖ1|$ tÿŠmll\x1cªº×<>") for _ in range(120)) for _ in range(200)]
    encode = Encoder(default_path())
    for _ in range(2):  # new words, then known ones
        assert [x.tolist() for x in encode([t.encode() for t in texts])] == library_ids(texts)


def test_a_word_is_looked_up_once_for_all_its_places():
    class Counted(dict):
        lookups = 0

        def __getitem__(self, key):
            self.lookups += 1
            return super().__getitem__(key)

        def get(self, key, default=None):
            self.lookups += 1
            return super().get(key, default)

    encode = Encoder(default_path())
    encode.known = Counted()
    texts = ["one two  three\n" * 500, "", "\t two", " ", "\x1cthree\x0b\x0cÉté "]
    assert [x.tolist() for x in encode([t.encode() for t in texts])] == library_ids(texts)
    assert encode.known.lookups < 50
    assert encode([]) == [] and [len(x) for x in encode([b"", b" "])] == [0, 0]


@pytest.mark.parametrize("remembered", [0, 3])
def test_forgotten_words_are_learned_again(monkeypatch, remembered):
    monkeypatch.setattr("fleetops.llm.tokens.REMEMBERED", remembered)
    encode = Encoder(default_path())
    for text in ["a b c's", "c's d <|endoftext|>", "Éa e f g", "a b", "a ĳ \u212b"] * 2:
        assert [x.tolist() for x in encode([text.encode()])] == library_ids([text])


@pytest.mark.parametrize("high", [1, 2, 100, 50_000, 1 << 31, (1 << 32) - 1])
def test_blocks_round_trip(high):
    rng = np.random.default_rng(high)
    for n in (0, 1, 127, 128, 129, 1000):
        ids = rng.integers(0, high, n, endpoint=True).astype(np.uint32)
        ids[rng.random(n) < 0.05] = rng.integers(0, 1 << 32, dtype=np.uint64)
        starts, data = encode_blocks(ids)
        count = len(starts) - 1
        got = decode_blocks(starts, np.frombuffer(data, dtype=np.uint8), 0, count)[:n]
        assert (got == ids).all()


def test_one_document_is_read_alone():
    rng = np.random.default_rng(1)
    ids = [rng.integers(0, 49_000, n).astype(np.uint32) for n in (0, 5, 1000, 1, 300)]
    file = TokenFile(encode_file([None, 1, 2, 3, 4], ids))
    assert file.doc_ids == [None, 1, 2, 3, 4]
    for i in (4, 0, 2, 3, 1):
        assert (file.ids(i) == ids[i]).all()
    assert [(d, s, x.tolist()) for d, s, x in file.documents(at_once=200)] == [
        (d, sum(map(len, ids[:i])), x.tolist()) for i, (d, x) in enumerate(zip(file.doc_ids, ids))
    ]
    with pytest.raises(ValueError):
        TokenFile(b"something else entirely")


def test_files_hold_what_the_library_gives(spark, tmp_path):
    texts = AWKWARD + ODD
    docs = documents(spark, texts, ids=[50 - 3 * i for i in range(len(texts))])
    files = write_token_files(docs, str(tmp_path / "files"))
    got = [tuple(r) for r in read_token_files(spark, str(tmp_path / "files"), files).orderBy("doc_id").collect()]
    want, start = [], 0
    for i, ids in sorted(enumerate(library_ids(texts)), reverse=True):
        raw = np.array(ids + [2], dtype="<u4").tobytes()
        want.append((50 - 3 * i, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    assert got == want
    assert not list((tmp_path / "files").glob(".ids*"))


def test_repeated_and_null_ids_and_no_rows(spark, tmp_path):
    docs = documents(spark, ["b", "a", "a", None], ids=[1, 1, None, None])
    files = write_token_files(docs, str(tmp_path / "some"))
    got = read_token_files(spark, str(tmp_path / "some"), files).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, None, 1, 1]
    assert sum(r["n_tokens"] for r in got) == got[-1]["start"] + got[-1]["n_tokens"]
    none = write_token_files(docs.limit(0), str(tmp_path / "none"))
    assert none.count() == 0 and read_token_files(spark, str(tmp_path / "none"), none).count() == 0


def test_folders_as_users_write_them(spark, tmp_path):
    """A folder with or without its scheme, or with a space, is written and read alike; a file that is gone is an error."""
    docs = documents(spark, ["a b", "c"])
    for folder in (str(tmp_path / "plain"), f"file:{tmp_path}/one", f"file://{tmp_path}/three", str(tmp_path / "with space")):
        assert read_token_files(spark, folder, write_token_files(docs, folder)).count() == 2
    files = write_token_files(docs, str(tmp_path / "lost"))
    (tmp_path / "lost" / files.first()["file"]).unlink()
    with pytest.raises(FileNotFoundError, match="pfor"):
        read_token_files(spark, str(tmp_path / "lost"), files)


@pytest.mark.parametrize("seed", range(5))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 50, 4096])
    counts = {rng.randint(1, capacity): rng.choice([1, 2, 3, 1000, 10**9]) for _ in range(rng.randint(1, 60))}
    entries = plan(counts, capacity)
    for length, n in counts.items():
        own = sorted((first, k) for l, first, k, _, _ in entries if l == length)
        assert [f for f, _ in own] == [sum(k for _, k in own[:i]) for i in range(len(own))]
        assert sum(k for _, k in own) == n
    assert all(offset + length <= capacity for length, _, _, _, offset in entries)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(9)
    lengths = [rng.choice([3, 10, 11, 25, 40, 63, 64]) for _ in range(400)]
    rooms = []
    for length in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= length]
        room = min(fit) if fit else 64
        if fit:
            rooms.remove(room)
        rooms.append(room - length)
    entries = plan({x: lengths.count(x) for x in set(lengths)}, 64)
    assert max(s + n for _, _, n, s, _ in entries) == len(rooms)


def test_packed_documents(spark):
    texts = AWKWARD + ODD + ["repeat"] * 50
    docs = documents(spark, texts, ids=list(range(len(texts) - 1)) + [len(texts) - 2])
    cut = pieces(docs, capacity=64, keep_ids=True)
    placed = place(cut.cache(), 64)
    got = placed.collect()
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    whole = {r["sequence_id"]: r["ids"] for r in sequences(placed).collect()}
    for name, parts in by_sequence.items():
        parts.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in parts] == [sum(p["length"] for p in parts[:i]) for i in range(len(parts))]
        assert sum(r["length"] for r in parts) <= 64
        assert whole[name] == b"".join(r["ids"] for r in parts)
    want = []
    for i, ids in enumerate(library_ids(texts)):
        ids = ids + [1]
        name = min(i, len(texts) - 2)
        want += [(name, p, s, ids[s : s + 64]) for p, s in enumerate(range(0, len(ids), 64))]
    found = [(r["doc_id"], r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in got]
    assert sorted(found) == sorted(want)
    assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) and r["length"] == len(r["ids"]) // 4 for r in got)
    assert pack(docs.limit(0)).count() == 0
