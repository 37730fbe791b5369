"""Alignment against a plain merge of byte ranges, text by text."""

from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetops.llm import alignment
from tests.llm.helpers import AWKWARD, documents, rows


@pytest.fixture(scope="module")
def libraries():
    a_path, b_path = alignment.default_paths()
    a = Tokenizer.from_file(a_path)
    a.encode_special_tokens = True
    letters = alignment.byte_of_letter()
    a_bytes = {i: bytes(letters[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if set(t) <= set(letters)}
    b = sentencepiece.SentencePieceProcessor(model_file=b_path)

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    return a, a_bytes, b, b_bytes


def spans(parts):
    out, at = [], 0
    for p in parts:
        out.append((at, at + len(p)))
        at += len(p)
    return out


def plain(text, libraries):
    """(A ids, B ids, links as places, groups) of one text."""
    a, a_bytes, b, b_bytes = libraries
    if not text:
        return [], [], [], []
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    whole = (" " + text).encode()
    if b"".join(a_bytes[i] for i in a_ids) != whole or b"".join(map(b_bytes, b_ids)) != whole:
        return [], [], [], []
    sa, sb = spans([a_bytes[i] for i in a_ids]), spans([b_bytes(i) for i in b_ids])
    links, j = [], 0
    for i, (low, high) in enumerate(sa):
        while sb[j][1] <= low:
            j += 1
        k = j
        while k < len(sb) and sb[k][0] < high:
            links.append((i, k))
            k += 1
    cuts = sorted({e for _, e in sa} & {e for _, e in sb})
    groups, low = [], 0
    for cut in cuts:
        inside = lambda s: [n for n, (x, y) in enumerate(s) if low <= x and y <= cut]  # noqa: E731, B023
        groups.append((inside(sa), inside(sb)))
        low = cut
    return a_ids, b_ids, links, groups


def brute_force(records, libraries):
    found = [(doc_id, *plain(text, libraries)) for doc_id, text in records]
    count = Counter((a[i], b[j]) for _, a, b, links, _ in found for i, j in links)
    highest = {}
    for (_, y), n in count.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for doc_id, a, b, links, groups in found:
        pairs = [(a[i], b[j]) for i, j in links]
        text = ";".join(",".join(str(a[i]) for i in x) + "|" + ",".join(str(b[j]) for j in y) for x, y in groups)
        out.append(
            (
                doc_id,
                len(a),
                len(b),
                len(groups),
                len(links),
                sum(count[p] == highest[p[1]] for p in pairs),
                sum(count[p] for p in pairs),
                sha256(text.encode()).hexdigest() if a else "",
            )
        )
    return sorted(out, key=repr)


TEXTS = [
    *AWKWARD,
    "<|endoftext|> and <s> </s> <unk> are plain text",
    "already▁shown",
    "tabs\tand\r\nlines   \n\n  end ",
    "naïve café — “quotes” 漢字かな 한국어 😀👍🏽 ͸ ~ ʼ",
    "1234567890 12.5e-3 don't we'll I'VE",
    "\x00\x01 control \x7f",
    " leading",
    "é combining, ﬁ ligature,   space, 　 wide",
    "aaaa" * 300,
    "a\u180e b\u00a0 c \u2003d e\x1c f\x85 g",
    "a\n b \n c\n  d \r\ne",
    "ends with a space ",
    "▁ and ▁word",
]


def test_equals_brute_force(spark, libraries):
    texts = TEXTS + [t and t[::-1] for t in TEXTS]
    docs = documents(spark, texts, ids=[None, 1, 1, *range(3, len(texts))])
    assert rows(alignment.align(docs)) == brute_force([(r.doc_id, r.text) for r in docs.collect()], libraries)


def test_small_lanes_and_batches(spark, libraries, testdata, monkeypatch):
    monkeypatch.setattr(alignment, "LANE", 3)
    monkeypatch.setattr(alignment, "TEXT_BYTES", 3000)
    monkeypatch.setattr(alignment, "BATCH_LINKS", 2000)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 500)
    docs = spark.read.parquet(f"{testdata}/documents.parquet").filter("length(text) < 3000 OR text IS NULL")
    records = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert rows(alignment.align(docs)) == brute_force(records, libraries)


def test_whole_table(spark, testdata, libraries):
    docs = spark.read.parquet(f"{testdata}/documents.parquet")
    got = {r.doc_id: r for r in alignment.op13_alignment(spark, testdata).collect()}
    assert len(got) == docs.count()
    for row in docs.orderBy("doc_id").collect():
        a, b, links, _ = plain(row.text, libraries) if len(row.text or "") < 2000 else (None,) * 4
        if a is not None:
            assert (got[row.doc_id].n_a, got[row.doc_id].n_b, got[row.doc_id].n_links) == (len(a), len(b), len(links))


def test_alignments(spark, libraries):
    docs = documents(spark, TEXTS)
    for row in alignment.alignments(docs).collect():
        a, b, _, groups = plain(TEXTS[row.doc_id], libraries)
        assert (row.a_ids, row.b_ids) == (a, b)
        assert (row.a_cuts, row.b_cuts) == ([x[-1] for x, _ in groups], [y[-1] for _, y in groups])


def test_long_text(spark, libraries):
    texts = ["word é " * 60_000, "x", None]
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in alignment.align(docs).collect()}
    ids = libraries[0].encode(" " + texts[0], add_special_tokens=False).ids
    assert got[0].n_a == len(ids) and got[0].n_b == len(libraries[2].encode(texts[0]))
    assert got[2].n_links == 0 and got[2].groups_sha256 == ""


def test_empty_table(spark):
    assert rows(alignment.align(documents(spark, ["a"]).limit(0))) == []


def test_ranks_are_the_librarys_ids(libraries):
    encode = alignment.ByteLevel(alignment.default_paths()[0])
    assert encode.ranked is not None
    for text in TEXTS:
        if text:
            assert encode(" " + text) == libraries[0].encode(" " + text, add_special_tokens=False).ids


def test_numbers_come_back():
    for values in (np.zeros(0, int), np.arange(70_000), np.array([0, 2**32 - 1, 5])):
        assert alignment.unsqueezed(alignment.squeezed(values)).tolist() == values.tolist()
    assert alignment.parted(alignment.joined([b"", b"ab", b"c"])) == [b"", b"ab", b"c"]
