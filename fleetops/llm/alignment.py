"""Alignment of two tokenizers over whole texts by lockstep merging.

The tokens of a text by tokenizer A and those by tokenizer B cut the same bytes in two ways. All documents of a batch are
merged at once: one vector holds for each of them the token that A and the token that B stand at. In each step every
document links its two tokens, which overlap, then steps on in A, B or both, by which token ends first; where both end a
cut is noted, and documents that are done leave the vector. A long document takes part with several such pointers, one
for each LANE tokens of B, so that it does not keep the others waiting: a pair is linked by the lane of its B token.

How often an id pair is linked is counted over all documents. A batch sends its different pairs, not its links, to the
part of their B id, where they are summed into one table; each part streams the batches past that table and answers with
the counts, and the answers come back to the batch, which holds its documents' pairs as compressed numbers.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetops.llm.runtime import partitions, process_cache, stored
from fleetops.llm.tokens import slices
from fleetops.llm.words import mix64

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
REMEMBERED = 300_000  # words in each of the two generations that a worker remembers
LANE = 256  # tokens of B for each pointer pair
TEXT_BYTES = 1 << 20  # texts that are merged together
BATCH_LINKS = 2_000_000  # a batch is closed at the document that reaches so many links
HELD_PAIRS = 4_000_000  # pairs that a part takes in before it adds them up


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(A_FILE), public_tokenizers.path(B_FILE)


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain}
    shown.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return shown


# Characters that all versions of Unicode in use class alike; other texts are cut by the file's own library.
SETTLED = re.compile("[^\t\n\r -~¡-ͯЀ-ԣḀ-ỿ‐-‧‰-⁞€ぁ-ゖァ-ヺ一-龥가-힣]")
EDGE = re.compile("[\\s\u180e]")  # white space by any version of Unicode
# Fixed value: how byte-level vocabularies of this kind cut a text before merging.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """Ids by a byte-level vocabulary file, and the bytes of each id.

    Where the file's merges make its ids in order, ids are ranks, and texts of settled characters are encoded by ranks;
    other files and texts by the tokenizers library. Special tokens are never recognised.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        byte_of = byte_of_letter()
        special = {t["id"] for t in shape.get("added_tokens") or ()}
        vocabulary = shape["model"]["vocab"]
        size = max([*vocabulary.values(), *special], default=-1) + 1
        self.bytes = [b""] * size
        for token, i in vocabulary.items():
            if i not in special:
                self.bytes[i] = bytes(byte_of[c] for c in token)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in shape["model"]["merges"]]
        made = [vocabulary.get(a + b) for a, b in merges]
        cut = shape.get("pre_tokenizer") or {}
        ordered = made == list(range(256, 256 + len(made))) and sorted(map(len, self.bytes[:256])) == [1] * 256
        usual = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.ranked = None
        if ordered and usual and not shape.get("normalizer") and not shape["model"].get("ignore_merges"):
            import tiktoken

            ranks = {b: i for i, b in enumerate(self.bytes) if b}
            self.ranked = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if self.ranked is not None and not SETTLED.search(text):
            return self.ranked.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids by a sentence-piece model, which puts a space before each text, and the bytes of each id."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.bytes = []
        # Without pieces that go on behind a word's end, a text's ids are those of its words.
        self.by_word = True
        for i in range(self.library.get_piece_size()):
            piece = self.library.id_to_piece(i)
            byte = re.fullmatch("<0x([0-9A-Fa-f]{2})>", piece) if self.library.is_byte(i) else None
            self.bytes.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
            self.by_word &= "▁" not in piece.lstrip("▁")

    def __call__(self, text: str) -> list[int]:
        return self.library.encode(text, num_threads=1)


def lockstep(a_ends: np.ndarray, b_ends: np.ndarray, firsts: np.ndarray, lasts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (a, b) and cuts (a, b), as places of tokens that end at the given bytes.

    ``firsts`` and ``lasts`` are the ranges of B tokens that the pointers walk, each from the byte where it begins.
    """
    begins = np.where(firsts > 0, b_ends[firsts - 1], 0)
    b, stop = firsts.copy(), lasts
    a = np.searchsorted(a_ends, begins, side="right")
    linked_a, linked_b, cut_a, cut_b = [], [], [], []
    while len(b):
        linked_a.append(a)
        linked_b.append(b)
        end_a, end_b = a_ends[a], b_ends[b]
        both = end_a == end_b
        cut_a.append(a[both])
        cut_b.append(b[both])
        a = a + (end_a <= end_b)
        b = b + (end_b <= end_a)
        live = b < stop
        if not live.all():
            a, b, stop = a[live], b[live], stop[live]
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate(x) if x else none for x in (linked_a, linked_b, cut_a, cut_b))


@dataclass
class Merged:
    """Some texts' tokens, links and cuts; ``a_starts`` and ``b_starts`` say where each text's tokens begin."""

    a_ids: np.ndarray
    b_ids: np.ndarray
    a_starts: np.ndarray
    b_starts: np.ndarray
    links: tuple[np.ndarray, np.ndarray]
    cuts: tuple[np.ndarray, np.ndarray]  # in order

    def counts(self) -> np.ndarray:
        """Tokens of A and B, groups and links, a row for each text."""
        n = len(self.a_starts) - 1
        of_text = lambda b: np.bincount(np.searchsorted(self.b_starts, b, side="right") - 1, minlength=n)[:n]
        return np.stack([np.diff(self.a_starts), np.diff(self.b_starts), of_text(self.cuts[1]), of_text(self.links[1])], axis=1)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """For each link its text, and its pair of ids, B's in the upper half."""
        a, b = self.links
        text = np.searchsorted(self.b_starts, b, side="right") - 1
        return text, (self.b_ids[b].astype(np.uint64) << np.uint64(32)) | self.a_ids[a].astype(np.uint64)

    def written(self) -> list[bytes]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``, empty without tokens."""
        cut_a, cut_b = self.cuts
        n_a, n_b = len(self.a_ids), len(self.b_ids)
        ends_a, ends_b = np.zeros(n_a, dtype=np.int64), np.zeros(n_b, dtype=np.int64)
        ends_a[cut_a], ends_b[cut_b] = 1, 1
        before_b = np.concatenate([[0], cut_b + 1])  # tokens of B in the groups before each group
        until_a = np.concatenate([cut_a + 1, [n_a]])
        codes = np.zeros(n_a + n_b, dtype=np.int64)
        codes[np.arange(n_a) + before_b[np.cumsum(ends_a) - ends_a]] = self.a_ids.astype(np.int64) * 3 + ends_a
        codes[np.arange(n_b) + until_a[np.cumsum(ends_b) - ends_b]] = self.b_ids.astype(np.int64) * 3 + 2 * ends_b
        table = decimals(int(codes.max(initial=0)) // 3 + 1)
        listed = list(map(table.__getitem__, codes.tolist()))
        starts = (self.a_starts + self.b_starts).tolist()
        return [b"".join(listed[low:high])[:-1] for low, high in zip(starts, starts[1:])]


def decimals(n: int) -> list[bytes]:
    """Every number below n with each of the signs that may follow it, kept in the worker."""
    cache = process_cache()
    known = cache.get("decimals", [])
    if len(known) < 3 * n:
        known = cache["decimals"] = [b"%d%b" % (i, sign) for i in range(n) for sign in (b",", b"|", b";")]
    return known


class Both:
    """Ids of texts by both tokenizers, as arrays; none where either's tokens do not join to a space and the text.

    Where words are parted by single spaces and both tokenizers cut there, a text's ids are those of its words, which are
    remembered. A word that is empty, begins or ends with white space, or does not come back, has no ids of its own: texts
    with such words are encoded whole.
    """

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        self.by_word = a.ranked is not None and b.by_word
        self.a_of: dict[str, bytes | None] = {}
        self.b_of: dict[str, bytes | None] = {}
        self.older = self.a_of, self.b_of

    def whole(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        text, led = raw.decode(), b" " + raw
        a, b = self.a(" " + text), self.b(text)
        if b"".join(map(self.a.bytes.__getitem__, a)) != led or b"".join(map(self.b.bytes.__getitem__, b)) != led:
            a, b = [], []
        return np.array(a, dtype=np.uint32), np.array(b, dtype=np.uint32)

    def learn(self, new: list[str]) -> None:
        for word, b in zip(new, self.b.library.encode(new, num_threads=1)):
            a, led = self.a(" " + word), b" " + word.encode()
            odd = not word or EDGE.match(word[0]) or EDGE.match(word[-1])
            if odd or b"".join(map(self.a.bytes.__getitem__, a)) != led or b"".join(map(self.b.bytes.__getitem__, b)) != led:
                self.a_of[word] = self.b_of[word] = None
            else:
                self.a_of[word], self.b_of[word] = array("I", a).tobytes(), array("I", b).tobytes()

    def __call__(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        none = np.zeros(0, dtype=np.uint32)
        if not self.by_word:
            return [self.whole(t) if t else (none, none) for t in texts]
        if len(self.a_of) > REMEMBERED:
            self.older, self.a_of, self.b_of = (self.a_of, self.b_of), {}, {}
        split = [t.decode().split(" ") for t in texts]
        new = set().union(*split).difference(self.a_of)
        again = new & self.older[0].keys()
        for known, older in zip((self.a_of, self.b_of), self.older):
            known.update((w, older[w]) for w in again)
        if new := new - again:
            self.learn(list(new))
        out = []
        for raw, words in zip(texts, split):
            if not raw:
                out.append((none, none))
                continue
            a = list(map(self.a_of.__getitem__, words))
            if None in a:
                out.append(self.whole(raw))
            else:
                b = b"".join(map(self.b_of.__getitem__, words))
                out.append((np.frombuffer(b"".join(a), dtype=np.uint32), np.frombuffer(b, dtype=np.uint32)))
        return out


def merge(texts: list[bytes], encode: Both) -> Merged:
    """The texts' tokens merged; those whose tokens do not join to a space and the text have none."""
    a, b = encode.a, encode.b
    a_of, b_of = zip(*encode(texts))
    a_ids, b_ids = np.concatenate(a_of), np.concatenate(b_of)
    a_starts, b_starts = (np.array(list(accumulate(map(len, x), initial=0)), dtype=np.int64) for x in (a_of, b_of))
    a_ends, b_ends = np.cumsum(sizes(a)[a_ids]), np.cumsum(sizes(b)[b_ids])
    lanes = -(-np.diff(b_starts) // LANE)
    of_text = np.repeat(np.arange(len(texts)), lanes)
    nth = np.arange(len(of_text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    firsts = b_starts[of_text] + nth * LANE
    linked_a, linked_b, cut_a, cut_b = lockstep(a_ends, b_ends, firsts, np.minimum(firsts + LANE, b_starts[of_text + 1]))
    order = np.argsort(cut_a)
    return Merged(a_ids, b_ids, a_starts, b_starts, (linked_a, linked_b), (cut_a[order], cut_b[order]))


def both(paths: tuple[str, str]) -> Both:
    """The worker's tokenizers for two files, loaded once."""
    cache = process_cache()
    if ("both", *paths) not in cache:
        cache[("both", *paths)] = Both(ByteLevel(paths[0]), Pieces(paths[1]))
    return cache[("both", *paths)]


def sizes(tokenizer) -> np.ndarray:
    """The bytes that each id stands for."""
    if not hasattr(tokenizer, "sizes"):
        tokenizer.sizes = np.array([len(x) for x in tokenizer.bytes], dtype=np.int64)
    return tokenizer.sizes


def merged_slices(batch: pa.RecordBatch, paths: tuple[str, str]) -> Iterator[tuple[pa.Array, Merged]]:
    """Document ids and merged texts of rows (doc_id, text), some at a time."""
    encode = both(paths)
    texts = batch.column(1).cast(pa.binary()).to_pylist()
    for low, high in slices([len(t or b"") for t in texts], TEXT_BYTES):
        yield batch.column(0).slice(low, high - low), merge([t or b"" for t in texts[low:high]], encode)


def alignments(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, a_ids, b_ids, and the groups as places of their last tokens.

    Group g has the tokens of A up to ``a_cuts[g]`` and those of B up to ``b_cuts[g]`` that no group before it has; the
    links are the pairs within a group whose bytes overlap. For what has no tokens see ``align``. No shuffle.
    """
    paths = paths or default_paths()
    fields = "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>"

    def lists(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(values.astype(np.int32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, found in merged_slices(batch, paths):
                cut_a, cut_b = found.cuts
                cuts = np.searchsorted(cut_b, found.b_starts)
                nth = np.repeat(np.arange(len(keys)), np.diff(cuts))
                columns = [
                    keys,
                    lists(found.a_ids, found.a_starts),
                    lists(found.b_ids, found.b_starts),
                    lists(cut_a - found.a_starts[nth], cuts),
                    lists(cut_b - found.b_starts[nth], cuts),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a_ids", "b_ids", "a_cuts", "b_cuts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, fields)


def part_of(pairs: np.ndarray, parts: int) -> np.ndarray:
    """The part that a pair's B id belongs to."""
    return (mix64(pairs >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def squeezed(values: np.ndarray) -> bytes:
    """Numbers below 2**32 as compressed bytes, led by how many there are."""
    raw = values.astype("<u4").reshape(-1, 1).view(np.uint8).T.tobytes()  # all lowest bytes first
    return len(values).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, n).T).view("<u4").ravel()


DOCS = -1  # stands for the part in rows that hold a batch's documents
BATCH = "part int, batch string, doc_ids array<long>, counts binary, hashes array<string>, sizes binary, data binary"


def batched(docs: DataFrame, paths: tuple[str, str], parts: int) -> DataFrame:
    """Rows of batches: one with the documents and, of each, its pairs by their place among the batch's and how often;
    and for each part one with the batch's pairs of it and how often they are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        held, links, serial = [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"{context.partitionId()}-{serial}"
            everything = np.concatenate([m[3] for m in held]) if held else np.zeros(0, np.uint64)
            pairs, place, often = np.unique(everything, return_inverse=True, return_counts=True)
            # Pairs stand by part, then frequent ones first, so that their places are small numbers.
            part = part_of(pairs, parts)
            order = np.lexsort((pairs, part))
            rank = np.argsort(np.argsort(-often, kind="stable"), kind="stable")
            document = np.concatenate([m[2] + base for m, base in zip(held, accumulate([0] + [len(m[0]) for m in held]))])
            key, times = np.unique((document.astype(np.uint64) << np.uint64(32)) | rank[place].astype(np.uint64), return_counts=True)
            owner, local = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
            n = sum(len(m[0]) for m in held)
            steps = np.diff(local, prepend=0)
            new = np.ones(len(owner), dtype=bool)
            new[1:] = owner[1:] != owner[:-1]
            steps[new] = local[new]
            where = np.empty(len(pairs), dtype=np.int64)  # from a pair's rank to its place by part
            where[rank[order]] = np.arange(len(pairs))
            rows = [
                (
                    DOCS,
                    name,
                    [x for m in held for x in m[0].to_pylist()],
                    np.concatenate([m[1] for m in held]).astype("<i8").tobytes(),
                    [x for m in held for x in m[4]],
                    squeezed(np.bincount(owner, minlength=n)),
                    pa.array([squeezed(steps), squeezed(times - 1), squeezed(where)]),
                )
            ]
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in range(parts):
                some = order[cuts[p] : cuts[p + 1]]
                if len(some):
                    rows.append((p, name, [], b"", [], often[some].astype("<u8").tobytes(), pairs[some].astype("<u8").tobytes()))
            return table_of(rows)

        def table_of(rows) -> pa.RecordBatch:
            data = [joined(r[6].to_pylist()) if isinstance(r[6], pa.Array) else r[6] for r in rows]
            types = [pa.int32(), pa.string(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.string()), pa.binary()]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)] + [pa.array(data, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "batch", "doc_ids", "counts", "hashes", "sizes", "data"])

        for batch in batches:
            for keys, found in merged_slices(batch, paths):
                text, pairs = found.pairs()
                hashes = [sha256(g).hexdigest() if g else "" for g in found.written()]
                held.append((keys, found.counts(), text, pairs, hashes))
                links += len(pairs)
                if links >= BATCH_LINKS:
                    yield close()
                    held, links, serial = [], 0, serial + 1
        if held:
            yield close()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, BATCH)


def joined(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parted(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pair_counts(sent: DataFrame, parts: int) -> DataFrame:
    """One row for each part: its pairs, how often each is linked in all documents, in the columns of batches."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[int, list] = {}
        held = 0

        def fold() -> None:
            for part, new in waiting.items():
                some = [totals[part]] if part in totals else []
                pairs = np.concatenate([p for p, _ in some + new])
                often = np.concatenate([n for _, n in some + new])
                different, place = np.unique(pairs, return_inverse=True)
                summed = np.zeros(len(different), dtype=np.uint64)
                np.add.at(summed, place, often)
                totals[part] = different, summed
            waiting.clear()

        for batch in batches:
            for part, often, pairs in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.setdefault(part, []).append((np.frombuffer(pairs, "<u8"), np.frombuffer(often, "<u8")))
                held += len(pairs) // 8
                if held > HELD_PAIRS:
                    fold()
                    held = 0
        fold()
        for part, (pairs, often) in totals.items():
            columns = [pa.array([part], pa.int32()), pa.array([often.tobytes()], pa.binary()), pa.array([pairs.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "sizes", "data"])

    dealt = sent.select("part", "sizes", "data").repartition(parts, "part")
    return dealt.mapInArrow(add, "part int, sizes binary, data binary")


def answers(sent: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """For each batch and part how often the batch's pairs are linked in all documents, and which are their B id's best."""
    table = counts.select("part", F.lit(None).cast("string").alias("batch"), "sizes", "data")
    both = sent.select("part", "batch", "sizes", "data").unionByName(table)
    dealt = both.repartition(parts, "part").sortWithinPartitions("part", F.col("batch").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = often = best = None
        for batch in batches:
            out = []
            for part, name, sizes_, data in zip(*(c.to_pylist() for c in batch.columns)):
                asked = np.frombuffer(data, "<u8")
                if name is None:
                    pairs, often = asked, np.frombuffer(sizes_, "<u8")
                    b = pairs >> np.uint64(32)
                    heads = np.nonzero(np.concatenate([[True], b[1:] != b[:-1]]))[0]
                    highest = np.maximum.reduceat(often, heads)
                    best = often == np.repeat(highest, np.diff(np.append(heads, len(b))))
                else:
                    at = np.searchsorted(pairs, asked)
                    out.append((part, name, often[at].tobytes(), np.packbits(best[at]).tobytes()))
            if out:
                types = [pa.int32(), pa.string(), pa.binary(), pa.binary()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "batch", "often", "best"])

    return dealt.mapInArrow(run, "part int, batch string, often binary, best binary")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A null or empty text, and one whose tokens of either kind do not join to a space and the text, has no tokens: all
    numbers are 0 and groups_sha256 is empty. Repeated rows and ids count each; a null id stays null. Long texts are
    taken whole. An empty table gives no rows. Other columns are not read, so their names cannot clash.

    A task holds a batch (BATCH_LINKS links, or one document of more), or the table of the pairs of a part: the session's
    shuffle partitions size it, at 16 bytes for each different pair.
    """
    spark = docs.sparkSession
    parts = partitions(spark)
    made = stored(batched(docs, paths or default_paths(), parts))
    sent = made.filter(F.col("part") != DOCS)
    counts = stored(pair_counts(sent, parts))
    replies = answers(sent, counts, parts)
    rows = made.filter(F.col("part") == DOCS).select("batch", "part", "doc_ids", "counts", "hashes", "sizes", "data")
    empty = {"doc_ids": "array<long>", "counts": "binary", "hashes": "array<string>"}
    back = replies.select(
        "batch", "part", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.col("often").alias("sizes"), F.col("best").alias("data")
    )
    dealt = rows.unionByName(back).repartition(parts, "batch").sortWithinPartitions("batch", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, often, best = None, [], []

        def finish() -> pa.RecordBatch:
            doc_ids, counts, hashes, sizes_, data = row
            steps, times, where = (unsqueezed(x) for x in parted(data))
            per_text = unsqueezed(sizes_).astype(np.int64)
            owner = np.repeat(np.arange(len(per_text)), per_text)
            # Places are kept as differences within a text.
            run_up = np.cumsum(steps, dtype=np.int64)
            ends = np.cumsum(per_text)
            before = np.where(ends > per_text, run_up[np.maximum(ends - per_text - 1, 0)] if len(run_up) else 0, 0)
            pair = where[run_up - before[owner]]
            linked = np.concatenate(often).astype(np.int64) if often else np.zeros(0, np.int64)
            is_best = np.concatenate(best) if best else np.zeros(0, bool)
            much = times.astype(np.int64) + 1
            sums = [np.zeros(len(per_text), np.int64), np.zeros(len(per_text), np.int64)]
            np.add.at(sums[0], owner, much * is_best[pair])
            np.add.at(sums[1], owner, much * linked[pair])
            numbers = np.frombuffer(counts, "<i8").reshape(-1, 4)
            columns = [doc_ids, *(pa.array(numbers[:, i]) for i in range(4)), *map(pa.array, sums), hashes]
            return pa.RecordBatch.from_arrays(columns, names=RESULT_NAMES)

        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.column(1)[i].as_py()
                sizes_, data = batch.column(5)[i].as_py(), batch.column(6)[i].as_py()
                if part == DOCS:
                    if row is not None:
                        yield finish()
                    row, often, best = (batch.column(2)[i].values, batch.column(3)[i].as_py(), batch.column(4)[i].values, sizes_, data), [], []
                else:
                    often.append(np.frombuffer(sizes_, "<u8"))
                    best.append(np.unpackbits(np.frombuffer(data, np.uint8), count=len(often[-1])).astype(bool))
        if row is not None:
            yield finish()

    return dealt.mapInArrow(run, RESULT)


RESULT_NAMES = [field.split()[0] for field in RESULT.split(", ")]


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
