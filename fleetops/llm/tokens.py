"""Token ids of whole texts with a public tokenizer.

The tokenizers used here cut a text at white space before they merge anything, so the ids of a text are the ids of its
words in order. A worker remembers the words it has seen and gives only new ones to the library. ``cuts_at_space``
says whether a vocabulary file has that shape; with others, whole texts are given to the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetops.llm.runtime import process_cache

DEFAULT_FILE = "word_bpe_49k.json"
REMEMBERED = 400_000  # words in each of the two generations that a worker remembers
TEXTS = 1 << 22  # bytes of text to give an encoder at once


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


def cuts_at_space(shape: dict) -> bool:
    """Whether the file describes a tokenizer that removes white space while cutting and adds no position marks."""
    cuts = (shape.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    first, rest = cuts[0], cuts[1:]
    return (
        first.get("type") == "Split"
        and first.get("behavior") == "Removed"
        and first.get("invert") is True
        and "\\s" in first["pattern"].get("Regex", "")
        and all(c.get("type") == "ByteLevel" and not c.get("add_prefix_space") for c in rest)
        and not shape.get("post_processor")
    )


# Words of these characters need no normalisation but lower case, and are cut the same way by any regex library.
PLAIN = "!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
LETTERS = "a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"


class Encoder:
    """Ids of texts by the tokenizer file at ``path``, as arrays of unsigned 32-bit numbers.

    The words of all texts given at once are numbered by Arrow, so each different one is looked up once. A new word of
    plain characters goes to the library's model piece by piece, any other word to the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        with open(path, encoding="utf-8") as file:
            shape = json.load(file)
        self.by_word = cuts_at_space(shape)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        if self.by_word:
            cut = shape["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            own = cut.replace("\\p{L}", LETTERS).replace("\\p{N}", "0-9")
            special = [t["content"] for t in shape.get("added_tokens") or ()]
            self.cut = re.compile(f"\n|{own}").findall  # of words in lines
            self.odd = re.compile(f"(?m)^[{PLAIN}]*+[^\n{PLAIN}].*$").findall
            self.special = re.compile(f"(?m)^.*?(?:{'|'.join(map(re.escape, special)) or '(?!)'}).*$").findall
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            letters = "".join(map(chr, range(0x100, 0x800)))  # two bytes each, between them every byte beyond ASCII
            shown = "".join(p for p, _ in byte_level.pre_tokenize_str(letters))
            self.shown = dict(zip(letters.encode().decode("latin-1"), shown))
            self.shown = {ord(k): v for k, v in self.shown.items()}
            self.lower = [n.get("type") for n in (shape.get("normalizer") or {}).get("normalizers", ())] == [
                "NFC",
                "Replace",
                "Lowercase",
            ]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32).tobytes()

    def learn_pieces(self, new: list[str]) -> None:
        far = [p for p in new if not p.isascii()]
        shown = dict(zip(far, "\n".join(far).encode().decode("latin-1").translate(self.shown).split("\n")))
        tokenize = self.model.tokenize
        self.pieces.update((p, array("I", [t.id for t in tokenize(shown.get(p, p))]).tobytes()) for p in new)

    def learn(self, new: list[bytes]) -> None:
        listed = b"\n".join(new).decode()
        odd = {*self.odd(listed), *self.special(listed)} if self.lower else {w.decode() for w in new}
        for word in odd:
            self.known[word.encode()] = self.whole(word)
        plain = [w for w in new if w not in self.known] if odd else new
        if not plain:
            return
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        parts = self.cut(b"\n".join([*plain, b""]).decode().lower())
        self.pieces["\n"] = b""
        self.learn_pieces(list(set(parts).difference(self.pieces)))
        found = list(map(self.pieces.__getitem__, parts))
        last = np.fromiter(map("\n".__eq__, parts), dtype=bool, count=len(parts))
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))[last].tolist()
        self.known.update(zip(plain, map(b"".join(found).__getitem__, map(slice, [0, *ends], ends))))

    def __call__(self, texts: Iterable[bytes]) -> list[np.ndarray]:
        """The ids of each text, given as UTF-8."""
        if not self.by_word:
            return [np.frombuffer(self.whole(t.decode()), dtype=np.uint32) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known, self.older = {}, self.known
        # Words, and empty ones where a text begins or ends with white space.
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
        numbered = split.flatten().dictionary_encode()
        words = numbered.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.known.get, words))
        if new := [w for w, ids in zip(words, found) if ids is None]:
            again = {w: ids for w in new if (ids := self.older.get(w)) is not None} if self.older else {}
            self.known.update(again)
            if new := [w for w in new if w not in again]:
                self.learn(new)
            found = list(map(self.known.__getitem__, words))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        ids = np.frombuffer(b"".join(found), dtype=np.uint32)
        at = numbered.indices.to_numpy()
        ends = np.cumsum(sizes[at])
        shift = (np.cumsum(sizes) - sizes)[at] - (ends - sizes[at])
        ids = ids[np.repeat(shift, sizes[at]) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[split.offsets.to_numpy()].tolist()
        return [ids[low:high] for low, high in zip(ends, ends[1:])]


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    cache = process_cache()
    if ("encoder", path) not in cache:
        cache["encoder", path] = Encoder(path)
    return cache["encoder", path]


def slices(sizes: list[int], most: int = 1 << 20):
    """Ranges of neighbours whose sizes add up to about ``most``."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)
