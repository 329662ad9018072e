"""Whole-text token ids from a tokenizer file, at the price of its distinct words.

A tokenizer that splits text before it merges gives the same ids for a word wherever the word stands.  `Encoder` splits
a text at places where the tokenizer splits it too, asks the library for each distinct piece once and joins the ids.
Texts with anything for which that is not certain (rare white space, special-token strings, control characters) go to
the library whole, so the ids are always those of `Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces held by one worker; at about 200 bytes each.
CACHE_PIECES = 800_000
#: Pieces that one call to the library gets as one text.
JOINED = 500

#: What sends a text to the library whole.
UNSURE = re.compile("[\x00-\x08\x0b-\x1f\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]|<\\|")
#: The pieces of texts with runs of white space.
PIECES = re.compile(r" ?[^ \n\t]+|[ \n]+(?![^ \n])|[ \n]")
#: Latin-1 characters by kind: letter or digit, comma or full stop, white space, tab, other visible, unsure.
KINDS = bytes(
    ord("t" if c == "\t" else " " if c in " \n" else "," if c in ",." else "a" if c.isalnum() else "!" if UNSURE.match(c) else "#")
    for c in map(chr, range(256))
)


def kinds(text: str) -> bytes | None:
    """The kind of each character; None unless all are sure Latin-1."""
    try:
        found = text.encode("latin-1").translate(KINDS)
    except UnicodeEncodeError:
        return None
    return None if b"!" in found or "<|" in text else found


def apart(found: bytes) -> bool:
    """No comma or full stop that a tokenizer may join to a neighbour other than a letter, a digit or the end."""
    return not (found[:1] == b"," or b",," in found or b",#" in found or b"#," in found or b" ," in found or b"t," in found)


#: Between pieces; texts that hold it are unsure.
CUT = "\x01"


def words(text: str) -> str | None:
    """White space is dropped, letters are lower-cased by the tokenizer, and it never joins two pieces."""
    if (found := kinds(text)) is None:
        if UNSURE.search(text):
            return None
    else:
        text = text.lower()
        if apart(found):
            text = text.replace(",", " , ").replace(".", " . ")
    return text.replace(" ", CUT).replace("\n", CUT).replace("\t", CUT)


def spaced(text: str) -> str | None:
    """One space belongs to the word after it; other white space stands alone, less its last character before a word."""
    found = kinds(text)
    if "\t" in text or found is None and UNSURE.search(text):
        return None
    if found is None or b"  " in found:
        return CUT.join(PIECES.findall(text))
    if apart(found):
        text = text.replace(",", "\x01,\x01").replace(".", "\x01.\x01")
    return text.replace(" ", "\x01 ").replace("\n", "\x01\n\x01")


#: How a tokenizer splits: the pieces with CUT between them (None: the text goes to the library whole), some of them empty, and the separator between pieces in a call.
SPLITS = {"words": (words, " \x00 "), "spaces": (spaced, "\n")}


class Encoder:
    """`split`: a key of SPLITS, or None to encode every text whole.  Ids are little-endian, 2 bytes where they fit."""

    def __init__(self, path: str, split: str | None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = SPLITS[split] if split else None
        self.cache: dict[str, bytes] = {"": b""}
        if self.split:
            self.separator = self.tokenizer.encode(self.split[1], add_special_tokens=False).ids
            if len(self.separator) != 1:
                self.split = None
        self.closing = self.closers() if split == "words" else None

    def closers(self) -> np.ndarray | None:
        """Which ids close a word; None if the tokenizer marks no ends, or not after each byte."""
        from tokenizers.pre_tokenizers import ByteLevel

        mark, vocab = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        if not mark or any(c + mark not in vocab for c in ByteLevel.alphabet()):
            return None
        out = np.zeros(max(vocab.values()) + 1, bool)
        out[[i for word, i in vocab.items() if word.endswith(mark)]] = True
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[str]) -> None:
        alone = [p for p in pieces if p.isspace()]
        rest = [p for p in pieces if not p.isspace()]
        if self.closing is not None:
            # A piece of letters is one word, so no separator is needed: each has one end, or more if it is not what it seems.
            alone += self.several([p for p in rest if p.isalpha()], " ", lambda ids: np.flatnonzero(self.closing[ids]) + 1, 0)
            rest = [p for p in rest if not p.isalpha()]
        cut = self.separator[0]
        alone += self.several(rest, self.split[1], lambda ids: np.append(np.flatnonzero(ids == cut), len(ids)), 1)
        self.cache.update(zip(alone, self.whole(alone)))

    def several(self, pieces: list[str], between: str, ends, gap: int) -> list[str]:
        """Learn `pieces` in calls of `JOINED`; `ends` finds where each one's ids end, `gap` ids before the next one's.  Returns those for which that failed."""
        groups, failed, size = [pieces[i : i + JOINED] for i in range(0, len(pieces), JOINED)], [], self.dtype.itemsize
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([between.join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = ends(ids)
            if len(at) != len(group):
                failed += group
                continue
            raw, starts = ids.tobytes(), [0, *((at[:-1] + gap) * size).tolist()]
            self.cache.update(zip(group, map(raw.__getitem__, map(slice, starts, (at * size).tolist()))))
        return failed

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.split:
            return self.whole(texts)
        out: list = [None] * len(texts)
        parts, odd = {}, []
        for i, t in enumerate(texts):
            if (pieces := self.split[0](t)) is None:
                odd.append(i)
            else:
                parts[i] = pieces
        for i, ids in zip(odd, self.whole([texts[i] for i in odd])):
            out[i] = ids
        if parts:
            for i, ids in zip(parts, self.joined(list(parts.values()))):
                out[i] = ids
        return out

    def joined(self, texts: list[str]) -> list[bytes]:
        """Ids of each of `texts`, given as pieces with CUT between them: Python looks at each distinct piece once, Arrow and numpy do the rest."""
        pieces = pc.split_pattern(pa.array(texts, pa.string()), CUT)
        found = pieces.flatten().dictionary_encode()
        distinct, at = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        missing = set(distinct).difference(self.cache)
        if len(missing) + len(self.cache) > CACHE_PIECES:
            self.cache = {"": b""}
            missing = set(distinct).difference(self.cache)
        self.learn(list(missing))
        raw = list(map(self.cache.__getitem__, distinct))
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // self.dtype.itemsize
        first, many = np.cumsum(size) - size, size[at]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(many)])
        # The ids of piece i stand at first[at[i]] among those of the distinct pieces, and go to ends[i].
        ids = np.frombuffer(b"".join(raw), self.dtype)[np.repeat(first[at] - ends[:-1], many) + np.arange(ends[-1])].tobytes()
        bounds = (ends[pieces.offsets.to_numpy()] * self.dtype.itemsize).tolist()
        return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, split: str | None) -> Encoder:
    """One for each worker process and file."""
    if (path, split) not in _encoders:
        _encoders[path, split] = Encoder(path, split)
    return _encoders[path, split]


def encoded(texts, path: str, split: str | None, at_once: int = 1 << 22):
    """Ids of each text of an Arrow array (null: empty), in groups of about `at_once` characters."""
    group, size, tool = [], 0, encoder(path, split)
    for t in texts:
        group.append(t.as_py() or "")
        size += len(group[-1])
        if size >= at_once:
            yield from tool.encode(group)
            group, size = [], 0
    yield from tool.encode(group)
