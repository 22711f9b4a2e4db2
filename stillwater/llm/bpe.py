"""Token ids of the ``tokenizers`` library, with encoded pieces remembered.

Byte-pair encoding works on the pieces that the pre-tokenizer cuts, one by one,
and no piece reaches over a single space into the word before it.  So a block of
texts of plain characters is split at its spaces and its distinct words are
numbered by Arrow; most words are one run of letters with at most one mark after
it, that is one piece or two.  Each distinct piece goes through the library
once, and the texts' ids are gathered from the pieces' ids.  Other words are cut
by a pattern equal to the library's, and any other text goes through the library
as a whole, so the ids are always the library's.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Letters of the plain characters, and the pre-tokenizer patterns
# of the two known vocabularies restricted to them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
SUFFIXES = "'s|'t|'re|'ve|'m|'ll|'d"
BYTE_LEVEL = rf"{SUFFIXES}| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+"
WORD_ENDS = rf"{SUFFIXES}|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+"
#: UTF-8 bytes of plain texts: ASCII without control characters, and U+00C0 to U+00FF.
PLAIN_BYTES = bytes([9, 10, 13, *range(32, 127), *range(0x80, 0xC0), 0xC3])
#: Pieces that one worker remembers; it forgets all when there are more.
CACHE_PIECES = 350_000
#: Marks that are a piece of their own after a run of letters.
MARKS = ",.;:!?"
#: Pieces that go through the library in one text, each closed by a separator.
JOINED = 64


def is_plain(text: str, special: tuple[bytes, ...] = ()) -> bool:
    """Whether a text has plain characters only and none of the (lower-cased) ``special`` strings."""
    raw = text.encode("utf-8", "replace")
    if raw.translate(None, PLAIN_BYTES) or b"\xc3\x97" in raw or b"\xc3\xb7" in raw:
        return False
    return not special or not any(s in raw.lower() for s in special)


class PieceEncoder:
    """Encodes texts to little-endian ids of ``width`` bytes each (2 if the vocabulary allows).

    The strings of special tokens are those tokens, as the library has it by
    default; with ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            self.special = tuple(t["content"].lower().encode() for t in json.load(f).get("added_tokens", []))
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.pattern, self.lower = self._cut(path)
        # a piece of its own between any two pieces of no white space, and found inside no other piece
        self.separator = " | " if self.lower else "\n"
        mark = self.tokenizer.encode(self.separator, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.forget()

    @staticmethod
    def _cut(path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        if before is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return re.compile(BYTE_LEVEL), False
        kinds = [x["type"] for x in (before or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if kinds == ["NFC", "Replace", "Lowercase"] and [x["type"] for x in parts] == ["Split", "ByteLevel"]:
            wanted = rf"{SUFFIXES}|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+"
            if parts[0]["pattern"].get("Regex") == wanted and parts[0]["invert"] and not parts[1]["use_regex"]:
                return re.compile(WORD_ENDS), True
        return None, False

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"<u{self.width}")

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        """Number 0 is the piece without ids."""
        self.number: dict[str, int] = {"": 0}
        self.start, self.length, self.flat, self.used = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, self.dtype), 0

    def _keep(self, pieces: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remember pieces whose ids follow one another in ``ids``."""
        n = len(self.number)
        while len(self.start) < n + len(pieces):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while len(self.flat) < self.used + len(ids):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.length[n : n + len(pieces)] = lengths
        self.start[n : n + len(pieces)] = self.used + np.cumsum(lengths) - lengths
        self.number.update(zip(pieces, range(n, n + len(pieces))))
        self.used += len(ids)

    def _learn(self, new: list[str]) -> None:
        """Numbers and ids of pieces that are not known yet."""
        plain = [p for p in new if not p.isspace() and "|" not in p and "\n" not in p] if self.mark is not None else []
        odd = list(set(new).difference(plain))
        joined = [plain[a : a + JOINED] for a in range(0, len(plain), JOINED)]
        for a in range(0, len(joined), 64):
            groups = joined[a : a + 64]
            texts = [self.separator.join(g) + self.separator for g in groups]
            for part, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(ids == self.mark)
                if len(ends) != len(part):
                    odd += part
                else:
                    self._keep(part, ids[ids != self.mark], np.diff(ends, prepend=-1) - 1)
        for a in range(0, len(odd), 4096):
            part = odd[a : a + 4096]
            found = [np.frombuffer(b, self.dtype) for b in self._ids(part)]
            self._keep(part, np.concatenate(found), np.array([len(x) for x in found]))

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Numbers of pieces, known or not."""
        look = self.number.get
        found = [look(p, -1) for p in pieces]
        missing = [p for p, k in zip(pieces, found) if k < 0]
        if missing:
            self._learn(list(dict.fromkeys(missing)))
            found = [look(p) for p in pieces]
        return np.array(found, np.int64)

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered pieces one after another, and how many each has."""
        lengths = self.length[slots]
        at = np.repeat(self.start[slots] - np.cumsum(lengths) + lengths, lengths)
        return self.flat[at + np.arange(len(at))], lengths

    def _cut_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of texts cut by the pattern, and pieces per text."""
        cut = [self.pattern.findall(t) for t in texts]
        return self._numbers([p for c in cut for p in c]), np.array([len(c) for c in cut], np.int64)

    def _word_slots(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of words one after another, and pieces per word."""
        coded = words.dictionary_encode()
        known, at = coded.dictionary, coded.indices.to_numpy()
        core = pc.utf8_rtrim(known, characters=MARKS)
        marks = pc.subtract(pc.utf8_length(known), pc.utf8_length(core)).to_numpy()
        simple = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & (marks <= 1)
        lead = "" if self.lower else " "
        parts = core.filter(pa.array(simple)).dictionary_encode()
        numbers = self._numbers([lead + c for c in parts.dictionary.to_pylist()])
        tail = pc.utf8_slice_codeunits(known.filter(pa.array(simple & (marks == 1))), -1).to_pylist()
        tails = self._numbers(list(tail))
        others, sizes = self._cut_all([lead + w if w or lead else w for w in known.filter(pa.array(~simple)).to_pylist()])
        # pieces of the distinct words, then of the words in their order
        per = np.zeros(len(known), np.int64)
        per[simple] = 1 + marks[simple]
        per[~simple] = sizes
        first = np.cumsum(per) - per
        pieces = np.zeros(int(per.sum()), np.int64)
        pieces[first[simple]] = numbers[parts.indices.to_numpy()]
        pieces[first[simple & (marks == 1)] + 1] = tails
        inner = np.arange(len(others)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        pieces[np.repeat(first[~simple], sizes) + inner] = others
        n = per[at]
        return pieces[np.repeat(first[at] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))], n

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        if len(self.number) > CACHE_PIECES:
            self.forget()
        split, whole, slow = [], [], []
        for k, t in enumerate(texts):
            (whole if self.pattern is None or not is_plain(t, self.special) else slow if not self.lower and "  " in t else split).append(k)
        if split:
            plain = pa.array([texts[k] for k in split], pa.large_string())
            if self.lower:
                lists = pc.ascii_split_whitespace(pc.utf8_lower(plain))
                heads, head_n = np.zeros(0, np.int64), np.zeros(len(split), np.int64)
            else:
                # the first word has no space before it
                cuts = [texts[k].split(" ", 1) for k in split]
                heads, head_n = self._cut_all([c[0] for c in cuts])
                lists = pc.split_pattern(pa.array([c[1] if len(c) > 1 else None for c in cuts], pa.large_string()), " ")
            words = np.array(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(), np.int64)
            slots, per = self._word_slots(lists.flatten())
            edge = np.concatenate([[0], np.cumsum(per)])[np.concatenate([[0], np.cumsum(words)])]
            rest_ids, rest_n = self._gather(slots)
            head_ids, head_len = self._gather(heads)
            rest_at = np.concatenate([[0], np.cumsum(rest_n)])[edge]
            head_at = np.concatenate([[0], np.cumsum(head_len)])[np.concatenate([[0], np.cumsum(head_n)])]
            for j, k in enumerate(split):
                out[k] = head_ids[head_at[j] : head_at[j + 1]].tobytes() + rest_ids[rest_at[j] : rest_at[j + 1]].tobytes()
        if slow:
            slots, per = self._cut_all([texts[k] for k in slow])
            ids, n = self._gather(slots)
            at = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(per)])]
            for j, k in enumerate(slow):
                out[k] = ids[at[j] : at[j + 1]].tobytes()
        for k, ids in zip(whole, self._ids([texts[k] for k in whole])):
            out[k] = ids
        return out


@lru_cache(maxsize=4)
def worker_encoder(path: str) -> PieceEncoder:
    """The encoder of this process, kept with its pieces from task to task."""
    return PieceEncoder(path)


def encoded_blocks(batches, path: str, text: str = "text", size: int = 4 << 20):
    """(batch, first row, end row, ids of each text) for blocks of about ``size`` characters."""
    encoder = worker_encoder(path)
    for batch in batches:
        texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
        a = 0
        while a < len(texts):
            b, n = a, 0
            while b < len(texts) and (b == a or n + len(texts[b]) <= size):
                n += len(texts[b])
                b += 1
            yield batch, a, b, encoder.encode(texts[a:b]), encoder
            a = b
    pa.default_memory_pool().release_unused()  # the worker lives on
