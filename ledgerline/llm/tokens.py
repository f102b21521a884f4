"""Whole texts to token ids with the `tokenizers` library, one call per distinct word.

The vocabulary's pre-tokenizer never joins what white space separates, so a text's
ids are its words' ids in order.  A worker looks words up in a bounded table that
outlives its tasks and hands only unseen ones to the library.  ASCII and Latin-1
letters are lowered first, as the vocabulary's normalizer does, and a full stop or
comma after a letter counts as a word of its own, as its pre-tokenizer says.  Words
of such letters alone need no more of its rules: the library splits them at spaces.
A text that may hold a special token ("<|") goes to the library whole.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from ledgerline.llm.common import ascii_lower, process_cache, row_chunks, span_hashes, text_bytes, word_spans

TABLE_BITS = 21
#: Distinct words that a worker's table holds before it starts anew.
MAX_WORDS = 1_000_000


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTable:
    """Open-addressing table from word hashes to runs in a pool of ids."""

    def __init__(self, encode):
        self.encode = encode  # distinct words -> their lists of ids, or what `flat` makes of them
        self.clear()

    def clear(self):
        self.keys = np.zeros(1 << TABLE_BITS, np.uint64)
        self.index = np.zeros(1 << TABLE_BITS, np.int32)
        self.at = np.zeros(1024, np.int64)
        self.pool = np.zeros(4096, np.uint32)
        self.words = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Word number of every key, -1 where it is new."""
        out = np.full(len(keys), -1, np.int64)
        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            held = self.keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.index[slot[open_[hit]]]
            open_ = open_[~hit & (held != 0)]
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
        return out

    def add(self, keys: np.ndarray, strings: list) -> None:
        got = self.encode(strings)
        ids, sizes = got if isinstance(got, tuple) else flat(got)
        last, total = self.at[self.words], len(ids)
        if self.words + len(keys) + 1 >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at), len(keys) + 1), np.int64)])
        if last + total > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), total), np.uint32)])
        self.pool[last:last + total] = ids
        self.at[self.words + 1:self.words + 1 + len(keys)] = last + np.cumsum(sizes)
        number = np.arange(self.words, self.words + len(keys), dtype=np.int32)
        slot = (keys >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            free = open_[self.keys[slot[open_]] == 0]
            self.keys[slot[free]] = keys[free]
            self.index[slot[free]] = number[free]
            open_ = open_[self.keys[slot[open_]] != keys[open_]]
            slot[open_] = (slot[open_] + 1) & ((1 << TABLE_BITS) - 1)
        self.words += len(keys)


    def ids(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray):
        """Ids of all spans end to end, and how many each span has."""
        if self.words + len(keys) > MAX_WORDS:
            self.clear()
        number = self.find(keys)
        new = np.flatnonzero(number < 0)
        if len(new):
            distinct, first = np.unique(keys[new], return_index=True)
            spans = new[first]
            text = buf.tobytes()
            self.add(distinct, [text[a:b].decode("utf-8", "replace")
                                for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)])
            number[new] = self.find(keys[new])
        first_id = self.at[number]
        sizes = self.at[number + 1] - first_id
        ends_at = np.cumsum(sizes)
        total = int(ends_at[-1]) if len(ends_at) else 0
        return self.pool[np.repeat(first_id - (ends_at - sizes), sizes) + np.arange(total)], sizes


def _bar(encoder) -> int | None:
    """The id of a bar that stands between words and leaves them as they are; None if the vocabulary has no such id."""
    def ids(text):
        return encoder.encode(text, add_special_tokens=False).ids

    bar = ids("|")
    return bar[0] if len(bar) == 1 and ids("words | apart") == ids("words") + bar + ids("apart") else None


def flat(runs: list) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the runs end to end, and how many each has."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    return np.fromiter((i for r in runs for i in r), np.uint32, int(sizes.sum())), sizes


#: A word that `LEAVES` leave whole: lower-case letters of ASCII and Latin-1.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: The rules of a vocabulary that do no more to such a word than turn its bytes into characters.
LEAVES = {
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


def _spaced_encoder(encoder):
    """Words of `LETTERS` -> `flat` ids, by the library's model and a split at spaces; None where a word's last
    id doesn't tell that it is the last.  None instead of the function where the vocabulary has other rules."""
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

    suffix = getattr(encoder.model, "end_of_word_suffix", None)
    rules = [x and json.loads(x.__getstate__()) for x in (encoder.normalizer, encoder.pre_tokenizer)]
    if not suffix or rules != [{"type": "Sequence", k: v} for k, v in LEAVES.items()]:
        return None
    spaced = Tokenizer(encoder.model)
    spaced.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
    vocab = encoder.get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True

    def encode(words: list):
        ids = np.array(spaced.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(last[ids])
        return (ids, np.diff(cut, prepend=-1)) if len(cut) == len(words) else None
    return encode


def joined_encoder(encoder):
    """Distinct words -> `flat` ids: many words in one call, with spaces or bars between them.

    The library's objects cost more than its work on a short word.  Words of letters are told apart by their last
    ids, others by bars.  Words that hold a bar, and calls that don't come out one for one, go word by word.
    """
    bar, spaced = _bar(encoder), _spaced_encoder(encoder)

    def one_by_one(words: list):
        return flat([e.ids for s in range(0, len(words), 2048)
                     for e in encoder.encode_batch_fast(words[s:s + 2048], add_special_tokens=False)])

    def together(words: list):
        ids = np.array(encoder.encode_batch_fast([" | ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        cut = np.flatnonzero(ids == bar)
        if len(cut) != len(words) - 1:
            return one_by_one(words)
        return np.delete(ids, cut), np.diff(np.append(cut, len(ids)), prepend=-1) - 1

    def encode(words: list):
        # 0: letters alone, 1: told apart by bars, 2: alone
        way = np.fromiter((0 if spaced and LETTERS.fullmatch(w) else 2 if bar is None or "|" in w else 1 for w in words),
                          np.int8, len(words))
        groups = [[words[k] for k in np.flatnonzero(way == v).tolist()] for v in range(3)]
        parts = [spaced(groups[0][s:s + 128]) or one_by_one(groups[0][s:s + 128]) for s in range(0, len(groups[0]), 128)]
        parts += [together(groups[1][s:s + 1024]) for s in range(0, len(groups[1]), 1024)]
        parts.append(one_by_one(groups[2]))
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        place = np.argsort(np.argsort(way, kind="stable"), kind="stable")  # back to the words' order
        first, sizes = (np.cumsum(sizes) - sizes)[place], sizes[place]
        return ids[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))], sizes

    return encode


def word_table(path: str) -> WordTable:
    """The worker's table for a vocabulary file of the `tokenizers` library."""
    store = process_cache("tokens")
    if ("words", path) not in store:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        store["words", path] = WordTable(joined_encoder(Tokenizer.from_file(path)))
    return store["words", path]


def _lower(buf: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with the letters of ASCII and Latin-1 lowered."""
    low = ascii_lower(buf)
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) else np.zeros(0, np.int64)
    at = at[(buf[at] <= 0x9E) & (buf[at] != 0x97)]
    low[at] += 0x20
    return low


def _split_marks(buf, starts, ends, rows):
    """A last full stop or comma that follows a letter becomes a span of its own."""
    last, before = buf[ends - 1], buf[np.maximum(ends - 2, 0)]
    lead = buf[np.maximum(ends - 3, 0)]
    long = ends - starts
    letter = (before >= 97) & (before <= 122) & (long >= 2)
    letter |= (lead == 0xC3) & (before >= 0x80) & (before <= 0xBF) & (before != 0x97) & (before != 0xB7) & (long >= 3)
    cut = ((last == 44) | (last == 46)) & letter
    copies = 1 + cut.astype(np.int64)
    at = np.cumsum(copies) - copies
    s, e, r = (np.repeat(x, copies) for x in (starts, ends, rows))
    e[at[cut]] -= 1
    s[at[cut] + 1] = e[at[cut] + 1] - 1
    return s, e, r


def encode_column(column, table: WordTable, end_id: int):
    """Yield (first row, ids, n+1 offsets) for runs of rows; each row ends with `end_id`."""
    buf, off = text_bytes(column)
    for i, j in row_chunks(off):
        raw = buf[off[i]:off[j]]
        at = off[i:j + 1] - off[i]
        low = _lower(raw)
        starts, ends, rows = _split_marks(low, *word_spans(low, at))
        marks = np.flatnonzero((raw[:-1] == 60) & (raw[1:] == 124)) if len(raw) > 1 else np.zeros(0, np.int64)
        if len(marks):  # such a text is one span in its own spelling
            whole = np.unique(np.searchsorted(at, marks, "right") - 1)
            mine = np.isin(rows, whole)
            for r in whole:
                low[at[r]:at[r + 1]] = raw[at[r]:at[r + 1]]
            starts = np.concatenate([starts[~mine], at[whole]])
            ends = np.concatenate([ends[~mine], at[whole + 1]])
            rows = np.concatenate([rows[~mine], whole])
            order = np.argsort(starts, kind="stable")
            starts, ends, rows = starts[order], ends[order], rows[order]
        keys = span_hashes(low, starts, ends) | np.uint64(1)
        flat, sizes = table.ids(low, starts, ends, keys)
        of_row = np.repeat(rows, sizes)
        out = np.full(len(flat) + (j - i), end_id, np.uint32)
        out[np.arange(len(flat)) + of_row] = flat
        per_row = np.bincount(of_row, minlength=j - i) + 1
        yield i, out, np.concatenate([[0], np.cumsum(per_row)])
