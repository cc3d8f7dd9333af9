"""Token ids of whole texts as arrays, with a bounded memory of the pieces already seen.

Both encoders return the ids that the tokenizers library returns; they differ in who merges unseen pieces:
`WordEncoder` asks the library, `ByteEncoder` proposes by longest match and verifies (see op 6).
"""

from __future__ import annotations

import json
import re
from functools import lru_cache
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries in each of the two generations of a worker's memory (about 200 bytes each).
MEMORY_PIECES = 200_000
#: Bytes of text encoded at once.
SLICE_BYTES = 10 << 20
#: Characters whose class and lower case are the same everywhere: ASCII, Latin-1 and Latin Extended-A letters, common dashes, quotes.
_PLAIN = r"\t\n\r\x20-\x7e¡-©«¬®-±´¶-¸»¿-įĲ-ňŊ-ž–—‘-„…€"
_ODD = re.compile(f"[^{_PLAIN}]")
_WORD_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\s\w]|_)+")
_BYTE_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def slices(column: pa.Array, most: int = SLICE_BYTES):
    """Runs of rows of about `most` bytes; a longer row comes alone."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > most:
            yield column.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < len(column):
        yield column.slice(at)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start..start+length-1 of each run, one after the other."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    if not total:
        return out
    full = lengths > 0
    s, n = starts[full], lengths[full]
    out[0] = s[0]
    ends = np.cumsum(n)[:-1]
    out[ends] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: visible Latin-1 characters for themselves, the others from U+0100 on."""
    out = {b: b for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
    return out | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in out)}


class Memory:
    """A bounded map: when the young generation is full it becomes the old one, and the old one is dropped."""

    def __init__(self, most: int = MEMORY_PIECES):
        self.most, self.young, self.old = most, {}, {}

    def split(self, keys) -> tuple[dict, list]:
        """What is known of keys, and the keys that aren't known."""
        young, old = self.young.get, self.old.get
        known = {k: v for k in keys if (v := young(k) or old(k)) is not None}
        return known, [k for k in keys if k not in known] if len(known) < len(keys) else []

    def find(self, keys: list) -> list:
        """What is known of each key, else None; what only the old generation knew goes into the young one."""
        out = list(map(self.young.get, keys))
        if self.old:
            old = self.old.get
            again = {keys[i]: found for i, v in enumerate(out) if v is None and (found := old(keys[i])) is not None}
            if again:
                out = [v if v is not None else again.get(k) for k, v in zip(keys, out)]
                self.add(again)
        return out

    def add(self, more: dict) -> None:
        self.young.update(more)
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}


#: Kinds of characters; digits are pieces of their own, neighbours of the other kinds make pieces. WHITE is dropped.
WHITE, LETTER, DIGIT, OTHER, UNCOMMON = range(5)


@lru_cache
def _byte_tables() -> tuple[bytes, bytes, np.ndarray, np.ndarray]:
    """Kind and lower case of each byte, and of each pair of bytes that begins a character beyond ASCII (lower case as a number)."""
    kinds, lower = np.full(1 << 16, UNCOMMON, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for code in range(1 << 11):
        char = chr(code)
        raw, low = (int.from_bytes(c.encode()) for c in (char, char.lower()))
        if not _ODD.search(char) and (raw < 128) == (low < 128) and low < 1 << 16:
            kinds[raw] = WHITE if char.isspace() else DIGIT if "0" <= char <= "9" else LETTER if char.isalpha() else OTHER
            lower[raw] = low
    return kinds[:256].tobytes(), lower[:256].astype(np.uint8).tobytes(), kinds, lower


class WordEncoder:
    """Ids of the word vocabulary (lower case, white space dropped, word ends marked).

    The library's result for a text is the concatenation of its results for the parts between blanks and line
    ends: white space is dropped, no composition crosses it, and merges stay within words. Texts are cut into pieces by the kinds of
    their bytes, on arrays, and each distinct piece of a slice is encoded once. Parts with uncommon characters, contractions or
    special-token marks stay whole: they are split by the pattern, or go to the library as they are.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(self.library.get_vocab_size(with_added_tokens=True) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # the same model for pieces that are cut and mapped to byte letters already
        self.merger = Tokenizer(self.library.model)
        self.merger.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = {b: c for b, c in byte_letters().items() if b != 32}
        self.memory = Memory(2 * MEMORY_PIECES)

    def _learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        out, groups = {}, [pieces[i : i + 32] for i in range(0, len(pieces), 32)]
        mapped = [b" ".join(g).decode("latin-1").translate(self.letters) for g in groups]
        for group, found in zip(groups, self.merger.encode_batch_fast(mapped, add_special_tokens=False)):
            ids = np.array(found.ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                raw, at = ids.tobytes(), 0
                for piece, end in zip(group, (4 * cuts).tolist()):
                    out[piece], at = raw[at:end], end
            else:
                out.update((p, self._whole(p.decode())) for p in group)
        return out

    def _whole(self, part: str) -> bytes:
        return np.array(self.library.encode(part, add_special_tokens=False).ids, np.uint32).tobytes()

    def _encoded(self, pieces: list[bytes], whole: np.ndarray) -> list[bytes]:
        """Ids of each of the distinct pieces; whole: which of them are parts that weren't cut."""
        out = self.memory.find(pieces)
        fresh = [i for i, v in enumerate(out) if v is None]
        if fresh:
            learned = self._learn([pieces[i] for i in fresh if not whole[i]])
            parts = {pieces[i]: pieces[i].decode() for i in fresh if whole[i]}
            if parts:
                split = {p: [x.encode() for x in _WORD_PIECE.findall(t.lower())] for p, t in parts.items() if not _ODD.search(t) and "<|" not in t}
                inner = list({x for v in split.values() for x in v}.difference(learned))
                known = learned | {x: v for x, v in zip(inner, self.memory.find(inner)) if v is not None}
                more = self._learn([x for x in inner if x not in known])
                learned, get = learned | more, (known | more).__getitem__
                learned |= {p: b"".join(map(get, split[p])) if p in split else self._whole(t) for p, t in parts.items()}
            for i in fresh:
                out[i] = learned[pieces[i]]
            self.memory.add(learned)
        return out

    def _cut(self, column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of all texts one after the other, as a dictionary array; which of its values are parts left whole; before
        how many pieces each text begins, and their number."""
        kind_of, lower_of, pair_kinds, pair_lower = _byte_tables()
        column = column.cast(pa.large_string())
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset :][: len(column) + 1] if len(column) else np.zeros(1, np.int64)
        text = bytearray(memoryview(data)[at[0] : at[-1]]) if data else bytearray()
        n, at = len(text), at - at[0]
        raw, kind, lower = (np.frombuffer(x, np.uint8) for x in (text, text.translate(kind_of), text.translate(lower_of)))
        leads = np.flatnonzero(raw >= 0xC0)
        pairs = raw[leads].astype(np.uint16) << 8 | raw[leads + 1]
        kind[leads] = kind[leads + 1] = pair_kinds[pairs]
        pairs = pair_lower[pairs]
        lower[leads], lower[leads + 1] = pairs >> 8, pairs & 0xFF
        begins = np.empty(n, bool)
        begins[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=begins[1:])
        begins |= kind == DIGIT
        begins[at[at < n]] = True
        keep = kind != WHITE
        first, last = self._parts(raw, kind, lower, at)
        if len(first):
            inside = np.zeros(n + 1, np.int8)
            inside[first] = 1
            inside[last] -= 1  # where the next one begins it stays inside
            inside = np.cumsum(inside[:-1], dtype=np.int8).view(bool)
            begins &= ~inside
            begins[first] = True
            keep |= inside
            np.copyto(lower, raw, where=inside)
            del inside
        begins &= keep
        del raw, kind, text
        letters = lower[keep]
        offsets = np.append(np.flatnonzero(begins[keep]).astype(np.int32), np.int32(len(letters)))
        starts = np.flatnonzero(begins).astype(np.int32)
        del lower, begins, keep
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        whole = np.zeros(len(pieces.dictionary), bool)
        whole[pieces.indices.to_numpy()[np.searchsorted(starts, first.astype(np.int32))]] = True
        return pieces, whole, np.searchsorted(starts, at.astype(np.int32))

    @staticmethod
    def _parts(raw: np.ndarray, kind: np.ndarray, lower: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of each part that isn't cut by kinds: uncommon characters, a possible contraction, a special token's mark."""
        odd = kind == UNCOMMON
        for char, after in ((b"'", b"strvmld"), (b"<", b"|")):
            found = np.flatnonzero(raw[:-1] == char[0])
            odd[found[np.isin(lower[found + 1], np.frombuffer(after, np.uint8))]] = True
        if not odd.any():
            return at[:0], at[:0]
        blank = (raw == 32) | (raw == 10)
        first = np.append(True, blank[:-1])
        first[at[at < len(raw)]] = True
        first = np.flatnonzero(first)
        last = np.append(first[1:], len(raw))
        last -= blank[last - 1]
        held = np.flatnonzero(np.logical_or.reduceat(odd, first))
        return first[held], last[held]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): text i has ids[offsets[i]:offsets[i + 1]]. Null texts are empty."""
        pieces, whole, at = self._cut(pc.fill_null(column, ""))
        encoded = pa.array(self._encoded(pieces.dictionary.to_pylist(), whole), pa.large_binary())
        _, ends, data = encoded.take(pieces.indices).buffers()
        at = np.frombuffer(ends, np.int64)[at] // 4 if len(pieces) else at
        return np.frombuffer(data or b"", np.uint32)[: at[-1]], at


class ByteEncoder:
    """Ids of a byte-level vocabulary by proposal and verification.

    Leftmost-longest matching proposes tokens for every unseen piece at once. A piece's proposal is its exact
    encoding if each proposed token is reachable by merges and no merge could ever happen across any two
    neighbours; both are table look-ups on arrays. Only pieces that fail are merged step by step.
    """

    def __init__(self, path: str):
        model = json.loads(Path(path).read_text(encoding="utf-8"))
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        size = max([*vocab.values(), *(t["id"] for t in model["added_tokens"])]) + 1
        self.added = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.added_pattern = re.compile("|".join(sorted(map(re.escape, self.added), key=len, reverse=True))) if self.added else None
        self.show = byte_letters()
        back = {c: b for b, c in self.show.items()}
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(back[ord(c)] for c in token)
        for token, i in self.added.items():
            raw[i] = token.encode()
        self.raw = raw
        self.raw_length = np.fromiter(map(len, raw), np.int64, size)
        self.raw_start = np.cumsum(self.raw_length) - self.raw_length
        self.raw_pool = np.frombuffer(b"".join(raw), np.uint8)
        self.size, never = size, len(merges) + 1
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merge[x, y] = (r, z)
            if self.rank[z] < 0:
                self.rank[z], self.left[z], self.right[z] = r, x, y
        keys = np.array([x * size + y for x, y in self.merge], np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], np.array([r for r, _ in self.merge.values()], np.int64)[order]
        self.never = never
        self.sound = np.ones(size, bool)
        made = np.flatnonzero(self.rank >= 0)
        self.sound[made] = self._compatible(self.left[made], self.right[made], top=False)
        for i in made[np.argsort(self.rank[made])]:
            self.sound[i] &= self.sound[self.left[i]] and self.sound[self.right[i]]
        self.machine = ahocorasick.Automaton()
        for token, i in vocab.items():
            self.machine.add_word(token, i)
        self.machine.make_automaton()
        self.single = {token: i for token, i in vocab.items() if self.sound[i]}
        self.letter = {chr(c): raw.index(bytes([b])) for b, c in self.show.items()}
        self.follow = {x * size + y: r << 20 | z for (x, y), (r, z) in self.merge.items()}
        self.memory = Memory()

    def _pair_rank(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        key = x * self.size + y
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], self.never)

    def _compatible(self, x: np.ndarray, y: np.ndarray, top: bool = True) -> np.ndarray:
        """Whether merging never crosses from token x into token y standing to its right.

        The edge tokens beside the boundary grow by merges whose ranks are known; walking back from the finished
        tokens, the last merge undone says until which rank each earlier pair stood side by side. A crossing merge of a lower rank would
        have come first; at equal ranks the one further left comes first. top: whether the finished pair counts.
        """
        x, y = x.astype(np.int64), y.astype(np.int64)
        good, live = np.ones(len(x), bool), np.arange(len(x))
        bar = np.full(len(x), self.never if top else -1, np.int64)  # crossing merges of a rank below it are wrong
        while len(live):
            bad = self._pair_rank(x, y) < bar
            good[live[bad]] = False
            rx, ry = self.rank[x], self.rank[y]
            keep = ~bad & ((rx >= 0) | (ry >= 0))
            live, x, y, rx, ry = live[keep], x[keep], y[keep], rx[keep], ry[keep]
            undo_y = ry >= rx
            bar = np.where(undo_y, ry + 1, rx)
            x, y = np.where(undo_y, x, self.right[x]), np.where(undo_y, self.left[y], y)
        return good

    def exact(self, shown: str) -> list[int]:
        """Step-by-step merging: the lowest rank first, the leftmost of equals first."""
        letter, follow, size, none = self.letter, self.follow.get, self.size, self.never << 20
        ids = [letter[c] for c in shown]
        next_ = [follow(x * size + y, none) for x, y in zip(ids, ids[1:])]
        while next_:
            best = min(next_)
            if best == none:
                break
            i = next_.index(best)
            ids[i : i + 2] = [best & 0xFFFFF]
            del next_[i]
            if i:
                next_[i - 1] = follow(ids[i - 1] * size + ids[i], none)
            if i < len(next_):
                next_[i] = follow(ids[i] * size + ids[i + 1], none)
        return ids

    def shown(self, piece: str) -> str:
        return piece.encode().decode("latin-1").translate(self.show)

    def _learn(self, pieces: list[str]) -> tuple[dict[str, bytes], int]:
        """Ids of each piece, and how many pieces had to be merged exactly."""
        out, open_, single = {}, [], self.single.get
        for piece in pieces:
            s = piece.encode().decode("latin-1").translate(self.show)
            i = single(s)
            if i is None:
                open_.append((piece, s))
            else:
                out[piece] = i.to_bytes(4, "little")
        if not open_:
            return out, 0
        shown = [s for _, s in open_]
        lengths = np.fromiter(map(len, shown), np.int64, len(shown))
        found = np.array(list(self.machine.iter_long("\n".join(shown))), np.int64).reshape(-1, 2)
        ends, ids = found[:, 0], found[:, 1]
        owner = np.searchsorted(np.cumsum(lengths + 1), ends, side="right")
        size = np.bincount(owner, weights=self.raw_length[ids], minlength=len(open_)).astype(np.int64)
        good = size == lengths
        good[owner[~self.sound[ids]]] = False
        near = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, back = np.unique(ids[near] * self.size + ids[near + 1], return_inverse=True)
        fits = self._compatible(pairs // self.size, pairs % self.size)[back]
        good[owner[near[~fits]]] = False
        stream, at = ids.astype("<u4").tobytes(), 0
        for (piece, s), n, ok in zip(open_, (4 * np.bincount(owner, minlength=len(open_))).tolist(), good.tolist()):
            out[piece] = stream[at : at + n] if ok else np.array(self.exact(s), "<u4").tobytes()
            at += n
        return out, int((~good).sum())

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens of a text; special tokens written in it come as ids."""
        if "<|" in text and self.added_pattern and self.added_pattern.search(text):
            out, at = [], 0
            for m in self.added_pattern.finditer(text):
                out += self.pieces_plain(text[at : m.start()])
                out.append(self.added[m[0]])
                at = m.end()
            return out + self.pieces_plain(text[at:])
        return self.pieces_plain(text)

    def pieces_plain(self, text: str) -> list[str]:
        if not _ODD.search(text):
            return _BYTE_PIECE.findall(text)
        return _general_pattern().findall(text)

    def _all(self, lists: list[list]) -> dict:
        known, fresh = self.memory.split(set().union(*lists))
        numbers = {p: p.to_bytes(4, "little") for p in fresh if p.__class__ is int}
        learned, _ = self._learn([p for p in fresh if p not in numbers])
        self.memory.add(learned)
        return known | learned | numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        lists = [self.pieces(t) for t in texts]
        get = self._all(lists).__getitem__
        return [b"".join(map(get, x)) for x in lists]

    def counts(self, lists: list[list]) -> list[list[int]]:
        """Tokens of each piece."""
        get = {p: len(v) // 4 for p, v in self._all(lists).items()}.__getitem__
        return [list(map(get, x)) for x in lists]

    def decode(self, ids: np.ndarray) -> str:
        """Bytes of the tokens one after the other; what isn't UTF-8 becomes U+FFFD."""
        ids = ids.astype(np.int64)
        return self.raw_pool[ranges(self.raw_start[ids], self.raw_length[ids])].tobytes().decode("utf-8", "replace")


@lru_cache
def _general_pattern():
    """The same split for any text, white space being Unicode's White_Space."""
    import regex

    space = r"\t-\r\x20\x85\xa0  -     　"
    return regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{space}\p{{L}}\p{{N}}]+|[{space}]+(?![^{space}])|[{space}]+")


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def byte_encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)
