"""Byte-pair encoding and decoding: greedy proposals, pair checks, and exact merges for the words that fail them."""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import tokenizer_files as files
from .arrow import give_back, with_columns

#: Encoded words in a generation of a task's memory. Two generations are kept; a word used in the younger one stays.
REMEMBERED = 120_000
NEVER = np.int64(1) << 40


@dataclass(frozen=True)
class Merges:
    """The merge rules as arrays by token id, made once on the driver.

    ``rank`` is the place of the rule that makes a token (-1: a sign), ``first`` and ``last`` its two parts. ``sound`` tokens are
    made by one rule, from sound parts made earlier, and come back whole when merged alone. ``keys`` are the pairs of parts of
    all rules (left * 2**32 + right), sorted, with their ranks in ``key_ranks``.
    """

    rank: np.ndarray
    first: np.ndarray
    last: np.ndarray
    sound: np.ndarray
    keys: np.ndarray
    key_ranks: np.ndarray

    @classmethod
    def of(cls, file: str) -> Merges:
        model = files.parsed(file)["model"]
        ids = model["vocab"]
        library, size = files.opened(file).model, max(ids.values()) + 1
        rank, first, last = np.full(size, -1, np.int64), np.arange(size), np.arange(size)
        sound, pairs = np.ones(size, bool), []
        for place, rule in enumerate(model["merges"]):
            left, right = rule if isinstance(rule, list) else rule.split(" ")
            made, a, b = ids[left + right], ids[left], ids[right]
            pairs.append((a << 32) | b)
            sound[made] &= rank[made] < 0 and sound[a] and sound[b]
            rank[made], first[made], last[made] = place, a, b
        for string, i in ids.items():
            sound[i] &= [t.id for t in library.tokenize(string)] == [i]
        keys = np.array(pairs, np.int64)
        order = np.argsort(keys, kind="stable")
        return cls(rank, first, last, sound, keys[order], order.astype(np.int64))

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merges keep each pair of tokens apart when they meet; False also where a token isn't sound.

        Both tokens are taken apart along their meeting edge, the later merge first. Whatever two parts lie there at one time,
        a rule for them would have run unless the left part was merged before it, or at the same rank, or the right one before it.
        """
        ok = self.sound[left] & self.sound[right]
        at = np.flatnonzero(ok)
        x, y = left[at], right[at]
        x_gone, y_gone = np.full(len(at), NEVER), np.full(len(at), NEVER)
        while len(at):
            key = (x << 32) | y
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rule = np.where(self.keys[place] == key, self.key_ranks[place], NEVER)
            crossed = (rule < x_gone) & (rule <= y_gone)
            ok[at[crossed]] = False
            x_made, y_made = self.rank[x], self.rank[y]
            go = ~crossed & (np.maximum(x_made, y_made) >= 0)
            at, x, y, x_made, y_made, x_gone, y_gone = (v[go] for v in (at, x, y, x_made, y_made, x_gone, y_gone))
            undo_x = x_made > y_made
            x, x_gone = np.where(undo_x, self.last[x], x), np.where(undo_x, x_made, x_gone)
            y, y_gone = np.where(undo_x, y, self.first[y]), np.where(undo_x, y_gone, y_made)
        return ok


class Encoder:
    """Encodes words in byte signs as the merges of a tokenizer file do.

    A list of tokens is what the merges give if no rule would have joined two of them across a place where they meet.
    So the longest vocabulary string at each place is proposed, all adjacent pairs are tested at once, and a word with a pair
    that fails is merged exactly.
    """

    def __init__(self, file: str, merges: Merges | None = None):
        self.cutter = files.Cutter(file)
        self.model = self.cutter.tokenizer.model
        self.merges = merges or Merges.of(file)
        ids = files.parsed(file)["model"]["vocab"]
        self.begins: dict[str, int] = {s[:n]: -1 for s in ids for n in range(1, len(s))} | ids  # of each start of a token: its id, or -1
        self.young: dict[bool, dict[str, bytes]] = {True: {}, False: {}}  # by plain text and by byte signs
        self.old: dict[bool, dict[str, bytes]] = {True: {}, False: {}}
        self.proposed = self.failed = 0
        strings = {i: bytes(files.TO_BYTES[c] for c in s) for s, i in ids.items()} | {i: s.encode() for s, i in self.cutter.special_ids.items()}
        self.known = max(strings) + 1
        listed = [strings.get(i, b"\xef\xbf\xbd") for i in range(self.known + 1)]  # the last stands for unknown ids
        self.bytes = np.frombuffer(b"".join(listed), np.uint8)
        self.size = np.array([len(s) for s in listed], np.int64)
        self.start = np.cumsum(self.size) - self.size

    def exact(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def propose(self, word: str) -> list[int]:
        """Greedy longest matches; empty if some sign starts no vocabulary string."""
        begins = self.begins
        whole = begins.get(word, -1)
        if whole >= 0:
            return [whole]
        out, at, end = [], 0, len(word)
        while at < end:
            best, stop = -1, at + 1
            found = begins.get(word[at:stop])
            while found is not None:
                if found >= 0:
                    best, after = found, stop
                stop += 1
                if stop > end:
                    break
                found = begins.get(word[at:stop])
            if best < 0:
                return []
            out.append(best)
            at = after
        return out

    def learn(self, words: list[str], plain: bool) -> None:
        """Encodes distinct words: proposals, one vectorised test of all adjacent pairs, exact merges where a pair fails."""
        spelled = [files.signs(w) for w in words] if plain else words
        proposals = [self.propose(w) for w in spelled]
        sizes = np.fromiter(map(len, proposals), np.int64, len(words))
        flat = np.fromiter((i for p in proposals for i in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        bad = sizes == 0
        bad[owner[~self.merges.sound[flat]]] = True
        inside = owner[:-1] == owner[1:]
        pairs, at = np.unique((flat[:-1][inside] << 32) | flat[1:][inside], return_inverse=True)
        fits = self.merges.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
        bad[owner[:-1][inside][~fits[at]]] = True
        self.proposed, self.failed = self.proposed + len(words), self.failed + int(bad.sum())
        known, packed, ends = self.young[plain], flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        begin = 0
        for word, sign, end, wrong in zip(words, spelled, ends, bad.tolist(), strict=True):
            known[word] = array("I", self.exact(sign)).tobytes() if wrong else packed[begin:end]
            begin = end

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [list(self.cutter.segments(x)) for x in texts]
        for kind in (True, False):
            if len(self.young[kind]) > REMEMBERED:
                self.old[kind], self.young[kind] = self.young[kind], {}
            young, old, seen = self.young[kind], self.old[kind], set()
            for parts in cut:
                for words, plain, special in parts:
                    if special is None and plain == kind:
                        seen.update(words)
            seen.difference_update(young)
            again = seen.intersection(old)
            young.update(zip(again, map(old.__getitem__, again), strict=True))
            if new := list(seen.difference(again)):
                self.learn(new, kind)
        out = []
        for parts in cut:
            held = []
            for words, plain, special in parts:
                held += [special.to_bytes(4, "little")] if special is not None else map(self.young[plain].__getitem__, words)
            out.append(b"".join(held))
        return out

    def decode(self, ids: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD, and so do ids that the vocabulary hasn't."""
        i = np.minimum(np.frombuffer(ids, "<u4").astype(np.int64), self.known)
        size = self.size[i]
        ends = np.cumsum(size)
        if not len(i):
            return ""
        place = np.repeat(self.start[i] - ends + size, size) + np.arange(ends[-1])
        return self.bytes[place].tobytes().decode("utf-8", "replace")


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", decoded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with n_tokens and ids (binary: little-endian unsigned 32-bit integers) of every whole text; with ``decoded``, also
    the text that the ids give back.

    Null and empty texts have no tokens, an empty table gives an empty result. Special strings inside a text become their special
    ids. Rows are independent, so ties, repeats and hot groups don't matter. Columns named as the results are replaced.
    """
    file = files.read(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast((file, Merges.of(file)))
    give_back()  # the parsed file was only needed here
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())] + [T.StructField("decoded", T.StringType())] * decoded

    def make():
        encoder = Encoder(*sent.value)

        def work(texts: list[str]) -> list[list]:
            ids = encoder.encode(texts)
            return [[len(x) // 4 for x in ids], ids] + [[encoder.decode(x) for x in ids]] * decoded

        return work

    return with_columns(docs, text, fields, make, keep)
