"""Byte-pair encoding of many words at once by an index of pair occurrences.

Each pair of neighbouring symbols that has a merge rank is listed with all its positions.  The active
ranks are applied in ascending order, each to all its positions together; every merge changes the pairs on
both sides, which move to the lists of their new ranks.  Words never touch each other, so applying a rank
to all words at once gives each word the merges it would get alone.
"""

from __future__ import annotations

import heapq
import json
import unicodedata

import numpy as np

from segue.llm.arrays import span_hashes

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
# The white space code points of Unicode.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None


def code_classes() -> np.ndarray:
    """LETTER, NUMBER, SPACE or OTHER of every code point."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        found = np.fromiter(
            (kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000
        )
        found[WHITE] = SPACE
        _classes = found
    return _classes


def byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves, the others for the code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    where = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(hidden)}
    return [chr(where[b]) for b in range(256)]


class Vocabulary:
    """Ids and merge ranks of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, ids = spec["model"], spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ends = model.get("end_of_word_suffix") or ""
        self.drops_space = bool(ends)
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int32)
        self.last = np.array([ids[s + ends] for s in symbols], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.left, self.right = left.astype(np.int32), right.astype(np.int32)
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        of_symbol = {s: b for b, s in enumerate(symbols)}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes = [b""] * size
        for token, i in {**ids, **self.special}.items():
            known = all(c in of_symbol for c in token)
            self.token_bytes[i] = bytes(of_symbol[c] for c in token) if known else token.encode()

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge rank of each pair of ids, -1 where there is none."""
        want = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], -1)


def encode_words(vocab: Vocabulary, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets) of words whose bytes follow each other in `data`; sizes are their numbers of bytes."""
    n = len(data)
    bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    sym = vocab.inner[data]
    tail = bounds[1:] - 1
    sym[tail] = vocab.last[data[tail]]
    after = np.arange(1, n + 1, dtype=np.int32)
    after[tail] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[bounds[:-1]] = -1

    lists: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def enter(at: np.ndarray, ranks: np.ndarray) -> None:
        good = ranks >= 0
        at, ranks = at[good], ranks[good]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        lows = [0, *cuts.tolist()]
        for a, b, r in zip(lows, [*lows[1:], len(at)], ranks[lows].tolist()):
            if r in lists:
                lists[r].append(at[a:b])
            else:
                lists[r] = [at[a:b]]
                heapq.heappush(heap, r)

    heads = np.flatnonzero(after >= 0).astype(np.int32)
    enter(heads, vocab.rank(sym[heads], sym[heads + 1]))
    while heap:
        r = heapq.heappop(heap)
        held = lists.pop(r)
        at = held[0] if len(held) == 1 else np.concatenate(held)
        a, b = vocab.left[r], vocab.right[r]
        if a == b:
            at = np.unique(at)
        right = after[at]
        good = (sym[at] == a) & (right >= 0) & (sym[right] == b)
        at, right = at[good], right[good]
        if not len(at):
            continue
        if a == b and len(at) > 1:
            # In a run of equal symbols every other pair merges, from the left.
            joined = np.concatenate([[False], right[:-1] == at[1:]])
            place = np.arange(len(at))
            start = np.maximum.accumulate(np.where(joined, 0, place))
            even = (place - start) % 2 == 0
            at, right = at[even], right[even]
        sym[at] = vocab.merged[r]
        sym[right] = -1
        beyond = after[right]
        after[at] = beyond
        linked = beyond >= 0
        before[beyond[linked]] = at[linked]
        lead = before[at]
        changed = np.concatenate([lead[lead >= 0], at[linked]])
        # A position can be listed twice, which does no harm: the second time it does the same again.
        if len(changed):
            enter(changed, vocab.rank(sym[changed], sym[after[changed]]))
    alive = sym >= 0
    counts = np.concatenate([[0], np.cumsum(alive)])
    return sym[alive], counts[bounds]


def pieces(codes: np.ndarray, offs: np.ndarray, drops_space: bool) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words that the two public patterns cut texts into; no word spans two texts.

    A run of letters, of numbers or of other signs is a word; an apostrophe alone with s, t, m, d, re, ve
    or ll behind it is one.  With `drops_space` white space goes and numbers stand alone; else one blank
    joins the word behind it, and the rest of a run of white space is a word.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = code_classes()[codes]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    edge[n] = True
    same_next = np.empty(n, bool)  # the next code point is in the same text
    same_next[:] = ~edge[1:]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | edge[1:n]
    if drops_space:
        start |= kind == NUMBER
    else:
        # The last of a run of white space before a word: its own word, or a blank that joins.
        last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & same_next[:-1])
        start[last] = True
        joins = last[codes[last] == 32]
        start[joins + 1] = False
    quote = np.flatnonzero((codes[:-1] == 39) & start[:-1] & same_next[:-1]) if n > 1 else np.zeros(0, np.int64)
    if len(quote):
        one = codes[quote + 1]
        two = np.where(quote + 2 < n, codes[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(same_next[quote + 1], two, 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        for hit, size in ((quote[short], 1), (quote[long], 2)):
            start[hit + 1] = False
            behind = hit + 1 + size
            behind = behind[behind < n]
            start[behind] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if drops_space:
        words = kind[starts] != SPACE
        starts, ends = starts[words], ends[words]
    return starts, ends


class WordTable:
    """Ids of every word met so far in a partition, found by the word's hash in an open-addressed array.

    The bytes of each word are kept beside its ids: a word that only shares the hash of another is encoded by itself."""

    SLOTS = 1 << 20
    MOST = 400_000

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.SLOTS, np.uint64)
        self.index = np.full(self.SLOTS, -1, np.int32)
        self.count = 0
        self.ids = np.zeros(0, np.int32)
        self.offs = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)
        self.byte_offs = np.zeros(1, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, -1 where it is new."""
        mask = np.uint64(self.SLOTS - 1)
        slot = (hashes & mask).astype(np.int64)
        found = self.index[slot]
        wrong = np.flatnonzero((found >= 0) & (self.keys[slot] != hashes))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (self.SLOTS - 1)
            found[wrong] = self.index[slot[wrong]]
            wrong = wrong[(found[wrong] >= 0) & (self.keys[slot[wrong]] != hashes[wrong])]
        return found

    def add(self, hashes: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct new words under their numbers."""
        left, slot = np.arange(len(hashes)), (hashes & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(left):
            free = left[self.index[slot[left]] < 0]
            self.index[slot[free]] = number[free]  # of several for one slot, one stays
            self.keys[slot[free]] = hashes[free]
            placed = np.zeros(len(hashes), bool)
            won = free[self.index[slot[free]] == number[free]]
            self.keys[slot[won]] = hashes[won]
            placed[won] = True
            left = left[~placed[left]]
            slot[left] = (slot[left] + 1) & (self.SLOTS - 1)

    def encode_new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Encode words together; their numbers."""
        sizes = ends - starts
        take = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        own = data[take]
        ids, offs = encode_words(self.vocab, own, sizes)
        number = np.arange(self.count, self.count + len(starts), dtype=np.int32)
        self.count += len(starts)
        self.ids = np.concatenate([self.ids, ids])
        self.offs = np.concatenate([self.offs, self.offs[-1] + offs[1:]])
        self.bytes = np.concatenate([self.bytes, own])
        self.byte_offs = np.concatenate([self.byte_offs, self.byte_offs[-1] + np.cumsum(sizes)])
        return number

    def differ(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Places of the words that are not the ones kept under their numbers."""
        sizes, at = ends - starts, self.byte_offs[number]
        other = self.byte_offs[number + 1] - at != sizes
        long = np.flatnonzero(~other & (sizes > 8))  # shorter ones of one size cannot share a hash
        held, bounds = sizes[long], np.concatenate([[0], np.cumsum(sizes[long])])
        step = np.arange(bounds[-1])
        unlike = data[np.repeat(starts[long] - bounds[:-1], held) + step] != self.bytes[np.repeat(at[long] - bounds[:-1], held) + step]
        other[long] = np.diff(np.concatenate([[0], np.cumsum(unlike)])[bounds]) > 0
        return np.flatnonzero(other)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Numbers of the words at these places; new ones are encoded together."""
        if self.count > self.MOST:
            self.clear()
        hashes = span_hashes(data, starts, ends)
        found = self.find(hashes)
        new = np.flatnonzero(found < 0)
        if len(new):
            distinct, at = np.unique(hashes[new], return_index=True)
            if self.count + len(distinct) > self.SLOTS * 3 // 4:
                self.grow(len(distinct))
            self.add(distinct, self.encode_new(data, starts[new[at]], ends[new[at]]))
            found[new] = self.find(hashes[new])
        for i in self.differ(data, starts, ends, found).tolist():
            found[i] = self.encode_new(data, starts[i : i + 1], ends[i : i + 1])[0]
        return found

    def grow(self, more: int) -> None:
        """More slots for one very large batch."""
        full = self.index >= 0
        keys, index = self.keys[full], self.index[full]
        while self.count + more > self.SLOTS * 3 // 4:
            self.SLOTS *= 2
        self.keys, self.index = np.zeros(self.SLOTS, np.uint64), np.full(self.SLOTS, -1, np.int32)
        self.add(keys, index)


def gather(flat: np.ndarray, offs: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs `which` of `flat` one behind the other, their bounds)."""
    sizes = offs[which + 1] - offs[which]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(offs[which] - bounds[:-1], sizes) + np.arange(bounds[-1])
    return flat[take], bounds


def lower_normalised(text: str) -> str:
    """Composed form in lower case, each code point by itself."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Encoder:
    """Ids of whole texts by a vocabulary file, one batch after the other."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)
        self.table = WordTable(self.vocab)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by text).  A null text is empty; strings of added tokens in a text are those tokens."""
        parts, text_of, special = [], [], []
        for i, text in enumerate(texts):
            rest = [text or ""]
            if "<|" in rest[0]:
                for token in self.vocab.special:
                    rest = [y for x in rest for y in (_between(x, token) if x not in self.vocab.special else [x])]
            for x in rest:
                token = self.vocab.special.get(x, -1) if len(rest) > 1 or x in self.vocab.special else -1
                parts.append("" if token >= 0 else lower_normalised(x) if self.vocab.drops_space else x)
                text_of.append(i)
                special.append(token)
        # A surrogate alone has no UTF-8 form; it becomes a question mark, as in any lossy conversion.
        whole = "".join(parts)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        offs = np.concatenate([[0], np.cumsum(lengths)])
        codes = np.frombuffer(whole.encode("utf-32-le", "replace"), "<u4")
        data = np.frombuffer(whole.encode("utf-8", "replace"), np.uint8)
        starts, ends = pieces(codes, offs, self.vocab.drops_space)
        first = np.searchsorted(starts, offs)
        if len(data) != len(codes):
            at = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
            starts, ends = at[starts], at[ends]
        words = self.table.words(data, starts, ends)
        ids, bounds = gather(self.table.ids, self.table.offs, words)
        by_part = bounds[first]
        by_text = by_part[np.searchsorted(np.asarray(text_of), np.arange(len(texts) + 1))] if parts else np.zeros(1, np.int64)
        special_at = np.flatnonzero(np.asarray(special) >= 0)
        if len(special_at):
            owner = np.asarray(text_of)[special_at]
            ids = np.insert(ids, by_part[special_at], np.asarray(special, np.int32)[special_at])
            by_text = by_text + np.searchsorted(owner, np.arange(len(texts) + 1))
        return ids, by_text


def _between(text: str, token: str) -> list[str]:
    """The text cut at a token, with the token between the cuts."""
    out = []
    for x in text.split(token):
        out += [x, token]
    return out[:-1]
