"""Evaluation texts leaking into training text.

Texts are reduced to their words (lower case, one blank between them, apostrophes dropped) without cue numbers, timings,
settings, styling codes and bracketed sound descriptions. Items of more than `PART_WORDS` words are
cut into parts that share `SHARED` words, more than the shortest passage that counts within any longer one. Parts fill blocks of about
`BLOCK_CHARS` characters, so what is broadcast is bounded however many items there are and however long one is; each block is
looked up in one pass. One block is looked up while the documents are cleaned; for several the cleaned corpus is written once.

Filter: every character q-gram of a document is looked up among the items' q-grams. Hits are counted in diagonal bands of
BAND characters (document position minus item position) that overlap by half, so edits that shift a passage by up to
half a band stay within one. A damaged word of w characters spoils at most w + q - 1 q-grams, so by the edit budget each
item has a least count of hits, and a least distance between the first and the last, that every true passage must reach;
both are worked out exactly for each item. Of these regions the ones stay that hold all but three of 2 * PER item words in a row, as any
true passage does, up to SHIFT words off the hits' distance, as damage may split or join words. What is left is verified: banded alignment of the item
against the document tells for each item word whether it is exact, damaged (at most EDITS edits, and fewer than half of its
letters, or signs that look alike confused) or lost, and a pair is reported if `WORDS` or more words in a row are not lost with at most
one in `PER` damaged.

Defined cases: null or empty texts and items give nothing; items of fewer than `WORDS` words can't leak; repeated documents are
each reported; documents are read whole, very long ones in pieces that overlap by more than a part; repeated items are each reported.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.subtitles import STYLE
from siltstone.runtime import cut

Q, LEAST, BAND, WORDS, PER, EDITS, SHIFT = 16, 6, 32, 15, 8, 3, 3
#: Candidates aligned at once, the entries of their table of moves, and the characters of candidates that wait.
LANES, MOVES, WAITING = 512, 1 << 26, 1 << 21
#: Offsets that an alignment may take, and characters beyond them in which the last word may end.
OFFSETS, ROOM = BAND + 2 * EDITS + 1, 32
BLOCK_CHARS, PIECE_CHARS, PART_WORDS, SHARED = 2_000_000, 400_000, 512, 64
#: Pairs of signs that character recognition takes for one.
ALIKE = (("rn", "m"), ("vv", "w"), ("li", "h"), ("cl", "d"), ("0", "o"), ("1", "l"), ("5", "s"))
_B = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(int(_B), -1, 1 << 64))

#: Parts of a text set aside. Line forms begin with their line break, so that most positions fail at one comparison.
_NOISE = re.compile(
    r"\n(?:(?:[ \t]*\d+[ \t]*\n)?[ \t]*\d[\d:.,]*[ \t]*-+>[^\n]*|\{\d+\}\{\d+\}|[ \t]*\d+[ \t]*(?=\n)|WEBVTT[^\n]*|[ \-]*\*[^*\n]*\*[ ]*(?=\n)|[ \-]*#[^#\n]*#[ ]*(?=\n))"
    r"|\[[^\[\]\n]*\]|\([^()\n]*\)|♪[^♪\n]*♪",
    re.ASCII,
)
_STYLE = re.compile(STYLE, re.ASCII)
_APOSTROPHES = "'’´`"


@cache
def _signs() -> np.ndarray:
    """For each code point itself if it is a letter or number, 0 if it is dropped, else a blank; the planes above the third hold neither letters nor numbers."""
    out = np.full(0x110000, 32, np.uint32)
    for k in range(0x40000):
        if unicodedata.category(chr(k))[0] in "LN":
            out[k] = k
    out[[ord(x) for x in _APOSTROPHES]] = 0
    return out


def words_only(texts: list[str]) -> np.ndarray:
    """The words of subtitle or plain texts, one blank between them and a line break after each text."""
    if not texts:
        return np.zeros(0, np.uint32)
    bare = []
    for t in texts:
        t = t.replace("\ufeff", "").replace("\r\n", "\n").replace("\r", "\n")
        bare.append(_NOISE.sub(" ", f"\n{_STYLE.sub('', t)}\n").lower())
    codes = _signs()[_codes("\n".join(bare))]
    codes[np.cumsum([len(t) + 1 for t in bare[:-1]], dtype=np.int64) - 1] = 10
    codes = np.append(codes[codes != 0], np.uint32(10))
    blank = codes == 32
    codes = codes[~np.append(False, blank[1:] & blank[:-1])]
    end = np.append(True, codes == 10)
    return codes[~((codes == 32) & (end[:-1] | np.append(end[2:], False)))]


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _B), np.full(n, _INV)
    up[0] = down[0] = np.uint64(1)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def qgram_hashes(codes: np.ndarray, up: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Polynomial hash modulo 2^64 of each q-gram, from wrapped prefix sums."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[: len(codes)], dtype=np.uint64)])
    h = (sums[Q:] - sums[:n]) * down[:n]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(codes: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, hash) of each word."""
    gap = (codes == 32) | (codes == 10)
    starts = np.concatenate([[0], np.flatnonzero(gap) + 1])
    ends = np.concatenate([np.flatnonzero(gap), [len(codes)]])
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.astype(np.uint64) * up[: len(codes)], dtype=np.uint64)])
    return starts, (sums[ends] - sums[starts]) * down[starts]


def least_hits(words: list[tuple[int, int]], grams: np.ndarray) -> tuple[int, int]:
    """(count, span) that the indexed q-grams of any true passage of an item reach at least.

    words: start and end of each word; grams: sorted positions of the item's indexed q-grams. A passage either holds WORDS
    words with one damaged, or 2 * PER words with two, or lies around three runs: in 2 * PER words or more no window of
    2 * PER holds as few as two only if all the damage lies between PER whole words on either side. So these three
    kinds bound every longer passage too."""
    lo, hi = np.array([a for a, _ in words]), np.array([b for _, b in words])
    least = (1 << 30, 1 << 30)

    def runs(*bounds: tuple[np.ndarray, np.ndarray]) -> None:
        nonlocal least
        n, first, last = 0, None, None
        for a, b in bounds:  # exact characters [a, b) hold the q-grams that start in [a, b - Q]
            i, j = np.searchsorted(grams, a), np.searchsorted(grams, b - Q, side="right")
            some = j > i
            f = np.where(some, grams[np.minimum(i, len(grams) - 1)], 1 << 30)
            g = np.where(some, grams[np.maximum(j - 1, 0)], -1)
            n = n + np.maximum(j - i, 0)
            first, last = (f, g) if first is None else (np.minimum(first, f), np.maximum(last, g))
        if np.size(n):
            least = min(least[0], int(np.min(n))), min(least[1], int(np.min(np.where(n > 0, last - first, 0))))

    if not len(grams):
        return 0, 0
    k = len(words)
    s = np.arange(max(0, k - WORDS + 1))[:, None]
    x = s + np.arange(WORDS)[None, :]
    runs((lo[s], lo[x]), (hi[x], hi[s + WORDS - 1]))
    m = 2 * PER
    s = np.arange(max(0, k - m + 1))[:, None]
    p, q = np.triu_indices(m, 1)
    runs((lo[s], lo[s + p]), (hi[s + p], lo[s + q]), (hi[s + q], hi[s + m - 1]))
    s = np.arange(max(0, k - 3 * PER + 1))
    runs((lo[s], hi[s + PER - 1]), (lo[s + 2 * PER], hi[s + 3 * PER - 1]))
    return least


class ItemIndex:
    """q-grams of a block of items; pickled to the tasks.

    An item's q-grams that few places of the block share are indexed first; commoner ones are added only until
    every true passage of the item must hold `LEAST` indexed q-grams, or all are in."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, t) for i, t in items if t and len(t.split(" ")) >= WORDS]
        self.ids = [i for i, _ in items]
        self.codes = [_codes(t) for _, t in items]
        self.longest = max(map(len, self.codes), default=0)
        up, down = _powers(self.longest + 1)
        hashes = [qgram_hashes(c, up, down) for c in self.codes]
        keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)
        kept, self.least = [np.zeros(0, np.uint64)], np.zeros((len(items), 2), np.int64)
        item, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k, ((_, t), h) in enumerate(zip(items, hashes, strict=True)):
            ends = np.cumsum([len(w) + 1 for w in t.split(" ")]) - 1
            words = [(int(e) - len(w), int(e)) for w, e in zip(t.split(" "), ends, strict=True)]
            shared = counts[np.searchsorted(keys, h)]
            for most in (2, 4, 8, 16, 1 << 60):
                grams = np.flatnonzero(shared <= most)
                count, span = least_hits(words, grams)
                if count >= LEAST:
                    break
            self.least[k] = max(1, count), span
            kept.append(h[grams])
            item.append(np.full(len(grams), k))
            pos.append(grams)
        h = np.concatenate(kept)
        order = np.argsort(h, kind="stable")
        self.item, self.pos = np.concatenate(item)[order], np.concatenate(pos)[order]
        self.keys, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        # hashes of each item's words, padded, and the word that begins at or before each character
        self.words = np.zeros((len(items), max((len(t.split(" ")) for _, t in items), default=0) + 2 * PER), np.uint64)
        self.word_at = []
        for k, c in enumerate(self.codes):
            begin, h2 = word_hashes(c, up, down)
            self.words[k, : len(h2)] = h2
            self.word_at.append(np.searchsorted(begin, np.arange(len(c)), side="right") - 1)
        self.offset = np.concatenate([[0], np.cumsum([len(c) for c in self.codes])]).astype(np.int64)
        self.word_at = np.concatenate([np.zeros(0, np.int64), *self.word_at])
        self.bits = max(16, int(np.ceil(np.log2(len(h) + 1))) + 5)
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.keys >> np.uint64(64 - self.bits)] = True


def _candidates(ix: ItemIndex, codes: np.ndarray, starts: np.ndarray, up: np.ndarray, down: np.ndarray):
    """(text, item, diagonal of the band's middle) of each region that reaches its item's least count and span. starts: offsets of the texts."""
    none = np.zeros(0, np.int64)
    if not len(ix.keys):
        return none, none, none
    h = qgram_hashes(codes, up, down)
    at = np.flatnonzero(ix.seen[h >> np.uint64(64 - ix.bits)])
    k = np.minimum(np.searchsorted(ix.keys, h[at]), len(ix.keys) - 1)
    same = ix.keys[k] == h[at]
    at, k = at[same], k[same]
    if not len(at):
        return none, none, none
    n = ix.count[k]
    which = np.repeat(np.arange(len(at)), n)
    entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(ix.first[k], n)
    text = np.searchsorted(starts, at, side="right") - 1
    item, text, pos = ix.item[entry], text[which], ix.pos[entry]
    half = BAND // 2
    diag = (at[which] - starts[text] - pos + ix.longest) // half + 1  # in half bands, never negative
    span = np.int64((len(codes) + 2 * ix.longest) // half + 4)
    key = (text * len(ix.ids) + item) * span + diag
    order = np.argsort(key, kind="stable")
    key, pos, at = key[order], pos[order], at[which][order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own, got = key[head], np.diff(np.concatenate([head, [len(key)]]))
    low, high = np.minimum.reduceat(pos, head), np.maximum.reduceat(pos, head)
    # the band numbered b holds the half bands b and b + 1; a half band after a gap also makes the band that begins in the gap
    next_to = own[1:] == own[:-1] + 1
    after, begins = np.append(next_to, False), np.flatnonzero(~np.append(False, next_to))
    then = np.minimum(np.arange(len(own)) + 1, len(own) - 1)
    least = ix.least[own // span % len(ix.ids)]

    def enough(n: np.ndarray, lo: np.ndarray, hi: np.ndarray, need: np.ndarray) -> np.ndarray:
        return (n >= need[:, 0]) & (hi - lo >= need[:, 1])

    both = enough(got + np.where(after, got[then], 0), np.where(after, np.minimum(low, low[then]), low), np.where(after, np.maximum(high, high[then]), high), least)
    alone = enough(got[begins], low[begins], high[begins], least[begins])
    some = both.copy()
    some[then[both & after]] = True
    some[begins[alone]] = True
    if not some.any():
        return none, none, none
    # whole words: in 2 * PER item words in a row, all but three must stand in the document near one of the hits' word distances
    hits = np.repeat(some, got)
    of, pos, at = np.repeat(np.arange(len(own)), got)[hits], pos[hits], at[hits]
    begin, words = word_hashes(codes, up, down)
    far = np.searchsorted(begin, at, side="right") - 1 - ix.word_at[ix.offset[own[of] // span % len(ix.ids)] + pos]
    fresh = np.concatenate([[True], (of[1:] != of[:-1]) | (far[1:] != far[:-1])])
    of, far = of[fresh], far[fresh]
    width = int(ix.words.shape[1])
    reach = np.int64(len(words) + 2 * width + 2)
    pairs, rank = np.unique(own[of] // span, return_inverse=True)
    fars, place = np.unique(rank * reach + far + width, return_inverse=True)
    item, far = pairs[fars // reach] % len(ix.ids), fars % reach - width
    padded = np.concatenate([np.zeros(width + SHIFT, np.uint64), words, np.zeros(width + SHIFT + 1, np.uint64)])
    near_enough = np.zeros(len(fars), bool)
    for part in np.array_split(np.arange(len(fars)), len(fars) * width // 500_000 + 1):
        wanted = ix.words[item[part]]
        there = padded[(far[part] + width)[:, None] + np.arange(width + 2 * SHIFT)]
        near = wanted == there[:, :width]
        for shift in range(1, 2 * SHIFT + 1):
            near |= wanted == there[:, shift : shift + width]
        sums = np.cumsum(near & (wanted != 0), axis=1, dtype=np.int32)
        sums[:, 2 * PER :] -= sums[:, : -2 * PER].copy()
        near_enough[part] = sums.max(axis=1, initial=0) >= 2 * PER - 3
    keep = np.zeros(len(own), bool)
    keep[of[near_enough[place]]] = True
    key = np.sort(np.concatenate([own[both & (keep | (after & keep[then]))], own[begins[alone & keep[begins]]] - 1]))
    pair = key // span
    return pair // len(ix.ids), pair % len(ix.ids), (key % span) * half - ix.longest


def parts_of(text: str) -> list[str]:
    """A text of words in parts of at most PART_WORDS words that share SHARED."""
    words = text.split(" ")
    starts = range(0, max(1, len(words) - SHARED), PART_WORDS - SHARED)
    return [" ".join(words[a : a + PART_WORDS]) for a in starts]


def look(word: str) -> str:
    """A word with signs that look alike made equal."""
    for two, one in ALIKE:
        word = word.replace(two, one)
    return word


def _token(lane: np.ndarray, a: int, b: int) -> str:
    """The document's words that the characters [a, b) of a lane belong to."""
    while a > 0 and lane[a - 1] not in (32, 10, 0):
        a -= 1
    while b < len(lane) and lane[b] not in (32, 10, 0):
        b += 1
    return lane[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace")


def leaking(items: list[np.ndarray], lanes: np.ndarray) -> list[bool]:
    """Whether each lane holds a passage of its item. Its words are 0 exact, 1 damaged, 2 lost.

    lanes[c, i + j] is the document's character i + j steps after lane c's start; character i of item c may align with
    offsets j of the band. Costs are unit edits, ends are free, all lanes advance together; shorter items are padded
    with a sign that matches nothing, which costs every offset the same."""
    n, c = max(map(len, items)), len(items)
    w = OFFSETS
    item = np.full((n, c, 1), 0xFFFFFFFF, np.uint32)
    for k, own in enumerate(items):
        item[: len(own), k, 0] = own
    js = np.arange(w, dtype=np.int32)
    cost = np.zeros((c, w), np.int32)
    moves = np.empty((n, c, w), np.int8)  # 0 match, 1 substitution, 2 item character missing in the document; 4: more of the document
    up = np.full_like(cost, 1 << 20)
    for i in range(n):
        diag = cost + (lanes[:, i : i + w] != item[i])
        up[:, :-1] = cost[:, 1:] + 1  # a document character less: the offset falls by one
        best = np.minimum(diag, up)
        run = np.minimum.accumulate(best - js, axis=1) + js
        moves[i] = np.where(run < best, 4, np.where(diag <= up, diag - cost, 2))
        cost = run
    edits = np.zeros((c, n + 1), np.int32)
    place = np.zeros((c, n), np.int32)
    j = cost.argmin(axis=1)
    lane = np.arange(c)
    for i in range(n - 1, -1, -1):
        m = moves[i, lane, j]
        while (more := m == 4).any():
            edits[more, i + 1] += 1
            j = np.where(more, j - 1, j)
            m = moves[i, lane, j]
        edits[:, i + 1] += m > 0
        place[:, i] = i + j
        j = np.where(m == 2, np.minimum(j + 1, w - 1), j)
    sums = np.cumsum(edits, axis=1)
    out = []
    for k, (own, s) in enumerate(zip(items, sums, strict=True)):
        blank = np.flatnonzero(own == 32)
        starts, ends = np.concatenate([[0], blank + 1]), np.concatenate([blank, [len(own)]])
        bad = s[ends] - s[np.maximum(starts - 1, 0)]  # a word takes the edits of the blank before it
        state = np.where(bad == 0, 0, np.where((bad <= EDITS) & (2 * bad < np.maximum(ends - starts, 3)), 1, 2))
        short = (state == 2) & (bad <= EDITS)  # short words: one sign read as two is two edits
        if short.any() and not leaks(state) and leaks(np.where(short, 1, state)):
            for x in np.flatnonzero(short):
                a, b = starts[x], ends[x]
                word = own[a:b].astype("<u4").tobytes().decode("utf-32-le", "replace")
                if look(_token(lanes[k], place[k, a], place[k, b - 1] + 1)) == look(word):
                    state[x] = 1
        out.append(leaks(state))
    return out


def leaks(state: np.ndarray) -> bool:
    """WORDS or more words in a row, none lost, at most one in PER damaged."""
    lost = np.concatenate([[-1], np.flatnonzero(state == 2), [len(state)]])
    for k in np.flatnonzero(np.diff(lost) > WORDS):
        run = state[lost[k] + 1 : lost[k + 1]]
        # words [i, j) are a passage if PER * (damaged before j) - j <= PER * (damaged before i) - i
        t = PER * np.concatenate([[0], np.cumsum(run)]) - np.arange(len(run) + 1)
        if (t[WORDS:] <= np.maximum.accumulate(t)[:-WORDS]).any():
            return True
    return False


def _lanes(ix: ItemIndex, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, cand) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, item, the text's characters that the item may align with) of each candidate."""
    half = BAND // 2 + EDITS
    for text, k, mid in zip(*(x.tolist() for x in cand), strict=True):
        lane = np.zeros(len(ix.codes[k]) + OFFSETS + ROOM, np.uint32)
        a = int(starts[text]) + mid - half
        lo, hi = max(a, int(starts[text])), min(a + len(lane), int(ends[text]))
        if hi > lo:
            lane[lo - a : hi - a] = codes[lo:hi]
        yield text, k, lane


def _verified(ix: ItemIndex, pending: list[tuple[int, int, np.ndarray]]) -> set[tuple[int, int]]:
    """The (document, index of an item) among those of the lanes that hold a passage; short items first, so that lanes of like length go together."""
    found: set[tuple[int, int]] = set()
    pending = sorted(pending, key=lambda x: len(x[2]))
    while pending:
        few = max(1, min(LANES, MOVES // (len(pending[0][2]) * OFFSETS)))
        while few > 1 and len(pending[min(few, len(pending)) - 1][2]) * few * OFFSETS > MOVES:
            few //= 2
        part, pending = pending[:few], pending[few:]
        lanes = np.zeros((len(part), max(len(x) for _, _, x in part)), np.uint32)
        for row, (_, _, lane) in zip(lanes, part, strict=True):
            row[: len(lane)] = lane
        found.update((d, k) for (d, k, _), yes in zip(part, leaking([ix.codes[k] for _, k, _ in part], lanes), strict=True) if yes)
    return found


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, words)."""
    for batch in batches:
        for ids, texts in _groups(batch, PIECE_CHARS):
            words = words_only(texts).tobytes().decode("utf-32-le", "surrogatepass").split("\n")[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], names=["id", "words"])


def _groups(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of a batch's rows in order, of up to `most` characters or one text."""
    ids, texts, size = [], [], 0
    for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        if size + len(text) > most and texts:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(k)
        texts.append(text)
        size += len(text) + 1
    if texts:
        yield ids, texts


def _as_is(texts: list[str]) -> np.ndarray:
    return _codes("".join(f"{t}\n" for t in texts))


def _search(shared, words: Callable[[list[str]], np.ndarray], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: ItemIndex = shared.value
        overlap = index.longest + 2 * BAND
        most = max(least, 4 * overlap)
        up, down = _powers(2 * most + 2)

        def pieces(batch: pa.RecordBatch) -> Iterator[tuple[list, np.ndarray]]:
            for ids, texts in _groups(batch, most):
                codes = words(texts)
                if len(ids) > 1 or len(codes) <= most:
                    yield ids, codes
                    continue
                codes = codes[:-1]
                for a in range(0, max(1, len(codes) - overlap), most - overlap):
                    yield ids, np.append(codes[a : a + most], np.uint32(10))

        for batch in batches:
            out, pending, size = set(), [], 0
            for ids, codes in pieces(batch):
                ends = np.flatnonzero(codes == 10)
                starts = np.concatenate([[0], ends[:-1] + 1])
                cand = _candidates(index, codes[:-1], starts, up, down)
                for t, k, lane in _lanes(index, codes, starts, ends, cand):
                    pending.append((ids[t], k, lane))
                    size += len(lane)
                    if size >= WAITING:
                        out |= _verified(index, pending)
                        pending, size = [], 0
            out |= _verified(index, pending)
            pairs = {(d, index.ids[k]) for d, k in out}
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], pa.int64()), pa.array([i for _, i in pairs], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaked_items(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id") -> DataFrame:
    """Distinct (doc_id, item_id)."""
    spark = documents.sparkSession

    def texts(df: DataFrame, k: str, t: str) -> DataFrame:
        return df.select(F.col(k).cast("long").alias("id"), F.make_valid_utf8(F.col(t)).alias("words")).filter("id is not null and words is not null")

    def blocks() -> Iterator[list[tuple[int, str]]]:  # at most three on the driver at once
        block, size = [], 0
        for i, t in texts(items, item, "text").mapInArrow(_clean, "id long, words string").toLocalIterator():
            for part in parts_of(t) if t else []:
                if size + len(part) > BLOCK_CHARS and block:
                    yield block
                    block, size = [], 0
                block.append((i, part))
                size += len(part)
        yield block

    def found(corpus: DataFrame, block: list[tuple[int, str]], words: Callable[[list[str]], np.ndarray]) -> DataFrame:
        return corpus.mapInArrow(_search(spark.sparkContext.broadcast(ItemIndex(block)), words, PIECE_CHARS), "doc_id long, item_id long").distinct()

    corpus, rest = texts(documents, key, text), blocks()
    block, later = next(rest), next(rest, None)
    if later is None:
        return found(corpus, block, words_only)
    corpus = cut(corpus.mapInArrow(_clean, "id long, words string").filter("words <> ''"))
    tables = [cut(found(corpus, b, _as_is)) for b in chain([block, later], rest)]
    return reduce(DataFrame.unionByName, tables).distinct()
