"""Token ids of whole columns of text: vectorised cutting, one look-up per distinct piece.

A byte-level BPE merges inside pieces only, and pieces follow from character
classes. So a chunk of texts is cut with numpy, and the tokenizer sees every
distinct piece once; a bounded memory of pieces is kept between chunks.
"""

import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from runledger.llm.textops import Hasher, mix

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
PIECES_IN_MEMORY = 400_000
# The characters with the White_Space property, and the endings
# that stand as a piece after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]
# Further up and among unassigned characters, classes differ between Unicode
# versions; texts with such characters go to the tokenizer as they are.
KNOWN_BELOW = 0x2E80


@lru_cache(1)
def classes():
    table = np.zeros(KNOWN_BELOW, np.uint8)
    for code in range(KNOWN_BELOW):
        kind = unicodedata.category(chr(code))
        table[code] = {"L": LETTER, "N": NUMBER}.get(kind[0], 255 if kind == "Cn" else OTHER)
    table[WHITE_SPACE] = SPACE
    return table


def piece_starts(codes, bounds):
    """Mask of the code points at which a piece begins; no piece crosses a row bound."""
    kind = classes()[codes]
    n = len(codes)
    start = np.zeros(n + 1, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    start[bounds] = True
    run = start.copy()
    row_end = np.zeros(n + 1, dtype=bool)
    row_end[bounds] = True
    # A blank run before other text gives up its last character; a space joins what follows.
    last = np.flatnonzero((kind == SPACE) & run[1:] & ~row_end[1:])
    start[last] = True
    joins = last[codes[last] == 0x20]
    start[joins + 1] = False
    # A lone apostrophe that begins a piece takes a known ending with it.
    quote = np.flatnonzero((codes == 0x27) & start[:n] & run[1:] & ~row_end[1:])
    for ending in ENDINGS:
        if not len(quote):
            break
        size = len(ending)
        at = quote[quote + size < n]
        fits = np.ones(len(at), dtype=bool)
        for k, letter in enumerate(ending, 1):
            fits &= codes[at + k] == ord(letter)
            if k > 1:
                fits &= ~row_end[at + k]
        at = at[fits]
        start[at + 1] = False
        start[at + 1 + size] |= ~row_end[at + 1 + size]
        quote = np.setdiff1d(quote, at)
    return start[:n]


def _bytes_of_symbols():
    """The byte behind every printable stand-in character of a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of text columns as the tokenizer file defines them, with the pieces seen so far.

    New pieces are merged in bulk by the ranks of the file's own vocabulary,
    where ids rise in merge order; whole texts fall back on the tokenizer. With
    added_tokens the content of an added token in a text gets the token's own
    id, as the tokenizer does by default; without, it is text like any other.
    """

    def __init__(self, tokenizer_path, added_tokens=False):
        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = not added_tokens
        stand_in = _bytes_of_symbols()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(stand_in[c] for c in token): number
                 for token, number in self.tokenizer.get_vocab(with_added_tokens=False).items()
                 if token not in special}
        self.whole = sorted(special) if added_tokens else []
        self.merger = tiktoken.Encoding("pieces", pat_str=r" ?\S+|\s", mergeable_ranks=ranks, special_tokens={})
        self.newline = ranks[b"\n"]
        self.hasher = Hasher()
        self._forget()

    def _plain(self, text):
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _learn(self, hashes, pieces, blank):
        """Add the ids of new pieces, whose hashes are sorted, to the memory.

        Pieces with text go through as one text with a line for each, which is
        cut again at the ids of the line ends.
        """
        ids = np.array(self.merger.encode_ordinary("\n".join(p for p, b in zip(pieces, blank) if not b)), np.uint32)
        ends = np.append(np.flatnonzero(ids == self.newline), len(ids))
        lows = np.concatenate([[0], ends[:-1] + 1])
        low, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        text = ~blank
        if text.any():
            low[text], size[text] = lows, ends - lows
        parts, total = [ids], len(ids)
        for i in np.flatnonzero(blank):
            parts.append(self._plain(pieces[i]))
            low[i], size[i] = total, len(parts[-1])
            total += size[i]
        self.low = np.concatenate([self.low, low + len(self.ids)])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *parts])
        self.known = np.concatenate([self.known, hashes])
        order = np.argsort(self.known, kind="stable")  # two sorted runs: a merge
        self.known, self.low, self.size = self.known[order], self.low[order], self.size[order]

    def _forget(self):
        self.known, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.low, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _find(self, hashes):
        """(place in the memory, whether it is there) of every hash."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), dtype=bool)
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return place, self.known[place] == hashes

    def rows(self, column):
        """(flat ids, bounds) of a string column; null is empty text."""
        texts = pc.fill_null(column, "").cast(pa.large_string())
        whole = texts.to_pylist()
        joined = "".join(whole)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        sizes = np.fromiter(map(len, whole), np.int64, len(whole))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        table = classes()
        odd = codes >= KNOWN_BELOW
        odd |= table[np.where(odd, 0, codes)] == 255
        apart = np.zeros(len(whole), dtype=bool)
        if odd.any():
            seen = np.concatenate([[0], np.cumsum(odd)])
            apart = seen[bounds[1:]] > seen[bounds[:-1]]
        for content in self.whole:
            if content in joined:  # perhaps only across a row bound
                apart |= np.fromiter((content in t for t in whole), bool, len(whole))
        if apart.any():
            return self._mixed(whole, apart)
        return self._fast(joined, codes, bounds)

    def _mixed(self, texts, apart):
        usual = [t for t, o in zip(texts, apart) if not o]
        flat, bounds = self.rows(pa.array(usual, pa.large_string()))
        parts, seen = [], 0
        for text, o in zip(texts, apart):
            if o:
                parts.append(self._plain(text))
            else:
                parts.append(flat[bounds[seen]:bounds[seen + 1]])
                seen += 1
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    def _fast(self, joined, codes, bounds):
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts = np.flatnonzero(piece_starts(codes, bounds[:-1][bounds[:-1] < len(codes)]))
        ends = np.append(starts[1:], len(codes))
        sums = self.hasher.prefix_of(mix(codes.astype(np.uint64) + np.uint64(1)))
        hashes = self.hasher.spans(sums, starts, ends, codes)
        distinct, first, place = np.unique(hashes, return_index=True, return_inverse=True)
        _, there = self._find(distinct)
        new = np.flatnonzero(~there)
        if len(self.known) + len(new) > PIECES_IN_MEMORY:
            self._forget()
            new = np.arange(len(distinct))
        if len(new):
            at = first[new]
            pieces = [joined[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            self._learn(distinct[new], pieces, classes()[codes[ends[at] - 1]] == SPACE)
        found, _ = self._find(distinct)
        low, counts = self.low[found][place], self.size[found][place]
        until = np.cumsum(counts)
        flat = self.ids[np.repeat(low - (until - counts), counts) + np.arange(until[-1])]
        until = np.concatenate([[0], until])
        return flat, until[np.searchsorted(starts, bounds)]


@lru_cache(1)
def encoder(tokenizer_path):
    """One encoder per Python worker, kept from task to task; its ids are those of the unmodified tokenizer."""
    return Encoder(tokenizer_path, added_tokens=True)
