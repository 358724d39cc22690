"""Exact ids of the tokenizers library, which encodes each distinct word of a batch of texts once; ids of words are kept within bounds.

A blank with a non-white character on both sides is always a border between pre-tokens of the vocabularies
used here (their patterns take a blank only as the first character of a pre-token, or drop it), so a text can be
cut there and the pieces' ids concatenated. Blanks next to other white space are never cut at. Distinct pieces are
found, and their ids put together, by array operations.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
from array import array

import numpy as np

SAFE = re.compile(r"(?<=\S) (?=\S)")
#: ends of lines between characters that aren't white: pre-tokens of their own in the byte vocabulary
LINES = re.compile(r"\n(?<=\S\n)(?=\S)")
SIGNS = ".,;:!?*$%&#"
#: what Python, unlike the tokenizers library, takes for white space or lower-cases by context
UNLIKE = re.compile("[\x1c-\x1f\u0130\u03a3]")
#: blanks beside white space, and white space that may be beside blanks
BESIDE, WHITE = ("  ", " \n", "\n "), [chr(c) for c in range(1 << 16) if chr(c).isspace() and chr(c) not in " \n"]
#: pieces encoded as one string, and strings encoded at once
JOINED, STRINGS = 512, 40
#: the characters that stand for bytes in byte-level vocabularies; ends of lines part words
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = "".join("\n" if b == 10 else chr(b) if b in _SHOWN else chr(256 + b - sum(x < b for x in _SHOWN)) for b in range(256))


class CachedEncoder:
    """Text to ids as little-endian unsigned 32-bit bytes; special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, limit: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import pyarrow as pa
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: the library's model of the same file, for words of letters, which need no rules to be found
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        #: the vocabulary lower-cases and drops white space, so pieces can be cut at any and shared between cases
        self.plain = all(x in self.tokenizer.to_str(pretty=False)[:2000] for x in ('"Lowercase"', '"Removed"'))
        self.size, self.limit = self.tokenizer.get_vocab_size(), limit
        #: of each id, whether it ends a pre-token (plain vocabularies) or the bytes it stands for
        self.extent = np.zeros(self.size, np.int64)
        for token, k in self.tokenizer.get_vocab().items():
            self.extent[k] = token.endswith("</w>") if self.plain else len(token)
        #: words whose ids are kept, and where these are in pool
        self.known, self.starts, self.lengths, self.pool = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        #: of each character seen in words, whether the library takes it for a letter and leaves it as it is
        self.letters: dict[str, bool] = {" ": not self.plain, "\n": True}

    def cut(self, text: str) -> str:
        """The text's pieces, with \\0 between them."""
        if self.plain and not UNLIKE.search(text):
            return text.lower().replace("\n", " ").replace(" ", "\0")
        odd = any(x in text for x in BESIDE) or any(x in text for x in WHITE)
        text = SAFE.sub("\0 ", text) if odd else text.replace(" ", "\0 ")
        return text if self.plain else LINES.sub("\0\n\0", text)

    def many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; distinct pieces of all texts are looked up or encoded once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        cut = [self.cut(t) if t and "\0" not in t else "" for t in texts]
        pieces = pc.split_pattern(pa.array(["\0".join(cut)], pa.large_string()), "\0").flatten().dictionary_encode()
        ids, upto = _gathered(*self._pieces(pieces.dictionary), pieces.indices.to_numpy())
        data, ends = ids.tobytes(), (upto[np.cumsum([c.count("\0") + 1 for c in cut]) - 1] * 4).tolist()
        return [self._whole([t])[0] if t and "\0" in t else data[a:z] for t, a, z in zip(texts, [0, *ends], ends)]

    def _pieces(self, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and ids of an Arrow array of pieces: letters and the signs after them are pre-tokens of their own, so words are looked up without signs."""
        import pyarrow as pa
        import pyarrow.compute as pc

        bare = pc.ascii_rtrim(pieces, characters=SIGNS)
        signs = pc.binary_length(pieces).to_numpy() - pc.binary_length(bare).to_numpy()
        ends, data = np.frombuffer(bare.buffers()[1], np.int64)[1 : len(bare) + 1], np.frombuffer(bare.buffers()[2] or b"", np.uint8)
        final = np.where(pc.binary_length(bare).to_numpy() > 0, data[ends - 1], 0) if len(data) else np.zeros(len(bare), np.uint8)
        apart = (signs > 0) & (final - 97 < 26) if self.plain else (signs > 0) & ((final | 32) - 97 < 26)
        for k in np.flatnonzero((signs > 0) & (final > 127)).tolist():
            apart[k] = self._fits(bare[k].as_py()[-1])
        at = np.flatnonzero(apart)
        after = [p[-n:] for p, n in zip(pieces.take(pa.array(at)).to_numpy(zero_copy_only=False).tolist(), signs[at].tolist())]
        both = pa.concat_arrays([pc.if_else(pa.array(apart), bare, pieces), pa.array(after, pa.large_string())]).dictionary_encode()
        starts, lengths, pool = self._words(both.dictionary)
        codes = both.indices.to_numpy()
        # each piece is a word and, at last, signs or nothing
        parts = np.full((len(pieces), 2), len(starts))
        parts[:, 0], parts[at, 1] = codes[: len(pieces)], codes[len(pieces) :]
        ids, upto = _gathered(np.append(starts, 0), np.append(lengths, 0), pool, parts.reshape(-1))
        upto = upto[1::2]
        return np.append(0, upto[:-1]), np.diff(upto, prepend=0), ids

    def _words(self, words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, lengths and ids of an Arrow array of distinct words, which are kept if they are short."""
        import pyarrow as pa
        import pyarrow.compute as pc

        found = pc.fill_null(pc.index_in(words, self.known), -1).to_numpy()
        new = np.flatnonzero(found < 0)
        order, counts, ids = self._encoded(words.take(pa.array(new)).to_numpy(zero_copy_only=False).tolist())
        new, pool = new[order], np.concatenate([self.pool, ids])
        starts, lengths = (np.append(x, 0)[found] for x in (self.starts, self.lengths))
        starts[new], lengths[new] = len(self.pool) + np.cumsum(counts) - counts, counts
        short = pc.binary_length(words).to_numpy() <= 64
        if len(self.known) + len(new) > self.limit:
            kept = np.flatnonzero(short)[: self.limit]
            self.known, self.lengths = words.take(pa.array(kept)), lengths[kept]
            self.pool, upto = _gathered(starts, lengths, pool, kept)
            self.starts = upto - self.lengths
        elif len(new):
            kept = new[short[new]]
            self.known, self.pool = pa.concat_arrays([self.known, words.take(pa.array(kept))]), pool if len(kept) == len(new) else self.pool
            if len(kept) < len(new):
                more, upto = _gathered(starts, lengths, pool, kept)
                self.starts, self.pool = np.append(self.starts, len(self.pool) + upto - lengths[kept]), np.append(self.pool, more)
            else:
                self.starts = np.append(self.starts, starts[kept])
            self.lengths = np.append(self.lengths, lengths[kept])
        return starts, lengths, pool

    def _encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' places in an order of our own, and in it the numbers of ids and all ids."""
        kinds: tuple[list[int], ...] = ([], [], [])
        blank = "" if self.plain else " "
        for k, w in enumerate(words):
            kinds[0 if (w[1:] if w[:1] == blank else w).isalpha() else 1 if blank and w[:1] == " " and w[1:] and not w[1].isspace() and not w[-1].isspace() else 2].append(k)
        text = "\n".join([words[k] for k in kinds[0]])
        if not self._fits(text):
            fit = [self._fits(words[k]) for k in kinds[0]]
            kinds[2].extend(k for k, f in zip(kinds[0], fit) if not f)
            kinds[0][:] = [k for k, f in zip(kinds[0], fit) if f]
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for kind, encode in zip(kinds, (lambda x: self._joined(x, True), lambda x: self._joined(x, False), self._each)):
            for k in range(0, len(kind), JOINED * STRINGS):
                n, x = encode([words[j] for j in kind[k : k + JOINED * STRINGS]])
                counts.append(n)
                ids.append(x)
        return np.array([k for kind in kinds for k in kind], np.int64), np.concatenate(counts), np.concatenate(ids)

    def _fits(self, words: str) -> bool:
        """Whether the library takes all characters of these words for letters and leaves them as they are."""
        seen = set(words)
        for c in seen - self.letters.keys():
            among, rules = f"a{c}a", self.tokenizer
            same = rules.normalizer is None or rules.normalizer.normalize_str(among) == among
            self.letters[c] = same and [x for x, _ in rules.pre_tokenizer.pre_tokenize_str(among)] == [_bytes(among)]
        return all(map(self.letters.__getitem__, seen)) and unicodedata.is_normalized("NFC", words)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _each(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(pieces)
        return np.array([len(x) // 4 for x in found], np.int64), np.frombuffer(b"".join(found), np.uint32)

    def _joined(self, pieces: list[str], words: bool) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces in long strings, which the library does faster, and part the ids at the pieces' borders.

        Borders are where pre-tokens end (a word of letters is one) or where the bytes sum up; if they don't fit the
        pieces, each piece is encoded for itself. Words of letters go to the library's model without its search for words.
        """
        strings = [("\n" if words else "").join(pieces[k : k + JOINED]) for k in range(0, len(pieces), JOINED)]
        found = array("I")
        for e in (self.words.encode_batch_fast([*map(_bytes, strings)]) if words else self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)):
            found.extend(e.ids)
        ids = np.array(found, np.uint32)
        upto = np.cumsum(self.extent[ids]) if found else np.zeros(1, np.int64)
        want = np.arange(1, len(pieces) + 1) if self.plain else np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in pieces])
        last = np.searchsorted(upto, want)
        if upto[-1] != want[-1] or (upto[last] != want).any():
            return self._each(pieces)
        return np.diff(last, prepend=-1), ids


def _bytes(text: str) -> str:
    """The characters that stand for the text's bytes."""
    return codecs.charmap_decode(text.encode(), "strict", BYTES)[0]


def _gathered(starts: np.ndarray, lengths: np.ndarray, pool: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of pool that codes name, one after the other, and where each ends."""
    each = lengths[codes]
    upto = np.cumsum(each)
    at = np.repeat(starts[codes] - upto + each, each)
    at += np.arange(len(at))
    return pool[at], upto


_encoders: dict[str, CachedEncoder] = {}


def encoder(path: str) -> CachedEncoder:
    """One encoder for each vocabulary file and Python worker."""
    if path not in _encoders:
        _encoders[path] = CachedEncoder(path)
    return _encoders[path]


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
