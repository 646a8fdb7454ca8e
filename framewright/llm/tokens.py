"""Subword ids of whole texts with a public tokenizer file, several times faster than text by text.

Of the tokenizers used here, white space is dropped and no id spans it, so each distinct white-space separated word is
encoded once and its ids are copied to wherever it stands. A word of plain letters, with or without one mark behind,
needs neither normaliser nor pre-tokenizer: its lower-case letters go straight to the byte-pair model. What has been
encoded is kept in a table of fixed size, addressed by the word's hash. The ids equal those of encoding whole texts.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

from .common import split_words

#: Words that a worker remembers, at most; a new word takes the place of another of the same slot.
SLOTS = 1 << 20
#: Ids that it keeps for them before it starts anew.
KEPT_IDS = 6_000_000
CHUNK = 8192
#: Letters that no normal form changes and whose lower case is one character (ASCII and Latin-1), and marks that are a token of their own after letters.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]?)\Z")
_MARKS = ".,!?;:"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """How byte-level models write Latin-1 letters beyond ASCII: UTF-8 bytes as printable characters."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def coded_words(texts):
    """The distinct words of the texts as a pyarrow array, each word's place among them, and the texts' offsets among the words."""
    words, offsets = split_words(texts)
    coded = words.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets


def word_keys(unique):
    """The words of a pyarrow array with A-Z lower-cased, and their 64-bit hashes."""
    import numpy as np
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    lower = pc.ascii_lower(unique).to_pylist()
    return lower, np.fromiter(map(xxh64_intdigest, lower), np.uint64, len(lower))


#: Bytes of a word up to which words are hashed together.
SHORT = 64


def word_hashes(unique):
    """The words of a pyarrow array with A-Z lower-cased, as such an array, and a 64-bit hash of each: eight bytes of all words at once, longer words than SHORT one by one."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    from xxhash import xxh64_intdigest

    lower = pc.ascii_lower(unique).cast(pa.large_string())  # in this order: a slice that was cast is lower-cased wrongly
    _, offsets, data = lower.buffers()
    if not len(lower):
        return lower, np.zeros(0, np.uint64)
    offsets = np.frombuffer(offsets, np.int64)[lower.offset : lower.offset + len(lower) + 1]
    data = np.concatenate([np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    length = np.diff(offsets)
    h = _mixed(length.astype(np.uint64))
    kept = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    at = np.flatnonzero((length > 0) & (length <= SHORT))
    for done in range(0, SHORT, 8):
        own = data[(offsets[at] + done)[:, None] + np.arange(8)].view("<u8").ravel()
        h[at] = _mixed(h[at] ^ (own & kept[np.minimum(length[at] - done, 8)]))
        at = at[length[at] > done + 8]
        if not len(at):
            break
    for i in np.flatnonzero(length > SHORT).tolist():
        h[i] = xxh64_intdigest(lower[i].as_py())
    return lower, h


def _mixed(h):
    """A permutation of the 64-bit numbers."""
    import numpy as np

    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordTokenizer:
    """path: a file of the tokenizers library: byte-level byte-pair encoding with word ends, lower case, white space dropped."""

    def __init__(self, path: str):
        import numpy as np

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.bare = Tokenizer(self.whole.model)
        self.letters = _byte_letters()
        self.mark_ids, self.mark_lengths = self._encoded(list(_MARKS), False)
        self.key, self.start, self.length = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), np.full(SLOTS, -1, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encoded(self, words: list[str], plain: bool):
        """The ids of all words one after another, and how many each has."""
        import numpy as np

        ids, lengths = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for at in range(0, len(words), CHUNK):
            own = words[at : at + CHUNK]
            if plain:
                own = [w if w.isascii() else w.translate(self.letters) for w in own]
            found = (self.bare if plain else self.whole).encode(own, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(found.ids, np.uint32))
            lengths.append(np.bincount(np.array(found.word_ids, np.int64), minlength=len(own)))
        return np.concatenate(ids), np.concatenate(lengths)

    def _fresh(self, words: list[str]):
        """As _encoded, for words of any kind."""
        import numpy as np

        base, mark, plain, odd = [], [], {}, {}
        for w in words:
            if m := _PLAIN.match(w):
                w, tail = m.groups()
                base.append(plain.setdefault(w.lower(), len(plain)))
                mark.append(_MARKS.index(tail) if tail else -1)
            else:
                base.append(-1 - odd.setdefault(w, len(odd)))
                mark.append(-1)
        pieces = [self._encoded(list(plain), True), self._encoded(list(odd), False), (self.mark_ids, self.mark_lengths)]
        ids, lengths = (np.concatenate(x) for x in zip(*pieces))
        base, mark = np.array(base, np.int64), np.array(mark, np.int64)
        base = np.where(base >= 0, base, len(plain) - 1 - base)
        both = np.column_stack([base, np.where(mark >= 0, mark + len(plain) + len(odd), -1)]).ravel()
        flat, cuts = _copy(ids, np.cumsum(lengths) - lengths, lengths, both[both >= 0])
        cuts = cuts[np.concatenate([[0], np.cumsum(1 + (mark >= 0))])]
        return flat, np.diff(cuts)

    def _look_up(self, unique, lower, keys):
        """Where the ids of each word lie in self.ids, and how many there are. lower: a list or a pyarrow array."""
        import numpy as np
        import pyarrow.compute as pc
        from xxhash import xxh64_intdigest

        if len(self.ids) > KEPT_IDS:
            self.ids = self.ids[:0]
            self.length[:] = -1
        # special ids are in lower case, and a letter may join a mark behind it in one case only: such words stand as they are
        exact = pc.match_substring_regex(unique, r"<\||[^\x{0}-\x{2FF}]").to_numpy(zero_copy_only=False)
        as_is = {i: unique[i].as_py() for i in np.flatnonzero(exact).tolist()}
        if as_is:
            keys = keys.copy()
            for i, w in as_is.items():
                keys[i] = xxh64_intdigest(w, seed=1)
        slot = (keys & np.uint64(SLOTS - 1)).astype(np.int64)
        start, length = self.start[slot], self.length[slot]
        new = np.flatnonzero((self.key[slot] != keys) | (length < 0))
        if len(new):
            fresh = [lower[i] for i in new.tolist()] if isinstance(lower, list) else lower.take(new).to_pylist()
            if as_is:
                fresh = [as_is.get(i, w) for i, w in zip(new.tolist(), fresh)]
            flat, own = self._fresh(fresh)
            start[new] = len(self.ids) + np.cumsum(own) - own
            length[new] = own
            self.ids = np.concatenate([self.ids, flat])
            at = slot[new]
            self.key[at], self.start[at], self.length[at] = keys[new], start[new], length[new]
        return start, length

    def encode(self, texts, end: int | None = None, coded=None):
        """ids of all texts of a pyarrow array one after another, and each text's offsets among them; `end` closes each text if given. coded: what coded_words(texts) and word_keys or word_hashes of it gave, where the caller needs them too."""
        import numpy as np

        unique, code, offsets, lower, keys = coded or ((c := coded_words(texts)) + word_keys(c[0]))
        n = len(offsets) - 1
        if not len(unique):
            return np.full(n if end is not None else 0, end or 0, np.uint32), np.arange(n + 1) * (end is not None)
        start, length = self._look_up(unique, lower, keys)
        flat, upto = _copy(self.ids, start, length, code)
        cuts = upto[offsets]
        if end is None:
            return flat, cuts
        ends = cuts[1:] + np.arange(n)
        out = np.empty(len(flat) + n, np.uint32)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[inner], out[ends] = flat, end
        return out, cuts + np.arange(n + 1)


@lru_cache(1)
def shared_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer a process: workers live through many tasks."""
    return WordTokenizer(path)


def _copy(ids, starts, lengths, codes):
    """The ids of all codes one after another, and the offset of each code among them."""
    import numpy as np

    own = lengths[codes]
    upto = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
    place = np.repeat((starts[codes] - upto[:-1]).astype(np.int32), own)  # batches are far below 2^31 ids
    place += np.arange(upto[-1], dtype=np.int32)
    return ids[place], upto
