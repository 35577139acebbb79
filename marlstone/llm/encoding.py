"""Token ids through the ``tokenizers`` library, with a bounded cache of whole words in front of it."""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import begin, kept, release

#: Texts with two white-space characters side by side, or with the marker below, are encoded whole (byte-level words).
_DOUBLE_GAP = r"[\s\x0b\pZ\x{85}\x{1c}-\x{1f}]{2}|\x00"
#: Characters that the splitter and the tokenizer's pattern may not both count as white space, or the marker.
_ODD_SPACE = r"[\x{1c}-\x{1f}\x{180e}\x00]"
#: Marks a word without a space before it; twice, the end of a text.
_MARK = "\0"
#: Letters that are a word to both patterns and whole in Unicode's composed form.
_LATIN = r"[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]"
#: A word of them, and ASCII punctuation after it.
_PLAIN = re.compile(rf"(\0?{_LATIN}+)([!-/:-@\[-`{{-~]*)").fullmatch
#: Punctuation that is a word of its own, as one of them stands before it and a space after it.
_STOP = "(" + re.sub(r"\\x(..)", r"\\x{\1}", _LATIN) + ")([.,]) "


def _large(text: str) -> pa.Scalar:
    return pa.scalar(text, pa.large_string())


class WordCachedEncoder:
    """``encode_batch(..., add_special_tokens=False)`` of whole texts, word by word.

    Both vocabularies cut a text into words by a pattern before merging, and no word reaches over a white space that
    stands between two other characters, except that byte-level words carry the space before them. So a text's ids are
    the joined ids of its words, and most words come from the cache. Words of Latin letters, with or without punctuation
    after them, need neither the normaliser nor the pattern: their letters go to the merges at once, byte-level ones many
    in a call, and there a line's end and a stop or comma after such a word are words of their own. Texts whose white
    space is not of that simple kind, and texts that hold an added token such as ``<|endoftext|>``, go to the library
    whole. The cache holds two generations of ``capacity`` words: it never grows with the data.
    """

    def __init__(self, path: str, spaces_kept: bool, end_id: int, capacity: int = 500_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tok.get_added_tokens_decoder().values())
        self.whole = "|".join([_DOUBLE_GAP if spaces_kept else _ODD_SPACE, *(f"(?i:{re.escape(t)})" for t in added)])
        self.spaces_kept, self.capacity = spaces_kept, capacity
        self.merged = self.tok.model.tokenize
        own = [b for b in range(256) if chr(b).isprintable() and chr(b) != " "]  # the others move beyond 255, in order
        moved = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(own)))}
        self.bytes = {b: moved.get(b, b) for b in range(256)}
        if spaces_kept:
            vocab, space = self.tok.get_vocab(), chr(self.bytes[32])
            self.leads = np.zeros(max(vocab.values()) + 1, dtype=bool)  # ids that begin with a space
            self.leads[[i for t, i in vocab.items() if t.startswith(space)]] = True
        self.end = np.array([end_id], dtype="<u4")
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch(texts, add_special_tokens=False)]

    def _word_ids(self, words: list[str], together: int = 64) -> list[bytes]:
        """Ids of words without white space inside, many in a text: one call costs less than one for each word."""
        texts = [" " + " ".join(words[i : i + together]) for i in range(0, len(words), together)]
        out: list[bytes] = []
        for i, e in enumerate(self.tok.encode_batch(texts, add_special_tokens=False)):
            group = words[i * together : (i + 1) * together]
            ends = np.cumsum(np.fromiter(map(len, group), dtype=np.int64, count=len(group)) + 1)
            first = np.fromiter(map(itemgetter(0), e.offsets), dtype=np.int64, count=len(e))
            cut = (4 * np.searchsorted(first, ends)).tolist()
            blob = array("I", e.ids).tobytes()
            out += [blob[x:y] for x, y in zip([0, *cut], cut)]
        return out

    def _held(self, word: str) -> bytes | None:
        blob = self.words.get(word)
        return self.older.get(word) if blob is None else blob

    def _letters(self, stem: str) -> bytes:
        """Ids of a word of Latin letters, or of the mark and Latin letters."""
        stem = stem if self.spaces_kept else stem.lower()
        blob = self._held(stem)
        if blob is None:
            spelt = stem.strip(_MARK) if not self.spaces_kept or stem[0] == _MARK else " " + stem
            spelt = spelt.encode().decode("latin-1").translate(self.bytes)
            blob = array("I", [t.id for t in self.merged(spelt)]).tobytes()
            self.words[stem] = blob
        return blob

    def _learn_stems(self, stems: list[str], together: int = 32) -> None:
        """Words of Latin letters that carry the space before them, many in a call of the merges. Each must begin with an
        id that begins with a space: then no merge has reached over two words, and the ids are those of each alone."""
        ids = array("I")
        for i in range(0, len(stems), together):
            spelt = (" " + " ".join(stems[i : i + together])).encode().decode("latin-1").translate(self.bytes)
            ids.extend([t.id for t in self.merged(spelt)])
        first = np.flatnonzero(self.leads[np.array(ids, dtype=np.int64)])
        if len(first) != len(stems):
            for w in stems:
                self._letters(w)
            return
        blob, cut = ids.tobytes(), [*(4 * first).tolist(), 4 * len(ids)]
        self.words.update(zip(stems, [blob[x:y] for x, y in zip(cut, cut[1:])]))

    def _tail(self, tail: str) -> bytes:
        """Ids of punctuation that stands right after letters."""
        word = _MARK + tail if self.spaces_kept else tail
        blob = self._held(word)
        if blob is None:
            self.words[word] = blob = self._ids([tail])[0]
        return blob

    def _learn(self, new: list[str]) -> None:
        stems, parted, plain, odd = [], [], [], []
        for w in new:
            if self.spaces_kept and w.isascii() and w.isalpha():
                stems.append(w)
            elif parts := _PLAIN(w):
                parted.append(parts)
            elif w and w.isprintable():
                plain.append(w)
            else:
                odd.append(w)
        if stems:
            self._learn_stems(stems)
        for parts in parted:
            stem, tail = parts.groups()
            self.words[parts[0]] = self._letters(stem) + self._tail(tail) if tail else self._letters(stem)
        self.words.update(zip(plain, self._word_ids(plain)))
        bare = lambda w: not self.spaces_kept or w[:1] in ("\n", _MARK)
        self.words.update(zip(odd, self._ids([w.strip(_MARK) if bare(w) else " " + w for w in odd])))
        self.words[_MARK * 2] = self.end.tobytes()

    def _lookup(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words. Two generations: what is met again outlives the older one's end."""
        found = list(map(self.words.get, words))
        holes = [i for i, b in enumerate(found) if b is None]
        if holes:
            if len(self.words) > self.capacity:
                self.words, self.older = {}, self.words
            old = self.older.get
            new = []
            for i in holes:
                w = words[i]
                b = old(w)
                if b is None:
                    new.append(w)
                else:
                    self.words[w] = b
            if new:
                self._learn(new)
            get = self.words.__getitem__
            for i in holes:
                found[i] = get(words[i])
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each followed by the end id; end of each text). Words are split and made distinct by
        Arrow, so Python handles each distinct word of the batch once."""
        texts = texts.cast(pa.large_string()).fill_null("")
        odd = pc.match_substring_regex(texts, self.whole)
        some_odd = pc.any(odd).as_py()
        body = pc.if_else(odd, _large(""), texts) if some_odd else texts
        if self.spaces_kept:
            body = pc.replace_substring(body, "\n", f" \n {_MARK}")
            body = pc.replace_substring_regex(body, _STOP, rf"\1 {_MARK}\2 ")
            body = pc.binary_join_element_wise(_large(_MARK), body, _large(""))
            cut = pc.split_pattern(pc.binary_join_element_wise(body, _large(_MARK * 2), _large(" ")), " ")
        else:
            cut = pc.utf8_split_whitespace(pc.binary_join_element_wise(body, _large(_MARK * 2), _large(" ")))
        words = cut.flatten().dictionary_encode()
        blobs = self._lookup(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
        flat = pa.array(np.frombuffer(b"".join(blobs), dtype="<u4"))
        known = pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size)))), flat)
        spelt = known.take(words.indices)
        ids = spelt.flatten().to_numpy()
        ends = spelt.offsets.to_numpy()[cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()]
        if some_odd:
            parts = np.split(ids, ends[:-1])
            which = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
            for i, b in zip(which.tolist(), self._ids([texts[i].as_py() for i in which.tolist()])):
                parts[i] = np.concatenate((np.frombuffer(b, dtype="<u4"), self.end))
            ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        return ids, ends


@kept
@lru_cache(maxsize=1)
def encoder(path: str, spaces_kept: bool, end_id: int) -> WordCachedEncoder:
    """One encoder per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordCachedEncoder(path, spaces_kept, end_id)


def encoded_batches(batches, column: str, path: str, spaces_kept: bool, end_id: int, bytes_at_once: int = 4 << 20):
    """(slice of the Arrow batch, ids of all its texts in one uint32 array, end of each text in it) for small slices.

    Each text is followed by ``end_id``; null counts as empty.
    """
    begin(encoder)
    enc = encoder(path, spaces_kept, end_id)
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        held = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(held, (held[at - 1] if at else 0) + bytes_at_once, "right")))
            ids, ends = enc.encode(texts.slice(at, to - at))
            release()  # what encoding took on its way is more than its result
            yield batch.slice(at, to - at), ids, ends
            at = to
