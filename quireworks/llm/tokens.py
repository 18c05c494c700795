"""Cached encoding: texts are cut where no token crosses, and each distinct piece goes through the tokenizer once.

The tokenizers library alone does about a megabyte a second here. Arrow cuts the texts of a portion and numbers their distinct
pieces, so Python touches distinct pieces only; the ids of a text are then gathered by array arithmetic. Both encoders keep a
table of pieces, bounded by bytes, as long as the worker lives, and give exactly the ids of
`Tokenizer.encode(text, add_special_tokens=False)`.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that a worker's table of pieces may take, about; it is emptied beyond that.
CACHE_BYTES = 64 << 20
#: What an entry takes besides its characters and ids.
ENTRY_BYTES = 200
#: Bytes of text that are cut at once.
PORTION_BYTES = 2 << 20
#: Words that go through the tokenizer as one text.
AT_ONCE = 512

# Letters that are their own composed form and have a one-letter lower case.
_LETTERS = "A-Za-zÀ-ÖØ-Þß-öø-ÿ"
# Signs that never belong to a letter run; an apostrophe may bind letters and an underline is left out to be safe.
_SIGNS = "!-&(-/:-@\\[-^`{-~"
_PARTS = f"^(?P<b> ?[{_LETTERS}]+)(?P<s>[{_SIGNS}]*)$"
_LOWER = re.compile("[a-zß-öø-ÿ]+")
_SPACED = re.compile(f" [{_LETTERS}]+")
#: Texts with runs of white space, white space other than space and line feed, the mark below or what may be a special token are left whole.
_UNEVEN = "  |\\n\\n| \\n|\\n |<\\||[\\x01\\t\\x0b-\\r\\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_MARK = "\x01"


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


_ENCODERS: dict = {}


def encoder(kind: type, path: str):
    """The worker's encoder for a tokenizer file; it lives as long as the worker, and only the last one is kept."""
    if (kind, path) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[kind, path] = kind(path)
    return _ENCODERS[kind, path]


def forget() -> None:
    """Drops the worker's encoder and its table."""
    _ENCODERS.clear()


def portions(texts: pa.Array, size: int = PORTION_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches (first, end) of an array of texts, of about `size` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + size, "right")))
        yield a, b
        a = b


def strings(values: pa.Array, between: str) -> list[str]:
    """Values, none of which holds `between`, as Python strings; one large string is faster to make than many small ones."""
    if not len(values):
        return []
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), between)
    return whole[0].as_py().split(between)


def as_array(texts: Iterable[str] | pa.Array) -> pa.Array:
    return texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.string())


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches `which` of flat (cut by sizes) one after another, and where each begins (and the last one ends)."""
    n = sizes[which]
    ends = np.concatenate([[0], np.cumsum(n)])
    first = (np.cumsum(sizes) - sizes)[which]
    return flat[np.repeat(first - ends[:-1], n) + np.arange(ends[-1])], ends


def word_parts(words: pa.Array, lower: bool) -> tuple[pa.DictionaryArray, pa.DictionaryArray]:
    """Words as (letters, in lower case on demand; the signs after them), and other words as (word, nothing)."""
    letters, end = pc.extract_regex(words, _PARTS).flatten()
    return pc.coalesce(pc.utf8_lower(letters) if lower else letters, words).dictionary_encode(), pc.fill_null(end, "").dictionary_encode()


def cut_words(texts: pa.Array) -> pa.ListArray:
    """Each text's words: runs without space and U+0009 to U+000D. Other white space stays inside and is the tokenizer's to drop."""
    return pc.ascii_split_whitespace(texts)


class Encoder:
    """The table of pieces and what turns cut texts into ids."""

    lower = False

    def __init__(self, path: str) -> None:
        self.tok = load(path)
        self.pieces = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.cache: dict[str, bytes] = {}
        self.size = 0  # of the table, in bytes

    def _encode_each(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u2").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _model_alone(self, before):
        """The tokenizer's model behind a plain split, for words that its normalizer leaves alone and its pattern leaves whole."""
        from tokenizers import Tokenizer, pre_tokenizers

        t = Tokenizer(self.tok.model)
        t.pre_tokenizer = pre_tokenizers.Sequence([before, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        return t

    def _plain(self, words: list[str], tok, between: str, opens: np.ndarray | None, ends: np.ndarray | None) -> None:
        """Words of letters, many in one text: the ids that open a word, or end one, tell them apart."""
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            ids = np.array(tok.encode_batch_fast([between.join(some)], add_special_tokens=False)[0].ids, "<u2")
            cuts = np.flatnonzero(opens[ids]) if ends is None else np.concatenate([[0], np.flatnonzero(ends[ids]) + 1])[:-1]
            if len(cuts) != len(some) or cuts[0]:
                self._put(some, self._encode_each(some))
                continue
            raw, at = ids.tobytes(), [*(cuts * 2).tolist(), 2 * len(ids)]
            self._put(some, [raw[a:b] for a, b in zip(at, at[1:])])

    def _put(self, pieces: list[str], ids: list[bytes]) -> None:
        self.cache.update(zip(pieces, ids))
        self.size += ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))

    def learn(self, pieces: list[str]) -> None:
        raise NotImplementedError

    def ids_of(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct pieces, one after another, and how many each has."""
        if self.size > CACHE_BYTES:
            self.cache, self.size = {}, 0
        found = list(map(self.cache.get, pieces))
        new = [p for p, x in zip(pieces, found) if x is None]
        if new:
            self.learn(new)
            found = list(map(self.cache.__getitem__, pieces))
        return np.frombuffer(b"".join(found), "<u2"), np.fromiter(map(len, found), np.int64, len(found)) // 2

    def ids_of_words(self, words: pa.Array, between: str) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct words: their letters and the signs at their end are looked up apart, for fewer are distinct."""
        base, tail = word_parts(words, self.lower)
        own, own_n = self.ids_of(strings(base.dictionary, between))
        signs, signs_n = self.ids_of(strings(tail.dictionary, between))
        which = np.column_stack([base.indices.to_numpy(), tail.indices.to_numpy() + len(own_n)]).ravel()
        n = np.concatenate([own_n, signs_n])
        ids, ends = gathered(np.concatenate([own, signs]), n, which)
        return ids, np.diff(ends[::2])

    def _gathered(self, cut: pa.ListArray, between: str) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the cut texts, and where each text's begin (and the last one's end)."""
        numbered = cut.flatten().dictionary_encode()
        ids, ends = gathered(*self.ids_of_words(numbered.dictionary, between), numbered.indices.to_numpy())
        offsets = cut.offsets.to_numpy()
        return ids, ends[offsets - offsets[0]]

    def encode(self, texts: Iterable[str] | pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 16-bit integers."""
        texts = as_array(texts)
        out: list[bytes] = []
        for a, b in portions(texts):
            out += self._encode(texts.slice(a, b - a))
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        raise NotImplementedError


class WordEncoder(Encoder):
    """For tokenizers that drop white space and mark word ends: no token crosses white space, so words are independent."""

    lower = True

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        super().__init__(path)
        self.ends = np.array([p.endswith("</w>") for p in self.pieces])
        self.words = self._model_alone(pre_tokenizers.WhitespaceSplit())

    def learn(self, pieces: list[str]) -> None:
        plain = list(filter(_LOWER.fullmatch, pieces))
        self._plain(plain, self.words, " ", None, self.ends)
        odd = list(set(pieces).difference(plain))
        self._put(odd, self._encode_each(odd))

    def _encode(self, texts: pa.Array) -> list[bytes]:
        ids, at = self._gathered(cut_words(texts), " ")
        raw, at = ids.tobytes(), (2 * at).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]


class ByteEncoder(Encoder):
    """For byte-level tokenizers whose pieces take one leading space: a text may be cut before a lone space and around a lone
    line break; of a piece, the signs at its end are encoded apart."""

    def __init__(self, path: str) -> None:
        from tokenizers import pre_tokenizers

        super().__init__(path)
        # Byte-level pieces show a space as U+0120.
        self.opens = np.array([p.startswith("Ġ") for p in self.pieces])
        self.words = self._model_alone(pre_tokenizers.Split(" ", "merged_with_next"))

    def learn(self, pieces: list[str]) -> None:
        spaced = list(filter(_SPACED.fullmatch, pieces))
        self._plain(spaced, self.words, "", self.opens, None)
        odd = list(set(pieces).difference(spaced))
        self._put(odd, self._encode_each(odd))

    def _encode(self, texts: pa.Array) -> list[bytes]:
        uneven = pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        even = texts.filter(pa.array(~uneven)) if uneven.any() else texts
        marked = pc.replace_substring(pc.replace_substring(even, " ", _MARK + " "), "\n", f"{_MARK}\n{_MARK}")
        ids, at = self._gathered(pc.split_pattern(marked, _MARK), _MARK)
        raw, at = ids.tobytes(), (2 * at).tolist()
        out = [raw[a:b] for a, b in zip(at, at[1:])]
        if uneven.any():
            whole = iter(self._encode_each(texts.filter(pa.array(uneven)).to_pylist()))
            rest = iter(out)
            out = [next(whole) if u else next(rest) for u in uneven.tolist()]
        return out


def in_portions(rows, size: int = 1 << 20):
    """Lists of rows (whose last value is a text) of about `size` characters each."""
    kept, n = [], 0
    for row in rows:
        kept.append(row)
        n += len(row[-1])
        if n >= size:
            yield kept
            kept, n = [], 0
    if kept:
        yield kept
