"""Byte-pair encoding of words with end marks, by longest matches and backtracking.

A word is a string over 512 base symbols: its bytes, the last one in its word-final form.
One Aho-Corasick pass finds the longest token at every place. The encoder takes longest
matches from left to right; a token is kept only if it is compatible with the one before it
(the merge rules, applied to both spelled out, would give these two tokens again). Otherwise
the next shorter prefix is tried, and when there is none the encoder steps back. Places it has
stepped back from are not tried again, so the work is linear in the length of the word.
Decoding looks up token texts in one byte string by an offset table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FINAL = "</w>"
CACHED_WORDS = 400_000  # words remembered by a worker; later ones are encoded each time


def byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in the vocabulary file: itself if visible, else 256 + its rank."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _ranges(marked: np.ndarray) -> str:
    """Body of a character class from one flag per code point."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


@functools.lru_cache
def unicode_classes(path: str) -> tuple[str, str]:
    """(class of letters on which Unicode versions differ, word pattern for texts that hold such letters).

    The pattern module, Python and the tokenizers library follow different Unicode versions;
    the library's classes are the ones that count.
    """
    import regex
    from tokenizers import Regex, normalizers, pre_tokenizers

    with open(path, encoding="utf-8") as file:
        pattern = _word_pattern(json.load(file))
    lower = normalizers.Lowercase().normalize_str
    splits = {name: (regex.compile(rf"\p{{{name}}}").findall,
                     pre_tokenizers.Split(Regex(rf"[\p{{{name}}}]"), "removed", invert=True).pre_tokenize_str)
              for name in ("L", "N")}
    newer = np.zeros(0x110000, bool)
    less = {name: newer.copy() for name in splits}
    more = {name: newer.copy() for name in splits}

    def mark(flags, letters):
        flags[[ord(a) for a in letters]] = True

    for base in range(0x80, 0x110000, 0x1000):  # in parts: this runs in the driver
        part = [chr(c) for c in range(base, min(base + 0x1000, 0x110000)) if not 0xD800 <= c < 0xE000]
        text = "".join(part)
        mark(newer, [a for a, b in zip(part, lower("\n".join(part)).split("\n")) if a.lower() != b])
        mark(newer, [a for a in part if unicodedata.category(a) == "Cn"])
        for name, (here, there) in splits.items():
            ours, theirs = set(here(text)), {a for a, _ in there(text)}
            mark(less[name], ours - theirs)
            mark(more[name], theirs - ours)
    for name in splits:
        newer |= less[name] | more[name]
        without, also = (f"[{_ranges(x)}]" if x.any() else "[^\\U00000000-\\U0010ffff]" for x in (less[name], more[name]))
        pattern = pattern.replace(rf"\p{{{name}}}", rf"[[\p{{{name}}}--{without}]||{also}]")
    return f"[{_ranges(newer)}]", pattern


def _word_pattern(spec: dict) -> str:
    return spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]


class WordBpe:
    """Tokenizer read from a vocabulary file of the ``tokenizers`` library.

    The file must hold a BPE model with word-final symbols whose token numbers rise in the
    order of the merges, behind NFC and lower-casing and a pattern that picks the words.
    """

    def __init__(self, path: str, classes: tuple[str, str] | None = None):
        import ahocorasick
        import regex
        from tokenizers import normalizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        if model["end_of_word_suffix"] != FINAL or spec["decoder"] is not None:
            raise ValueError("a vocabulary with word-final symbols and no decoder is needed")
        letters = byte_letters()

        def spelled(token: str) -> str:
            if token.endswith(FINAL) and token != FINAL:
                raw = [letters[c] for c in token[:-len(FINAL)]]
                return "".join(map(chr, raw[:-1])) + chr(256 + raw[-1])
            return "".join(chr(letters[c]) for c in token)

        size = max(max(vocab.values()), *(t["id"] for t in spec["added_tokens"])) + 1
        shown = [""] * size
        for token, number in vocab.items():
            shown[number] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, number in self.special.items():
            shown[number] = token
        # decoding: all token texts in one byte string, and where each begins
        encoded = [t.encode() for t in shown]
        self.texts = b"".join(encoded)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in encoded])])
        self._pieces = [self.texts[a:b] for a, b in zip(self.offsets[:-1], self.offsets[1:])]

        # a token with its two halves; a base symbol is its own half
        self.halves = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        last = -1
        for left, right in model["merges"]:
            number = vocab[left + right]
            if number <= last:
                raise ValueError("token numbers must rise in the order of the merges")
            last = number
            self.halves[number] = pair = vocab[left], vocab[right]
            self.merged[pair] = number

        strings = {spelled(token): number for token, number in vocab.items()}
        self.length = [0] * size
        self.automaton = ahocorasick.Automaton()
        for text, number in strings.items():
            self.length[number] = len(text)
            self.automaton.add_word(text, (len(text), number))
        self.automaton.make_automaton()
        # next shorter token that begins a token; -1 for none
        self.shorter = [-1] * size
        for text, number in strings.items():
            for end in range(len(text) - 1, 0, -1):
                if (found := strings.get(text[:end])) is not None:
                    self.shorter[number] = found
                    break
        self._fits: dict[tuple[int, int], bool] = {}
        newer, exact = classes or unicode_classes(path)
        self._words = regex.compile(_word_pattern(spec)).findall
        self._words_exact = regex.compile(exact, regex.V1).findall
        self._newer = regex.compile(newer).search
        self._normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self._specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._known: dict[str, bytes] = {}

    def fits(self, left: int, right: int) -> bool:
        """Pair-compatibility table: would merging leave ``left`` and ``right`` side by side?

        Undo the merges of the pair in reverse order. If at any moment the two symbols that
        face each other have a merge that comes before the ones still to be undone, the rules
        would have joined them across the border.
        """
        key = left, right
        known = self._fits.get(key)
        if known is not None:
            return known
        limit, answer = len(self.halves), None
        while answer is None:
            across = self.merged.get((left, right))
            if across is not None and across < limit:
                answer = False
                break
            for side in ((0, 1) if left > right else (1, 0)):
                if side == 0:
                    inner = self.halves[left][1]
                    if inner != left:
                        limit, left = left, inner
                        break
                else:
                    inner = self.halves[right][0]
                    if inner != right:
                        limit, right = right + 1, inner
                        break
            else:
                answer = True
        if len(self._fits) < 2_000_000:
            self._fits[key] = answer
        return answer

    def encode_word(self, data: bytes) -> list[int]:
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        longest = [-1] * len(text)
        for end, (length, number) in self.automaton.iter(text):
            longest[end - length + 1] = number  # ends rise, so the longest stays
        if self.length[longest[0]] == len(text):
            return [longest[0]]
        out: list[int] = []
        dead = bytearray(len(text) + 1)
        at, token = 0, longest[0]
        while at < len(text):
            end = at + self.length[token]
            if not dead[end] and (not out or self.fits(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < len(text) else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:  # nothing fits here: step back and go on with shorter prefixes there
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
        return out

    def _word(self, word: str) -> bytes:
        ids = np.array(self.encode_word(word.encode()), "<u4").tobytes()
        if len(self._known) < CACHED_WORDS:
            self._known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Token numbers of a text as little-endian 32-bit integers; null is the empty text."""
        out: list[bytes] = []
        parts = self._specials.split(text or "") if self._specials else [text or ""]
        known, word = self._known.get, self._word
        for part in parts:
            if part in self.special:
                out.append(np.array([self.special[part]], "<u4").tobytes())
                continue
            words = self._words
            if part.isascii():
                part = part.lower()
            elif not _latin(part) and self._newer(part):
                part, words = self._normal(part), self._words_exact
            else:  # each letter is lowered by itself: no final form of sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
            out += [known(w) or word(w) for w in words(part)]
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        """Token texts by the offset table, with a space between them, in UTF-8."""
        pieces = self._pieces
        return b" ".join([pieces[i] for i in np.frombuffer(ids, "<u4").tolist()])


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_LOADED: dict[str, WordBpe] = {}


def loaded(path: str, classes: tuple[str, str] | None = None) -> WordBpe:
    """Tokenizer of this worker."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path, classes)
    return _LOADED[path]


def tokenize(docs: DataFrame, path: str, *, tokens: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``tokens``, the ids and the decoded text.

    ``path``: vocabulary file on every executor. Whole texts; null and empty texts have no
    tokens and decode to the empty text. Rows are independent, so repeated ids, ties and extra
    columns change nothing; other columns are ignored. The digests are those of the ids as
    little-endian unsigned 32-bit integers and of the decoded text in UTF-8.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * tokens
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (
        ", ids binary, decoded string" if tokens else "")

    classes = unicode_classes(path)

    def run(batches):
        bpe = loaded(path, classes)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                columns: list[list] = [[] for _ in names[1:]]
                for text in part.column(1):
                    ids = bpe.encode(text.as_py())
                    decoded = bpe.decode(ids)
                    row = [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
                    for column, value in zip(columns, row + ([ids, decoded.decode()] if tokens else [])):
                        column.append(value)
                types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)
