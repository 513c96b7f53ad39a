"""Byte-pair encoding by backtracking over longest matches, and decoding from an offset table.

``Vocabulary`` reads a BPE file of the tokenizers library with a byte alphabet and word ends. Every word is a string over the
byte alphabet whose last symbol is a word-end symbol. An Aho-Corasick automaton of all tokens gives the longest token from a place.
The word is walked with these: a token is accepted if it is compatible with the token before it, that is if merging their joined
text gives just these two; otherwise the next shorter token is tried, and if none is left the token before is given up. Places that
were given up are remembered, so no place is tried twice. The result is that of the merges in their order, and the time is linear in the word.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import lean, slices

#: Words, and what stands between white space, are remembered up to this length, up to this number each per worker.
_SHORT, _REMEMBERED = 48, 300_000
#: Pairs of tokens whose compatibility is remembered.
_PAIRS = 300_000
#: Bytes of text that are encoded at once.
SLICE = 4 << 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def word_end(symbol: str) -> str:
    """The symbol that stands for a byte at the end of a word."""
    return chr(0x1000 + ord(symbol))


class Vocabulary:
    """Tokens, merges and special tokens of a file; picklable and bounded by the vocabulary's size."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        ids = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in [*ids.items(), *self.special.items()]:
            self.tokens[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: (left token, right token) -> place of the merge in their order
        self.rank = {(ids[a], ids[b]): i for i, (a, b) in enumerate(merges)}
        #: token -> (place of the merge that makes it, left part, right part)
        self.split = {ids[a + b]: (i, ids[a], ids[b]) for i, (a, b) in reversed([*enumerate(merges)])}
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        #: spelling with word ends as single symbols -> token, for tokens that the merging of their own text gives
        self.spelled = {self._spell(t): i for t, i in ids.items() if t not in self.special and self._makes_itself(i)}

    @classmethod
    def of(cls, state: dict) -> Vocabulary:
        made = cls.__new__(cls)
        made.__dict__.update(state)
        return made

    def _spell(self, token: str) -> str:
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[:-len(self.end)]
            return body[:-1] + word_end(body[-1])
        return token

    def _makes_itself(self, token: int) -> bool:
        parts = self.split.get(token)
        return parts is None or (self._makes_itself(parts[1]) and self._makes_itself(parts[2])
                                 and self.stands(parts[1], parts[2], joined=True))

    def stands(self, left: int, right: int, joined: bool = False) -> bool:
        """Whether merging the joined text of two tokens gives just these two (or, if ``joined``, comes to these two before they merge).

        Their inner merges are undone, the latest first. If the two parts that touch at some point have a merge of their own that
        comes before the one undone last, it would have been made first, and the pair does not stand.
        """
        never = len(self.rank)
        undone, in_left = never, True
        while True:
            own = never if joined else self.rank.get((left, right), never)
            joined = False
            # Of equal merges the one further left comes first.
            if own < undone or (own == undone < never and not in_left):
                return False
            a, b = self.split.get(left), self.split.get(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                undone, left, in_left = a[0], a[2], True
            else:
                undone, right, in_left = b[0], b[1], False


class Encoder:
    """Encodes words and texts; one is made per worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self._letter = byte_alphabet()
        self._longest = ahocorasick.Automaton()
        for spelling, token in vocabulary.spelled.items():
            self._longest.add_word(spelling, token)
        self._longest.make_automaton()
        self._size = {token: len(spelling) for spelling, token in vocabulary.spelled.items()}
        self._most = max(self._size.values())
        self._spelling = {token: spelling for spelling, token in vocabulary.spelled.items()}
        self._fitting: dict[int, int] = {}
        self._shorter: dict[int, int | None] = {}
        self._words: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._split_words = regex.compile(vocabulary.pattern)
        # The same for lower-case ASCII.
        self._split_ascii = re.compile(vocabulary.pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"), re.ASCII)
        self._specials = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self._marks = "".join({token[0] for token in vocabulary.special})

    @classmethod
    def kept(cls, state: dict) -> Encoder:
        """The encoder of this worker. It stays with the worker's copy of a broadcast vocabulary, and so does what it remembers."""
        if "encoder" not in state:
            state["encoder"] = cls(Vocabulary.of(state))
        return state["encoder"]

    def fitting(self, left: int, token: int) -> int:
        """The pair-compatibility table, filled as pairs come up: the longest token that is compatible with ``left`` among ``token`` and those
        that it begins with; -1 if there is none."""
        found = self._fitting.get(left << 32 | token)
        if found is None:
            found = token
            while found is not None and not self.v.stands(left, found):
                found = self._next_shorter(found)
            found = -1 if found is None else found
            if len(self._fitting) < _PAIRS:
                self._fitting[left << 32 | token] = found
        return found

    def _next_shorter(self, token: int, none: int | None = None) -> int | None:
        """The longest token that the given one begins with, itself excluded."""
        if token not in self._shorter:
            spelling = self._spelling[token]
            self._shorter[token] = next((self.v.spelled[spelling[:n]] for n in range(len(spelling) - 1, 0, -1)
                                         if spelling[:n] in self.v.spelled), None)
        found = self._shorter[token]
        return none if found is None else found

    def word(self, word: str) -> list[int]:
        """Token ids of one word of the pre-tokenizer."""
        spelled = word if word.isascii() and word.isprintable() else "".join([self._letter[b] for b in word.encode()])
        if self.v.end:
            spelled = spelled[:-1] + word_end(spelled[-1])
        # Longest matches from the left. As far as neighbours are compatible nothing is to be given up.
        out = [token for _, token in self._longest.iter_long(spelled)]
        known, last = self._fitting.get, out[0]
        for i in range(1, len(out)):
            token = out[i]
            fits = known(last << 32 | token)
            if fits != token and (fits is not None or self.fitting(last, token) != token):
                return self._backtrack(spelled, out[:i], token)
            last = token
        return out

    def _backtrack(self, spelled: str, out: list[int], token: int) -> list[int]:
        """Goes on behind the tokens ``out``, where ``token`` is the longest."""
        n, sizes, known, longest = len(spelled), self._size, self._fitting.get, self._longest.iter_long
        untried = [True] * (n + 1)
        at = sum([sizes[t] for t in out])
        while True:
            if out and token >= 0:
                fits = known(out[-1] << 32 | token)
                token = self.fitting(out[-1], token) if fits is None else fits
            if token < 0:
                untried[at] = False
                token = out.pop()
                at -= sizes[token]
                token = self._next_shorter(token, -1)
            elif untried[at + sizes[token]]:
                out.append(token)
                at += sizes[token]
                if at == n:
                    return out
                token = next(longest(spelled, at))[1]
            else:
                token = self._next_shorter(token, -1)

    def batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Token ids of each text; null counts as empty.

        No word, special token or composed character holds ASCII white space, so what stands between is encoded once a batch.
        """
        dictionary, index, bounds = _coded(texts)
        tokens = list(map(self.chunk, dictionary))
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) // 4
        flat = np.frombuffer(b"".join(tokens), np.int32)
        starts = np.cumsum(sizes) - sizes
        for s, e in zip(bounds[:-1], bounds[1:]):
            for_words = index[s:e]
            yield flat[_places(starts[for_words], sizes[for_words])]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Number of token ids of each text, as ``batch`` gives them, without listing them."""
        dictionary, index, bounds = _coded(texts)
        sizes = np.fromiter(map(len, map(self.chunk, dictionary)), np.int64, len(dictionary)) // 4
        upto = np.concatenate([[0], np.cumsum(sizes[index])])
        return upto[bounds[1:]] - upto[bounds[:-1]]

    def chunk(self, text: str) -> bytes:
        """Token ids, four bytes each, of a text without ASCII white space."""
        made = self._chunks.get(text)
        if made is None:
            made = self._encoded(text)
            if len(text) <= _SHORT and len(self._chunks) < _REMEMBERED:
                self._chunks[text] = made
        return made

    def _encoded(self, text: str) -> bytes:
        """Special tokens are found in the text as it stands; the rest is composed (NFC), lower-cased character by
        character, and split into words by the vocabulary's pattern, which drops white space."""
        ids: list[bytes] = []
        for piece in self._specials.split(text) if any(mark in text for mark in self._marks) else [text]:
            if piece in self.v.special:
                ids.append(array("i", [self.v.special[piece]]).tobytes())
                continue
            if piece.isascii():
                words = self._split_ascii.findall(piece.lower())
            else:
                piece = unicodedata.normalize("NFC", piece)
                # str.lower() looks at neighbours for the one letter that has a final form.
                piece = "".join([c.lower() for c in piece]) if "\u03a3" in piece else piece.lower()
                words = self._split_words.findall(piece)
            for word in words:
                found = self._words.get(word)
                if found is None:
                    found = array("i", self.word(word)).tobytes()
                    if len(word) <= _SHORT and len(self._words) < _REMEMBERED:
                        self._words[word] = found
                ids.append(found)
        return b"".join(ids)


def _coded(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """What stands between ASCII white space in a batch, each different one once; its places in order, and the bounds of each text's."""
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = words.flatten().dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), words.offsets.to_numpy() - words.offsets[0].as_py()


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0] .. starts[0] + sizes[0] - 1, starts[1] .. and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


class Decoder:
    """Joins the texts of tokens by blanks, as a file without a decoder asks for.

    All tokens lie in one buffer; a table has the offset of each. The bytes of a sequence are gathered at once.
    """

    def __init__(self, tokens: list[str], between: bytes = b" ") -> None:
        data = [t.encode() + between for t in tokens]
        self.offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])])
        self.buffer = np.frombuffer(b"".join(data), np.uint8)
        self._cut = len(between)

    def __call__(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        starts = self.offsets[ids]
        at = _places(starts, self.offsets[ids + 1] - starts)
        return self.buffer[at[:len(at) - self._cut]].tobytes()


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """``key`` and ``ids`` array of every text of ``docs`` (``key`` long, text). Null and empty texts have no ids; repeated rows
    are encoded each; an empty table gives an empty one; other columns are ignored."""
    return _run(docs, vocabulary, key, False)


def token_counts(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """``key`` and ``n_tokens`` of every row of ``docs``: the number of ids that ``encode`` gives its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # bounded by the vocabulary

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.kept(shared.value)
        for batch in stream:
            for part in slices(batch, SLICE):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.counts(part.column(1)), pa.int64())], names=[key, "n_tokens"])
    return docs.select(key, "text").mapInArrow(lean(run), f"{key} long, n_tokens long")


def decode(encoded: DataFrame, vocabulary: Vocabulary, key: str = "doc_id") -> DataFrame:
    """``key`` and ``text`` of every sequence (``key`` long, ids array of int); null counts as empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(shared.value)
        for batch in stream:
            made = [decoder(np.array(ids or [], np.int64)).decode() for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=[key, "text"])
    return encoded.select(key, "ids").mapInArrow(run, f"{key} long, text string")


def round_trip_digest(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row: texts are encoded, and the ids decoded again."""
    return _run(docs, vocabulary, "doc_id", True)


def _run(docs: DataFrame, vocabulary: Vocabulary, key: str, digest: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # bounded by the vocabulary

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.kept(shared.value)
        decoder = Decoder(encoder.v.tokens)
        decimal = Decoder([str(i) for i in range(len(encoder.v.tokens))])
        for batch in (part for whole in stream for part in slices(whole, SLICE)):
            encoded = encoder.batch(batch.column(1))
            if not digest:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(encoded, pa.list_(pa.int32()))], names=[key, "ids"])
                continue
            n, a, b = [], [], []
            for ids in encoded:
                n.append(len(ids))
                a.append(hashlib.sha256(decimal(ids)).hexdigest())
                b.append(hashlib.sha256(decoder(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)],
                                             names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
    out = f"{key} long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"{key} long, ids array<int>"
    return docs.select(key, "text").mapInArrow(run, out)
