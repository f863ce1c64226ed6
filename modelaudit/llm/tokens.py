"""Token ids of whole texts, by the tokenizers library: each distinct word of a run of texts is encoded once.

Encoding a text in one call costs about a second a megabyte. Both vocabularies here never join text across a single space
or line end (a space starts the next word, or is dropped), so texts are cut at those that stand between two visible characters.
A run of texts (``slices``) is cut, its pieces are dictionary-encoded, the library encodes their distinct words, and ids are
gathered by the pieces' numbers, all but the library's step by Arrow. Texts with runs of white space are cut at single spaces
only, and pieces that hold such runs, or anything else than plain letters, go to the library as they are. Words stay known in
a worker up to ``KNOWN_BYTES``; beyond that only those of the current run do. So a worker's memory is bounded by that and
the run (or the longest text, if that is longer). ``tests/llm`` compares with plain encoding.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

KNOWN_BYTES = 12 << 20
#: Every character that any library takes for white space counts, and marks without width.
SPACE = "\\s\\x00-\\x1f\u0085\u00a0\u1680\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff\u180e"
CUT = re.compile(f"(?<=[^{SPACE}]) (?=[^{SPACE}])")
RUN = f"[{SPACE}][{SPACE}]"
#: Letters on which all versions of Unicode agree, and which NFC leaves as they are.
LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
LETTERS = "".join(chr(i) for i in range(256) if re.match(f"[{LETTER}]", chr(i)))
POINTS = ".,;:!?"
MARK = r"!-&(-/:-@\[-`{-~"
#: Pieces whose words are known without the library: one space before a word at most, line ends between words only, no apostrophe.
SIMPLE = regex.compile(rf"(?: (?=[^\s]))?(?:[{LETTER}0-9{MARK}]|\n(?=[{LETTER}0-9{MARK}]))*")
WORDS = {
    "byte": regex.compile(rf" ?[{LETTER}]+| ?[0-9]+| ?[{MARK}]+|\n"),
    "word": regex.compile(rf"[{LETTER}]+|[0-9]|[{MARK}]+"),
}


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write for bytes: visible ones for themselves, others from 256 upwards."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in seen]
    return {b: chr(b) if b in seen else chr(256 + rest.index(b)) for b in range(256)}


def word_kind(path: str) -> str | None:
    """How the vocabulary's file cuts texts into words: one of ``WORDS``, or none that is known here."""
    with open(path) as file:
        top = json.load(file)
    ends, before, normal = top["model"].get("end_of_word_suffix"), top["pre_tokenizer"], top["normalizer"]
    if normal is None and not ends and before["type"] == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]:
        return "byte"
    parts = [x["type"] for x in (normal or {}).get("normalizers", [])]
    return "word" if ends == "</w>" and parts == ["NFC", "Replace", "Lowercase"] and before["type"] == "Sequence" else None


def id_arrays(rows: list[list[int]]) -> pa.LargeBinaryArray:
    """Lists of ids as little-endian unsigned 32-bit bytes."""
    data = np.fromiter(chain.from_iterable(rows), "<u4")
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64) * 4
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(data)])


class Encoder:
    """Encodes texts into little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.letters = word_kind(path), byte_letters()
        self.model = self.tokenizer.model
        self.known, self.known_ids = pa.array([], pa.string()), id_arrays([])

    def plain(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def word(self, word: str) -> list[int]:
        """Ids of one word, by the library's model alone: what cuts and normalises texts has nothing to do in it."""
        name = word.lower() if self.kind == "word" else word
        spelt = name if name.isascii() and name.isalnum() else name.encode().decode("latin-1").translate(self.letters)
        return [x.id for x in self.model.tokenize(spelt)] if spelt else []

    def words(self, words: pa.StringArray) -> pa.LargeBinaryArray:
        """Ids of distinct words."""
        at = pc.index_in(words, value_set=self.known)
        fresh = words.filter(at.is_null())
        table = pa.concat_arrays([self.known_ids, id_arrays([self.word(x) for x in fresh.to_pylist()])])
        is_fresh = at.is_null().to_numpy(zero_copy_only=False)
        out = table.take(pa.array(np.where(is_fresh, len(self.known) - 1 + np.cumsum(is_fresh), pc.fill_null(at, 0).to_numpy())))
        self.known, self.known_ids = pa.concat_arrays([self.known, fresh]), table
        if self.known.nbytes + table.nbytes > KNOWN_BYTES:
            self.known, self.known_ids = words, out
        return out

    def pieces(self, pieces: pa.StringArray, before: str) -> pa.LargeBinaryArray:
        """Ids of distinct pieces, each with ``before`` in front of it unless it begins with a line end."""
        # most pieces are a word of plain letters and at most some points after it
        ended = pc.starts_with(pieces, "\n")
        cores = pc.utf8_rtrim(pieces, POINTS)
        plain = pc.match_substring_regex(cores, f"^\n?[{LETTER}]+$")
        cores, points, led = pc.utf8_ltrim(cores.filter(plain), "\n"), pc.utf8_ltrim(pieces.filter(plain), LETTERS + "\n"), ended.filter(plain)
        if self.kind == "word":
            cores, led = pc.utf8_lower(cores), pc.and_(led, False)
        else:
            cores = pc.binary_join_element_wise(pc.if_else(led, "", before), cores, "")
        parts = [led.dictionary_encode(), cores.dictionary_encode(), points.dictionary_encode()]
        tables = [id_arrays([self.word("\n" if x else "") for x in parts[0].dictionary.to_pylist()]), self.words(parts[1].dictionary), id_arrays([self.word(x) for x in parts[2].dictionary.to_pylist()])]
        ids = pc.binary_join_element_wise(*[t.take(p.indices) for t, p in zip(tables, parts, strict=True)], pa.scalar(b"", pa.large_binary()))
        known: dict[str, list[int]] = {}

        def of(piece: str) -> list[int]:
            if "<|" in piece or not SIMPLE.fullmatch(piece):
                return self.plain(piece)
            out: list[int] = []
            for x in WORDS[self.kind].findall(piece):
                if x not in known:
                    known[x] = self.word(x)
                out += known[x]
            return out

        others = pc.binary_join_element_wise(pc.if_else(ended, "", before), pieces, "").filter(pc.invert(plain))
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(is_plain, np.cumsum(is_plain) - 1, len(ids) + np.cumsum(~is_plain) - 1)
        return pa.concat_arrays([ids, id_arrays([of(x) for x in others.to_pylist()])]).take(pa.array(place))

    def lists(self, lists: pa.ListArray) -> list[bytes]:
        """Ids of texts, each given as its pieces; in front of all but the first is a space, unless they begin with a line end."""
        starts, found = lists.offsets.to_numpy(), lists.flatten().dictionary_encode()
        table, at = self.pieces(found.dictionary, "" if self.kind == "word" else " "), found.indices.to_numpy().copy()
        if self.kind == "byte":
            firsts, place = np.unique(at[starts[:-1]], return_inverse=True)
            at[starts[:-1]] = len(table) + place
            table = pa.concat_arrays([table, self.pieces(found.dictionary.take(pa.array(firsts)), "")])
        joined = table.take(pa.array(at))
        ends, data = np.frombuffer(joined.buffers()[1], np.int64)[starts], memoryview(joined.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text; a null one has none."""
        column = pc.fill_null(texts.cast(pa.string()), "")
        if self.kind is None or not len(column):
            return [np.array(self.plain(x), "<u4").tobytes() for x in column.to_pylist()]
        runs = pc.match_substring_regex(column, RUN)
        has_runs = runs.to_numpy(zero_copy_only=False)
        single = self.lists(pc.split_pattern(pc.replace_substring(column.filter(pc.invert(runs)), "\n", " \n"), " "))
        if not has_runs.any():
            return single
        rest = self.lists(pa.array([CUT.split(x) for x in column.filter(runs).to_pylist()], pa.list_(pa.string())))
        one, other = iter(single), iter(rest)
        return [next(other if x else one) for x in has_runs]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary, a file or the name of one of ``public_tokenizers``; it holds no texts or words."""
    if os.path.sep not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Encoder(path)


def slices(texts: pa.StringArray, most: int = 1 << 22) -> Iterator[tuple[int, pa.StringArray]]:
    """Texts in runs of about ``most`` bytes, each with its first place, so that what one call holds is bounded."""
    size, first = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy()), 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + most)))
        yield first, texts.slice(first, last - first)
        first = last
