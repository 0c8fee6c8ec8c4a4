"""Token ids of whole texts by a public tokenizer, word by word.

A text is cut where the tokenizer's own pre-tokenizer always cuts, the library
encodes each distinct piece once, and a bounded table in the worker keeps the
result. Joined pieces equal the ids of the whole text (tests compare them).
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_KEPT = 600_000     # pieces that a worker keeps
MAX_PIECE = 48         # longer pieces are computed again each time
GROUP_CHARS = 1 << 20  # characters of text that are looked up together
JOINED = 128          # pieces that the library encodes as one text
COLUMN_KEPT = 400_000  # pieces that a worker keeps where columns are looked up, which needs memory of its own
COLUMN_BYTES = 1 << 21  # bytes of text that are looked up together in a column
FOLLOWING = 1024      # pieces that it encodes as one text without marks between them

_RUNS = re.compile(r"\s*\S+|\s+")
_ODD = re.compile(r"[^\S \n]")
_MARKS = ".,;:!?%&$#*|)]}"


def tokenizer_path(name: str) -> str:
    """A file of the public tokenizers; a path that exists is taken as it is."""
    if os.path.exists(name):
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


class Pieces:
    """Maps texts to the values of their pieces. ``compute`` gives the value of
    each of a list of pieces.

    ``spaced``: the pieces keep their white space. They are cut before each
    single space or line feed; runs of white space or other white space make
    the text fall back to cutting before each run, which is exact for
    byte-level pre-tokenizers. Otherwise white space is dropped by the
    tokenizer, and every space and line feed is a cut.

    ``folds``: the tokenizer lower-cases every text, letter by letter, so that
    pieces that differ in the case of ASCII letters have one value.
    """

    def __init__(self, compute: Callable[[list[str]], list], spaced: bool, folds: bool = False, following: Callable[[list[str]], list] | None = None):
        self.compute, self.spaced, self.folds = compute, spaced, folds
        self.following = following  # the same for inner pieces as they are kept, without the space before them
        self.inner: dict = {}
        self.literal: dict = {}
        self.marks: dict = {}

    def _learn(self, into: dict, keys: Iterable[str], made: Callable[[str], str] | None) -> None:
        """Put the values of new pieces into ``into``. Closing marks after a
        letter or digit are a pre-token of their own, so a piece is computed
        without them and joined with the (few) runs of marks. ``made`` gives a
        piece as it stands in the text; None: they are ``following``."""
        split = {}
        for k in keys:
            if k[-1] in _MARKS:
                base = k.rstrip(_MARKS)
                if base and base[-1].isalnum() and len(base[-1].lower()) == 1:
                    split[k] = base
        new = [k for k in {split.get(k, k) for k in keys} if k not in into]
        into.update(zip(new, self.following(new) if made is None else self.compute([made(k) for k in new])))
        if split:
            tails = {k[len(base):] for k, base in split.items()}
            fresh = [t for t in tails if t not in self.marks]
            self.marks.update(zip(fresh, self.compute(fresh)))
            into.update((k, into[base] + self.marks[k[len(base):]]) for k, base in split.items())

    def _values(self, texts: list[list[str]], need: set[str], into: dict, made: Callable[[str], str], whole: Callable) -> list:
        """``whole`` of the values of each text's pieces; ``need``: pieces that ``into`` lacks."""
        if need:
            self._learn(into, need, made)
        out = [whole(map(into.__getitem__, parts)) for parts in texts]
        self._forget(need, into)
        return out

    def _forget(self, need: Iterable[str], into: dict, kept: int | None = None) -> None:
        """Keep the tables bounded after ``need`` was learned."""
        for k in [k for k in need if len(k) > MAX_PIECE]:
            del into[k]
        kept = kept or MAX_KEPT
        for table in (into, self.marks):
            if len(table) > kept:  # the first half stays: what came early is what comes often
                for k in list(islice(table, kept // 2, None)):
                    del table[k]

    def group(self, texts: list[str], whole: Callable = list) -> list:
        """``whole`` of the piece values of each text, in order."""
        if not self.spaced:
            # ASCII letters are folded by this tokenizer anyhow; a special token's string must stay as it is
            folded = [t if "<|" in t else t.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass") for t in texts] if self.folds else texts
            parts = [[p for p in t.replace("\n", " ").split(" ") if p] for t in folded]
            return self._values(parts, set().union(*parts).difference(self.inner), self.inner, str, whole)
        first: list[list[str]] = []
        rest: list[list[str]] = []
        for text in texts:
            parts = text.replace("\n", " \n").split(" ")
            head = parts.pop(0)
            first.append([head] if head else [])
            rest.append(parts)
        new = set().union(*rest).difference(self.inner)
        odd = {p for p in new if p == "" or p == "\n" or _ODD.search(p)}
        if odd:
            for i, parts in enumerate(rest):
                if not odd.isdisjoint(parts):
                    first[i], rest[i] = _RUNS.findall(texts[i]), []
        heads = self._values(first, set().union(*first).difference(self.literal), self.literal, str, whole)
        tails = self._values(rest, new - odd, self.inner, _with_space, whole)
        return [a + b for a, b in zip(heads, tails)]

    def column(self, texts: pa.Array) -> list[bytes]:
        """``b"".join`` of the piece values of each text of a column; ``spaced``
        pieces with values of bytes only. As ``group``, but Arrow cuts the texts,
        numbers a batch's pieces and lays their values end to end, so that Python
        sees each distinct piece of the batch once."""
        if not len(texts):
            return []
        texts = texts.cast(pa.large_string()).fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        if ends[-1] > COLUMN_BYTES and len(texts) > 1:
            cuts = [0, *(np.flatnonzero(np.diff(ends // COLUMN_BYTES)) + 1).tolist(), len(texts)]
            return [x for lo, hi in zip(cuts, cuts[1:]) for x in self._column(texts.slice(lo, hi - lo))]
        return self._column(texts)

    def _column(self, texts: pa.Array) -> list[bytes]:
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        at = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        begins = at[:-1] - at[0]  # a text has at least one part
        ends = at[1:] - at[0]
        is_rest = np.ones(len(codes), bool)
        is_rest[begins] = False
        used = np.zeros(len(words), bool)
        used[codes[is_rest]] = True
        values = list(map(self.inner.get, words))
        new = [c for c, (v, rest) in enumerate(zip(values, used.tolist())) if v is None and rest]
        odd = [c for c in new if words[c] == "" or words[c] == "\n" or _ODD.search(words[c])]
        apart = np.zeros(len(texts), bool)
        if odd:
            is_odd = np.zeros(len(words), bool)
            is_odd[odd] = True
            apart = np.logical_or.reduceat(is_odd[codes] & is_rest, begins)
            held = set(odd)
            new = [c for c in new if c not in held]
        need = [words[c] for c in new]
        if need:
            self._learn(self.inner, need, None)
        for c, p in zip(new, need):
            values[c] = self.inner[p]
        heads = list(dict.fromkeys(codes[begins[~apart]].tolist()))
        named = [words[c] for c in heads]
        fresh = {p for p in named if p and p not in self.literal}
        self._learn(self.literal, fresh, str)
        place = np.zeros(len(words), np.int64)
        place[heads] = np.arange(len(words), len(words) + len(heads))
        values += [self.literal[p] if p else b"" for p in named]
        self._forget(need, self.inner, COLUMN_KEPT)
        self._forget(fresh, self.literal, COLUMN_KEPT)
        codes[begins] = place[codes[begins]]
        laid = pa.array(values, pa.large_binary()).take(pa.array(codes))
        bounds = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1, 8 * laid.offset)
        data = memoryview(laid.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(bounds[begins].tolist(), bounds[ends].tolist())]
        alone = np.flatnonzero(apart).tolist()
        runs = [_RUNS.findall(texts[i].as_py()) for i in alone]
        for i, got in zip(alone, self._values(runs, set().union(*runs).difference(self.literal), self.literal, str, b"".join)):
            out[i] = got
        return out

    def all(self, texts: Iterable[str | None], whole: Callable = list) -> Iterable:
        """``whole`` of the piece values of each of any number of texts, in bounded
        groups. It takes an iterator; what it gives of two runs of pieces adds up
        to that of both (``list``, ``sum``, ``b"".join``), so that values are
        touched once, where they are looked up."""
        held: list[str] = []
        size = 0
        for text in texts:
            held.append(text or "")
            size += len(held[-1])
            if size >= GROUP_CHARS:
                yield from self.group(held, whole)
                held, size = [], 0
        if held:
            yield from self.group(held, whole)


def _with_space(piece: str) -> str:
    """An inner piece as it stands in the text."""
    return piece if piece[0] == "\n" else " " + piece


def _lower_cases(tok) -> bool:
    """Whether the tokenizer's normalizer folds each ASCII letter."""
    return all(tok.normalizer.normalize_str(chr(c)) == chr(c + 32) for c in range(65, 91))


_encoders: dict[tuple[str, bool], Pieces] = {}


def encoder(path: str, spaced: bool) -> Pieces:
    """Pieces whose values are ids as little-endian unsigned 32-bit integers,
    by the tokenizers library; one for each worker."""
    if (path, spaced) not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)

        special = {t.content: i for i, t in tok.get_added_tokens_decoder().items()}
        mark, mark_id = next(iter(special.items()), (None, -1))

        def compute(pieces: list[str]) -> list[bytes]:
            """Many pieces go through the library as one text, with a special
            token between them; pieces that hold one go alone."""
            out: list[bytes | None] = [None] * len(pieces)
            every = "\n".join(pieces)
            plain = [] if mark is None else range(len(pieces)) if not any(m in every for m in special) else [i for i, p in enumerate(pieces) if not any(m in p for m in special)]
            groups = [plain[lo:lo + JOINED] for lo in range(0, len(plain), JOINED)]
            for lo in range(0, len(groups), 64):
                for group, got in zip(groups[lo:lo + 64], tok.encode_batch_fast([mark.join(pieces[i] for i in g) for g in groups[lo:lo + 64]], add_special_tokens=False)):
                    ids = np.array(got.ids, "<u4")
                    cuts = np.flatnonzero(ids == mark_id)
                    raw = ids.tobytes()
                    for i, a, b in zip(group, [0, *(4 * (cuts + 1)).tolist()], [*(4 * cuts).tolist(), len(raw)]):
                        out[i] = raw[a:b]
            alone = [i for i, x in enumerate(out) if x is None]
            for i, got in zip(alone, tok.encode_batch_fast([pieces[i] for i in alone], add_special_tokens=False)):
                out[i] = np.array(got.ids, "<u4").tobytes()
            return out

        width = np.zeros(tok.get_vocab_size(), np.int64)  # bytes of each id, if each letter of the vocabulary is a byte
        for t, i in tok.get_vocab().items() if spaced else ():
            width[i] = len(t)

        def following(pieces: list[str]) -> list[bytes]:
            """Inner pieces, which begin with their only white space, follow each
            other as in a text; the bytes of their ids tell where each one ends.
            Where that is not so, or a special token's string occurs, marks part them."""
            out: list[bytes] = []
            groups = [pieces[lo:lo + FOLLOWING] for lo in range(0, len(pieces), FOLLOWING)]
            for lo in range(0, len(groups), 8):
                joined = [(" " + " ".join(g)).replace(" \n", "\n") for g in groups[lo:lo + 8]]
                for group, text, got in zip(groups[lo:lo + 8], joined, tok.encode_batch_fast(joined, add_special_tokens=False)):
                    ids = np.array(got.ids, "<u4")
                    data = np.frombuffer(text.encode(), np.uint8)
                    ends = np.append(np.flatnonzero((data == 0x20) | (data == 0x0A))[1:], len(data))
                    reached = np.cumsum(width[ids])
                    last = np.searchsorted(reached, ends)
                    if len(ends) != len(group) or reached[-1] != len(data) or (reached[last] != ends).any() or any(m in text for m in special):
                        out += compute([_with_space(p) for p in group])
                        continue
                    raw = ids.tobytes()
                    cuts = (4 * (last + 1)).tolist()
                    out += [raw[a:b] for a, b in zip([0, *cuts], cuts)]
            return out
        _encoders[path, spaced] = Pieces(compute, spaced, tok.normalizer is not None and _lower_cases(tok), following if spaced else None)
    return _encoders[path, spaced]
