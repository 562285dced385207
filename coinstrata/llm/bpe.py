"""BPE encoding and decoding with word ends, exact, by tree concatenation of long unsplit text.

The vocabulary file is a parameter and read where the work is done.  Text is cut into units in numpy: at ASCII white space,
and among ASCII and Latin-1 letters into letters, digits and marks, as the file's pattern does.  Distinct units are found by
64-bit hashes, encoded once and then looked up.  Units with apostrophes are split into pieces here, those of other scripts by
the file's own normalizer and pattern, between its special tokens.  Pieces of up to SHORT bytes are merged in numpy, all of a length at
once.  A longer piece, of any script, is a tree: its leaves are encoded together, then neighbours are joined level by level.
At a join a window that doubles is encoded anew until it agrees with both sides: a boundary of the window's tokens on the
left that is one of the left's, and one on the right, where the tokens that meet are the encoding of their bytes.  Agreement
is exact: a token sequence is the encoding of its bytes if and only if each pair of neighbours is the encoding of the pair's
bytes.  A piece of n bytes takes some n log n steps even where no two sides agree, as in a long run of one sign.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from coinstrata.llm._common import LOWER, SPACE, chunks, give_back, hashes_of, task, text_rows

#: Bytes of a piece that is merged at once, and of a leaf of a longer one.
SHORT = 24
LEAF = 64
#: Tokens on each side of the first window.
WINDOW = 4
#: Bytes of the units that a task keeps encoded, and what a unit takes beside its ids and its decoded text.
CACHE = 48 << 20
ENTRY = 180
#: Bytes of text that are cut into units at once.
PART = 1 << 19
#: Pairs of tokens whose agreement a task keeps.
PAIRS = 200_000

_SIMPLE = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+")  # no "<", which can begin a special token
_STUB = re.compile("(?!)")
# How the vocabulary's file splits text, for the characters of _SIMPLE in lower case.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_KIND = np.full(256, 4, dtype=np.uint8)  # white space, letter, digit, mark; 4: neither is sure without decoding
_KIND[[*range(0x21, 0x7F)]] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[SPACE] = 0
_KIND[[*b"'<"]] = 4
_NONE = np.iinfo(np.int64).max


def _byte_signs() -> list[str]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder of one vocabulary file.  Ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, decoded: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, model = path, spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        end = self.end
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added, self.special = added, re.compile("|".join(f"({re.escape(t)})" for t in sorted(added, key=len, reverse=True))) if added else _STUB
        signs = _byte_signs()
        self.tokens = {i: t for t, i in vocab.items()}
        self.inner = np.array([vocab[s] for s in signs], dtype=np.int64)
        self.last = np.array([vocab[s + end] for s in signs], dtype=np.int64)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed(list(enumerate(rules)))}
        keys = np.array([(a << 32) | b for a, b in self.rules], dtype=np.int64)
        order = np.argsort(keys)
        self.keys = np.append(keys[order], _NONE)
        values = np.array(list(self.rules.values()), dtype=np.int64).reshape(-1, 2)[order]
        self.ranks, self.merged = np.append(values[:, 0], _NONE), np.append(values[:, 1], 0)
        self.signs, self.byte = signs, {s: b for b, s in enumerate(signs)}
        self.to_signs = dict(enumerate(signs))
        self.ends = {i for t, i in vocab.items() if t.endswith(end) and t != end}
        self.open_model = None  # the vocabulary without word ends, read when a long piece comes
        self.agreed: dict[tuple[int, int], bool] = {}
        self.decoded, self.kept = decoded, 0
        self.ids: dict[int, bytes] = {}
        self.text: dict[int, bytes] = {}
        del spec, model, vocab, rules, keys, values, order
        give_back()

    def _merge(self, symbols: list[int]) -> list[int]:
        """The merges of a short run of symbols, lowest rank and leftmost first."""
        s = list(symbols)
        while len(s) > 1:
            rank, at = min((self.rules.get((s[i], s[i + 1]), (_NONE, 0))[0], i) for i in range(len(s) - 1))
            if rank == _NONE:
                break
            s[at : at + 2] = [self.rules[s[at], s[at + 1]][1]]
        return s

    def _merge_all(self, m: np.ndarray) -> list[bytes]:
        """_merge of every row of symbols; rows lose one column with each merge, so those at work stay equally long."""
        out: list[bytes] = [b""] * len(m)
        rows = np.arange(len(m))
        while len(rows):
            if m.shape[1] > 1:
                pairs = (m[:, :-1] << 32) | m[:, 1:]
                at = np.searchsorted(self.keys, pairs)
                ranks = np.where(self.keys[at] == pairs, self.ranks[at], _NONE)
                where = ranks.argmin(axis=1)
                line = np.arange(len(m))
                on = ranks[line, where] != _NONE
            else:
                on = np.zeros(len(m), dtype=bool)
            done, size = m[~on].astype("<u4").tobytes(), 4 * m.shape[1]
            for k, r in enumerate(rows[~on].tolist()):
                out[r] = done[k * size : k * size + size]
            if not on.any():
                break
            new = self.merged[at[line[on], where[on]]]
            rows, m, where = rows[on], m[on], where[on]
            columns = np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, columns + (columns > where[:, None]), axis=1)
            m[np.arange(len(m)), where] = new
        return out

    def _agree(self, a: int, b: int) -> bool:
        """Whether two tokens are the encoding of their bytes."""
        if (a, b) not in self.agreed:
            if len(self.agreed) >= PAIRS:
                self.agreed.clear()
            self.agreed[a, b] = self._merge(self._split(a) + self._split(b)) == [a, b]
        return self.agreed[a, b]

    def _spelled(self, token: int) -> str:
        """The signs of a token's bytes."""
        return self.tokens[token].removesuffix(self.end) if token in self.ends else self.tokens[token]

    def _split(self, token: int) -> list[int]:
        spelled = [self.byte[c] for c in self._spelled(token)]
        ids = self.inner[spelled].tolist()
        return [*ids[:-1], int(self.last[spelled[-1]])] if token in self.ends else ids

    def _encode_signs(self, signs: list[str], last: bool) -> list[list[int]]:
        """The tokens of stretches of a piece; last: the last stretch ends the piece."""
        if self.open_model is None:
            from tokenizers import Tokenizer

            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            spec |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}
            spec["model"]["end_of_word_suffix"] = None
            self.open_model = Tokenizer.from_str(json.dumps(spec))
            del spec
            give_back()  # the file as objects and as text, several times what the model keeps
        inner = signs[:-1] if last else signs
        out = [x.ids for x in self.open_model.encode_batch(inner, add_special_tokens=False)] if len(inner) > 1 else [[t.id for t in self.open_model.model.tokenize(x)] for x in inner]
        return [*out, [t.id for t in self.library.model.tokenize(signs[-1])]] if last else out

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring stretches of one piece, given the encoding of each."""
        if not left or not right or self._agree(left[-1], right[0]):
            return left + right
        k = WINDOW
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            old = left[a:] + right[:b]
            spelled = [self._spelled(t) for t in old]
            (new,) = self._encode_signs(["".join(spelled)], b == len(right) and right[-1] in self.ends)
            begins = np.cumsum([0, *map(len, spelled)])  # of the old tokens and, at the end, their sum
            starts = np.cumsum([0, *(len(self._spelled(t)) for t in new)])
            first = self._meet(begins[: len(left) - a], starts, lambda i, j: a + i == 0 or self._agree(old[i - 1] if i else left[a - 1], new[j]))
            ends, stops = begins[-1] - begins[len(left) - a + 1 :][::-1], starts[-1] - starts[::-1]
            last = self._meet(ends, stops, lambda i, j: (b == len(right) and i == 0) or self._agree(new[len(new) - j - 1], right[b - i]))
            if first and last:
                return left[: a + first[0]] + new[first[1] : len(new) - last[1]] + right[b - last[0] :]
            k *= 2

    @staticmethod
    def _meet(old: np.ndarray, new: np.ndarray, fits: Callable[[int, int], bool]) -> tuple[int, int] | None:
        """Which boundaries of old and new tokens, counted from a window's edge, are in one place where the tokens fit."""
        _, i, j = np.intersect1d(old, new[:-1], assume_unique=True, return_indices=True)
        return next(((x, y) for x, y in zip(i.tolist(), j.tolist()) if fits(x, y)), None)

    def long_piece(self, piece: bytes) -> bytes:
        """The encoding of a piece by tree concatenation."""
        signs = piece.decode("latin-1").translate(self.to_signs)
        level = self._encode_signs([signs[a : a + LEAF] for a in range(0, len(signs), LEAF)], True)
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return np.array(level[0], dtype="<u4").tobytes()

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The encoding of each piece."""
        out = [b""] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == n).tolist()
            if n > SHORT:
                for r in rows:
                    out[r] = self.long_piece(pieces[r])
                continue
            flat = np.frombuffer(b"".join([pieces[r] for r in rows]), dtype=np.uint8).reshape(len(rows), n)
            m = self.inner[flat]
            m[:, -1] = self.last[flat[:, -1]]
            for r, ids in zip(rows, self._merge_all(m)):
                out[r] = ids
        return out

    def _parts(self, w: str) -> list[bytes | int]:
        """The pieces of a chunk as bytes, and ids of special tokens between them, by the file's own rules."""
        out: list[bytes | int] = []
        for text in filter(None, self.special.split(w)):
            if text in self.added:
                out.append(self.added[text])
            else:
                normal = self.library.normalizer.normalize_str(text) if self.library.normalizer else text
                out += [bytes(map(self.byte.__getitem__, p)) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return out

    def learn(self, new: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of units; a plain one is a piece."""
        split: list[list[bytes | int] | None] = []
        for u, whole in zip(new, plain):
            if whole:
                split.append(None)
            elif _SIMPLE.fullmatch(w := u.decode("utf-8")):
                split.append([p.encode() for p in _PIECES.findall(w.lower())])
            else:
                split.append(self._parts(w))
        distinct = list({p for u, parts in zip(new, split) for p in ((u,) if parts is None else parts) if isinstance(p, bytes)})
        done = dict(zip(distinct, self.pieces(distinct)))
        return [done[u] if parts is None else b"".join([done[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in parts]) for u, parts in zip(new, split)]

    def decode(self, ids: list[int]) -> bytes:
        """Tokens with a space between them, as the library does for a vocabulary without a decoder."""
        return " ".join([self.tokens[i] if i in self.tokens else self.library.id_to_token(i) for i in ids]).encode()

    @staticmethod
    def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The units of texts: their bytes (lower-cased where plain), begins, ends, whether plain, hashes, and where each
        text's begin."""
        raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        kind, lower = _KIND[raw], LOWER[raw]
        lead = np.flatnonzero(raw == 0xC3)  # with a byte from 80 to BF, Latin-1 letters but for two signs
        lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = 1
        lower[lead + 1] += np.where(raw[lead + 1] < 0x9F, 0x20, 0).astype(np.uint8)
        solid = kind > 0
        edges = np.diff(solid.view(np.int8), prepend=np.int8(0))
        a, z = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        odd = np.flatnonzero(kind == 4)
        whole = np.searchsorted(odd, z) > np.searchsorted(odd, a)  # chunks that are units
        turn = np.zeros(len(raw) + 1, dtype=np.int8)
        turn[a[whole]] += 1
        turn[z[whole]] -= 1
        inside = np.cumsum(turn[:-1], dtype=np.int8).view(bool)
        first = np.empty(len(raw), dtype=bool)
        first[0] = True
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        first &= solid & ~inside
        first[a] = True
        begins = np.flatnonzero(first)
        ends = np.append(begins[1:], len(raw))
        stop = np.searchsorted(z, begins, side="right")
        ends = np.minimum(ends, z[np.minimum(stop, len(z) - 1)]) if len(z) else ends
        signs = np.where(inside, raw, lower)
        text_from = np.cumsum([0, *(len(x) + 1 for x in texts)])
        return signs, begins, ends, ~inside[begins], hashes_of(signs, begins, ends), np.searchsorted(begins, text_from)

    def encoded(self, texts: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Ids and, if asked for, decoded text of each text."""
        if self.kept > CACHE:
            self.ids.clear()
            self.text.clear()
            self.kept = 0
        signs, begins, ends, plain, hashes, doc_from = self.units(texts)
        distinct, place, which = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        ids = list(map(self.ids.get, keys))
        missing = [i for i, x in enumerate(ids) if x is None]
        on, flat = place[missing], signs.tobytes()
        new = self.learn([flat[a:z] for a, z in zip(begins[on].tolist(), ends[on].tolist())], plain[on].tolist())
        for i, x in zip(missing, new):
            ids[i] = self.ids[keys[i]] = x
        self.kept += ENTRY * len(new) + sum(map(len, new))
        if self.decoded:
            for i, x in zip(missing, new):
                self.text[keys[i]] = text = self.decode(np.frombuffer(x, "<u4").tolist()) + b" " if x else b""
                self.kept += 100 + len(text)
            said = list(map(self.text.__getitem__, keys))
        which, cuts = which.tolist(), doc_from.tolist()
        for a, z in zip(cuts[:-1], cuts[1:]):
            mine = which[a:z]
            yield b"".join([ids[i] for i in mine]), b"".join([said[i] for i in mine])[:-1] if self.decoded else b""


@contextmanager
def without_gc() -> Iterator[None]:
    """No search for cycles while units, many small objects without any, are kept; a worker that goes on to other tasks
    searches again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def map_encoded(docs: DataFrame, path: str, schema: pa.Schema, ddl: str, row: Callable, decoded: bool = False) -> DataFrame:
    """docs (doc_id, text) with row(doc_id, ids, decoded text) for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(path, decoded)
        with without_gc():
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                for a, z, texts in chunks(batch, size=PART):
                    rows = [row(i, *both) for i, both in zip(ids[a:z], bpe.encoded(texts))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return docs.mapInArrow(task(run), ddl)


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded for each row of docs.

    A null or empty text has no ids and decodes to an empty text; ids may repeat or be null; other columns are not read; no
    rows give no rows.  A text of any length and script takes some n log n steps, unsplit or not.
    Units of text are encoded once a task, so the cost of a repeated word is that of a lookup.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
    return map_encoded(text_rows(docs, id_col, text_col), path or default_path(), schema, "doc_id long, ids binary, decoded string", lambda i, ids, text: (i, ids, text.decode()), decoded=True)


def encode_digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As encode, with sums in place of ids and text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def row(i, ids, text):
        return i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest()

    return map_encoded(text_rows(docs, id_col, text_col), path or default_path(), _DIGEST, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, decoded=True)
