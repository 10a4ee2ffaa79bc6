"""Byte-level BPE encoding and decoding with tree concatenation.

A long text is halved until its parts are short; the parts are encoded as one batch, then
joined pairwise. At a join the last pieces of the left part and the first of the right part
are encoded again together, in windows that double until the result agrees with both sides:

* pieces (the splits before BPE): the window starts at a piece border that text further right
  can't move, and a border of the window's pieces must meet a border of the right part far
  enough from the window's end. Matching runs from left to right without looking back, so
  from there on both agree;
* tokens within one very long piece: the first and last token of the window must be those of
  the two sides. A token sequence is the BPE encoding exactly if each two neighbours are, and
  all neighbours then come from a valid encoding.

So the result is the encoding of the whole text, whatever the lengths of the parts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tesserine.llm import shared

#: Bytes of Latin-1 texts for which the pattern below is known to split as the tokenizers library does; other texts are split by the library.
_PLAIN = bytes([*range(0x1C), *range(0x20, 0x7F), *range(0xA0, 0x100)])
#: Fixed value: the split pattern of byte-level BPE.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same with the Latin-1 members of its classes spelled out, which Python's own matcher runs twice as fast.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \xa0"
_LATIN = re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
LEAF_CHARS = 2048
LEAF_PIECE = 512
CACHE = 100_000


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Tokens of the short pieces met so far; emptied when full."""

    def __init__(self, encoder: TreeEncoder) -> None:
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.piece_ids(piece))
        if len(piece) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids


class TreeEncoder:
    """Encoder for one tokenizer file of the byte-level BPE kind."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, leaf_piece: int = LEAF_PIECE) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf_chars, self.leaf_piece = max(8, leaf_chars), max(8, leaf_piece)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added_split = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        shown = self._alphabet()
        vocab = spec["model"]["vocab"]
        self.token_bytes: list[bytes] = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(shown[c] for c in token)
        for token, i in self.added.items():
            self.token_bytes[i] = token.encode()
        self.cache = _Cache(self)
        self.core = self._core(spec["model"]["merges"], vocab)

    @staticmethod
    def _alphabet() -> dict[str, int]:
        """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(printable)]
        return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}

    def _core(self, merges: list, vocab: dict[str, int]):
        """A merge loop without the library's wrapping, where ids follow the order of the merges; else None."""
        import tiktoken

        products = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if any(vocab[p] != 256 + i for i, p in enumerate(products)) or len(set(products)) != len(products):
            return None
        ranks = {self.token_bytes[i]: i for i in vocab.values()}
        return tiktoken.Encoding("tree", pat_str=_PATTERN.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe

    # pieces -----------------------------------------------------------------------------

    def split(self, text: str, plain: bool) -> list[str]:
        if plain:
            return _LATIN(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without added tokens."""
        try:
            plain = not text.encode("latin-1").translate(None, _PLAIN)
        except UnicodeEncodeError:
            plain = False
        if len(text) <= self.leaf_chars:
            return self.split(text, plain)
        cuts = self._cuts(len(text))
        parts = [self.split(text[a:b], plain) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        while len(parts) > 1:
            parts = [self._join_pieces(parts[i], parts[i + 1], plain) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _cuts(self, n: int) -> list[int]:
        depth = 0
        while n >> depth > self.leaf_chars:
            depth += 1
        return [n * i >> depth for i in range((1 << depth) + 1)]

    def _join_pieces(self, left: list[str], right: list[str], plain: bool) -> list[str]:
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            head, tail = len("".join(a)), len("".join(b))
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            if not whole_left and head < 8:
                width *= 2
                continue
            window = self.split("".join(a) + "".join(b), plain)
            if whole_right:
                return left[: len(left) - len(a)] + window
            borders, at = {}, head
            for i, piece in enumerate(b):
                borders[at] = i
                at += len(piece)
            at = 0
            for i, piece in enumerate(window):
                if at > head + tail - 8:
                    break
                if at in borders and i:
                    return left[: len(left) - len(a)] + window[:i] + right[borders[at] :]
                at += len(piece)
            width *= 2

    # tokens -----------------------------------------------------------------------------

    def _ids(self, piece: str) -> list[int]:
        return self.core.encode_single_piece(piece.encode()) if self.core else self.library.encode(piece, add_special_tokens=False).ids

    def piece_ids(self, piece: str) -> list[int]:
        """The tokens of one piece."""
        if len(piece) <= self.leaf_piece:
            return self._ids(piece)
        n, depth = len(piece), 0
        while n >> depth > self.leaf_piece:
            depth += 1
        cuts = [n * i >> depth for i in range((1 << depth) + 1)]
        leaves = [piece[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        if any(self.split(x, False) != [x] for x in leaves):
            return self._ids(piece)  # a part that would be split further has no tokens of its own
        parts = [self._ids(x) for x in leaves]
        while len(parts) > 1:
            parts = [self._join_tokens(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = left[-width:], right[:width]
            whole_left, whole_right = len(a) == len(left), len(b) == len(right)
            try:
                text = self.decode_bytes(a + b).decode()
            except UnicodeDecodeError:  # the window cuts a character
                text = ""
            if text and self.split(text, False) == [text]:
                window = self._ids(text)
                if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
                    return left[: len(left) - len(a)] + window + right[len(b) :]
            if whole_left and whole_right:
                return self._ids(self.decode_bytes(left + right).decode())
            width *= 2

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        cache = self.cache
        for part in self.added_split.split(text or "") if self.added_split else [text or ""]:
            if not part:
                continue
            if part in self.added:
                out.append(self.added[part])
                continue
            out.extend(chain.from_iterable(map(cache.__getitem__, self.pieces(part))))
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token_bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_ENCODERS: dict[str, TreeEncoder] = {}


def _encoder(path: str) -> TreeEncoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the executor's cores are Spark's to give
    if path not in _ENCODERS:
        _ENCODERS[path] = TreeEncoder(path)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """The other columns of ``docs`` with n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids.

    Null text is encoded as the empty text: no tokens. Strings of added tokens in a text become
    those tokens, as in the tokenizers library. Columns of the results' names are replaced. The
    tokenizer file must lie at ``path`` on every executor.
    """
    path = path or tokenizer_path()
    shared.bounded_batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))
    rest = [f for f in docs.schema.fields if f.name != "text"]

    def run(batches):
        encoder = _encoder(path)
        for batch in batches:
            counts, ids_hash, text_hash, all_ids = [], [], [], []
            for text in batch.column("text").to_pylist():
                ids = encoder.encode(text)
                raw = np.array(ids, "<u4")
                counts.append(len(ids))
                ids_hash.append(hashlib.sha256(raw.tobytes()).hexdigest())
                text_hash.append(hashlib.sha256(encoder.decode(ids).encode()).hexdigest())
                if with_ids:
                    all_ids.append(raw)
            columns = [batch.column(f.name) for f in rest] + [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = [f.name for f in rest] + ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                offsets = np.append(0, np.cumsum(counts)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*all_ids, np.zeros(0, "<u4")]).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * with_ids)
    return docs.mapInArrow(shared.trimmed(run), schema)
