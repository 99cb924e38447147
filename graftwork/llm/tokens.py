"""Token counts and ids of whole texts, exactly as the tokenizer's own library gives them.

A byte-level BPE of the common kind first cuts a text by a pattern without look-behind. A place between two characters is a
*stable boundary* if every match that holds the first one ends there, whatever else the text has: then the ids of a text are
those of what lies before it and those of what lies behind it, one after the other. By the pattern's alternatives these are:

* a space followed by a non-space, seen from its left side (no match runs from a character into such a space);
* the end of a run of letters, of digits or of other marks, but for an apostrophe before a letter, which may begin a contraction.

What is a letter, digit or mark is told only for characters that were the same kind in Unicode 3.2 and are so now, so that no
version of a library sees it differently; places inside special strings are left out. Two things follow:

* Stretches whose characters are all below U+0250 and that hold no special string are encoded by ``tiktoken`` with the ranks
  of the same vocabulary, which is several times as fast; the rest goes through ``tokenizers`` itself. The ids are the same.
* Huge documents are encoded in overlapping windows with offsets. Neighbouring windows are spliced at a stable boundary in
  their overlap, if both give the same tokens from there to the overlap's last one. An overlap without such a place is widened
  before anything is encoded, and one whose windows disagree afterwards, so each stretch is encoded about once.

Other ``.json`` tokenizers and ``.model`` files have no boundary that is proven stable; their library
encodes those texts whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import column_of, slices, small_batches

#: Documents of more characters are encoded window by window.
WINDOW_CHARS = 16_384
OVERLAP_CHARS = 256

_stable = re.compile(r" (?=\S)")
#: Kinds of characters in the cutting pattern; UNSURE: of which a library's Unicode version may think otherwise.
UNSURE, BLANK, LETTER, DIGIT, MARK = range(5)


@lru_cache(1)
def _kinds() -> np.ndarray:
    """The kind of each character of the Basic Multilingual Plane."""

    def kind(c: str) -> int:
        old, new = unicodedata.ucd_3_2_0.category(c), unicodedata.category(c)
        if c in "\t\n\v\f\r ":
            return BLANK
        if old != new or new[0] in "CZ":
            return UNSURE
        return LETTER if new[0] == "L" else DIGIT if new[0] == "N" else MARK

    return np.array([kind(chr(i)) for i in range(0x10000)], np.uint8)


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE, or None if the file isn't one whose merges are in the order of their ids."""
    model, pre = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges", "byte_fallback"))
    special = spec.get("added_tokens") or []
    if not plain or odd or any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"]) for t in special):
        return None
    byte = _byte_of_char()
    names = {t["content"] for t in special}
    try:
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in names}
        merged = [ranks[bytes(byte[c] for c in ("".join(m) if isinstance(m, list) else m.replace(" ", "")))] for m in model["merges"]]
    except KeyError:
        return None
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)) or any(bytes([b]) not in ranks for b in range(256)):
        return None
    return ranks


#: Fixed value: the cutting pattern of byte-level BPE pre-tokenizers.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids of texts for one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._fast = None
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._whole = lambda text: model.encode(text, num_threads=1)
            return
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(path)
        slow.no_truncation()
        slow.no_padding()
        self._whole = lambda text: slow.encode(text, add_special_tokens=False).ids
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if ranks := _ranks(spec):
            import tiktoken

            self._fast = tiktoken.Encoding("units", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={})
            lengths = {i: len(b) for b, i in ranks.items()} | {t["id"]: len(t["content"].encode()) for t in spec.get("added_tokens") or []}
            self._bytes = np.zeros(max(lengths) + 1, np.int64)
            self._bytes[list(lengths)] = list(lengths.values())
            self._special = [t["content"] for t in spec.get("added_tokens") or []]
            self._odd = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, self._special)]))

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, as unsigned 32-bit numbers."""
        if self._fast is None:
            return np.array(self._whole(text), "<u4")
        if not self._odd.search(text):
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        parts = _stable.split(text)
        runs = groupby([parts[0], *(" " + x for x in parts[1:])], key=lambda x: bool(self._odd.search(x)))
        joined = [(odd, "".join(run)) for odd, run in runs]
        return np.concatenate([np.array(self._whole(x), "<u4") if odd else self._fast.encode_to_numpy(x, disallowed_special=()) for odd, x in joined]).astype("<u4")

    def count(self, text: str, window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> int:
        return len(self.ids(text)) if self._fast is None or len(text) <= window else self._spliced(text, window, overlap)

    def _offsets(self, text: str) -> np.ndarray:
        """Where the tokens of a window start, in bytes, and last where it ends."""
        return np.concatenate([[0], np.cumsum(self._bytes[self.ids(text)])])

    def boundaries(self, text: str, lo: int, hi: int) -> np.ndarray:
        """Stable boundaries p of a text with lo <= p < hi, 0 < p: text[:p] and text[p:] can be encoded apart."""
        lo = max(1, lo)
        if hi <= lo:
            return np.empty(0, np.int64)
        code = np.frombuffer(text[lo - 1 : hi + 1].encode("utf-32-le", "surrogatepass"), "<u4")
        kind = np.where(code < 0x10000, _kinds()[np.minimum(code, 0xFFFF)], UNSURE)
        left, right = kind[: hi - lo], kind[1 : hi - lo + 1]
        good = (left != right) & (left != UNSURE) & (left != BLANK) & (right != UNSURE) & ~((code[: hi - lo] == 39) & (right == LETTER))
        if len(code) > hi - lo + 1:
            after = kind[2:]
        else:
            after = np.append(kind[2:], np.uint8(UNSURE))
        good |= (code[1 : hi - lo + 1] == 32) & (after != UNSURE) & (after != BLANK)
        for special in self._special:
            at = text.find(special, max(0, lo - len(special)))
            while 0 <= at < hi:
                good[max(0, at + 1 - lo) : max(0, at + len(special) - lo)] = False
                at = text.find(special, at + 1)
        return np.flatnonzero(good) + lo

    def _spliced(self, text: str, window: int, overlap: int) -> int:
        window, overlap = max(2, window), max(2, overlap)
        total, start, skip, end = 0, 0, 0, min(max(2, window), len(text))
        at = None  # offsets of the window text[start:end]; its first skip tokens are counted already
        while end < len(text):
            begin, wide = max(start + 1, end - overlap), overlap
            places = self.boundaries(text, begin, end)
            while not len(places) and end < len(text):  # only what is new is looked at
                begin, end, wide = max(start + 1, end - 1), min(len(text), end + wide), 2 * wide
                places, at = self.boundaries(text, begin, end), None
            if end == len(text):
                break
            at = self._offsets(text[start:end]) if at is None else at
            stop = min(len(text), max(end + 1, begin + window))
            at2 = self._offsets(text[begin:stop])
            lead, size = len(text[start:begin].encode()), {begin: 0}
            for a, b in zip([begin, *places[:-1].tolist()], places.tolist(), strict=True):
                size[b] = size[a] + len(text[a:b].encode())
            inside = np.array([size[p] for p in places.tolist()], np.int64)
            left, right = np.searchsorted(at, inside + lead), np.searchsorted(at2, inside)
            same = np.array_equal(at[left], inside + lead) and np.array_equal(at2[right], inside) and np.array_equal(at[left[0] : left[-1] + 1] - lead, at2[right[0] : right[-1] + 1])
            mid = len(places) // 2
            if same and left[mid] >= skip and places[mid] > start:
                total += int(left[mid]) - skip
                start, end, at, skip = begin, stop, at2, int(right[mid])
            else:  # the windows disagree: a wider overlap, up to twice the window
                end, at = min(len(text), end + max(overlap, end - start)), None
        at = self._offsets(text[start:end]) if at is None else at
        return total + len(at) - 1 - skip


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def count_tokens(df: DataFrame, tokenizer: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Tokens of every whole text.

    Returns doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit), a row for each row of ``df``.
    A null text counts as empty: 0 bytes, 0 tokens. A null id stays null; repeated rows each give a row;
    other columns are ignored, whatever their names; an empty table gives an empty result. There is no
    shuffle: texts stay where they are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [x or b"" for x in column_of(batch, "text")]
                n = np.array([enc.count(x.decode(), window, overlap) for x in texts], np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = df.select(df[id_col].alias("doc_id")).schema[0].dataType.simpleString()
    return small_batches(df).select(df[id_col].alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
