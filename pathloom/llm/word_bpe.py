"""Ids of a word-level tokenizer of the ``tokenizers`` library, each distinct word encoded once.

The tokenizer must drop white space and look at no more than one run of other
characters at a time; then a text can be cut at ASCII white space.  Words of
letters that normalise to their own lower case, with sentence marks behind
them, go to the merges directly; all others go through the whole tokenizer.
"""

from __future__ import annotations

import functools
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common

#: A run of letters that composition leaves alone and lower case maps one to one, and marks that stand apart from it.
SIMPLE = r"^(?P<run>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[.,;:!?]*)$"
RUN = re.compile("[a-zß-öø-ÿ]+")
#: Units that a worker remembers (about 150 bytes each); then it starts anew.
KNOWN_UNITS = 800_000


def byte_letters() -> dict[int, str]:
    """The letter of each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(kept))}


def check_safe(spec: dict) -> None:
    """Raises if texts of this tokenizer can't be cut at white space or its simple words can't go to the merges directly."""
    kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
    first, second = ((spec["pre_tokenizer"] or {}).get("pretokenizers", []) + [{}, {}])[:2]
    whole = all(not re.search(r"\s", t["content"]) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) for t in spec["added_tokens"])
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[\p{L}]+" in first["pattern"].get("Regex", "") and r"[^\s\p{L}\p{N}]+" in first["pattern"]["Regex"]
    level = second.get("type") == "ByteLevel" and not second["add_prefix_space"] and not second["use_regex"]
    if kinds != ["NFC", "Replace", "Lowercase"] or not (whole and drops and level) or spec["truncation"] or spec["padding"]:
        raise ValueError("texts of this tokenizer can't be cut at white space")


class Words:
    """Ids of the units of words, remembered within bounds: the run of letters in lower case and the marks behind it, or the word as it is."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        check_safe(json.loads(text))
        self.whole, self.letters = Tokenizer.from_str(text), byte_letters()
        self.merges = self.whole.model
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, units: list[str]) -> list[list[int]]:
        merge, letters = self.merges.tokenize, self.letters
        out = [[t.id for t in merge(u if u.isascii() else u.encode().decode("latin-1").translate(letters))] if RUN.fullmatch(u) else None for u in units]
        odd = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(odd, self.whole.encode_batch_fast([units[i] for i in odd], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def places(self, units: pa.DictionaryArray) -> np.ndarray:
        """Where the ids of each unit are, after encoding those that are new."""
        distinct = units.dictionary.to_pylist()
        fresh = [u for u in distinct if u not in self.place]
        if fresh:
            found = self.encode(fresh)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh)), strict=True))
            self.flat = np.concatenate([self.flat, np.fromiter(itertools.chain.from_iterable(found), np.uint32, int(sizes.sum()))])
            self.sizes = np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.place.__getitem__, distinct), np.int64, len(distinct))[units.indices.to_numpy(zero_copy_only=False)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all texts end to end, how many each text has)."""
        coded, rows = common.words(texts, lower=False)
        distinct = coded.dictionary.cast(pa.string())
        if len(self.place) > KNOWN_UNITS:
            self.clear()
        found = pc.extract_regex(distinct, SIMPLE)
        units = pc.if_else(found.is_valid(), pc.utf8_lower(pc.struct_field(found, 0)), distinct)
        marks = pc.if_else(found.is_valid(), pc.struct_field(found, 1), "")
        pairs = np.stack([self.places(units.dictionary_encode()), self.places(marks.dictionary_encode())], axis=1)
        which = pairs[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        sizes = self.sizes[which]
        ends = np.concatenate([[0], np.cumsum(sizes)])[::2]
        starts = np.cumsum(self.sizes) - self.sizes
        return self.flat[common.spans(starts[which], sizes)], ends[rows[1:]] - ends[rows[:-1]]


@functools.lru_cache(maxsize=1)
def loaded(text: str) -> Words:
    """One for each worker process: building a tokenizer takes longer than a small task."""
    return Words(text)
