"""Token ids of texts, as the tokenizer's own library gives them, with a bounded cache of words.

A word-level tokenizer (one whose pre-tokenizer drops white space and never joins across it) gives for a text the ids
of its words one after another, so words seen before need not be encoded again. Words of plain letters are
further cut into the pre-tokenizer's units, which repeat more often. All ids come from the library; any
other tokenizer, and any word with unusual characters, goes to it whole.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: The configuration of word-level tokenizers for which units may be cut here.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_NORMALIZERS = ["NFC", "Replace", "Lowercase"]

#: Printable ASCII and Latin letters that NFC leaves alone and that have a lower case of one character; then the units of
#: such words once in lower case, with the line ends that are set between words.
PLAIN = regex.compile("[\\n!-~À-ÖØ-öø-įı-ňŊ-ž]*")
UNIT = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-įı-ňŊ-ž]+|[0-9]|[!-/:-@\\[-`{-~]+")
SEPARATOR = b"\xff\xff\xff\xff"
#: Entries at which a cache is emptied, to be filled anew; common words are soon back.
MOST_WORDS, MOST_UNITS = 150_000, 150_000
LONGEST = 64  # characters of a word that is held


def version_of(path: str) -> str:
    """Digest of the tokenizer's file."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()


def is_word_level(path: str) -> bool:
    if not path.endswith(".json"):
        return False
    config = json.loads(Path(path).read_text())
    steps = (config.get("normalizer") or {}).get("normalizers", [])
    split = ((config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    return (
        [s["type"] for s in steps] == WORD_NORMALIZERS
        and split.get("type") == "Split" and split.get("behavior") == "Removed" and split.get("invert") is True
        and split.get("pattern") == {"Regex": WORD_PATTERN}
        and config["model"].get("end_of_word_suffix") == "</w>"
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<|") for t in config["added_tokens"])
    )


class Encoder:
    """Ids of texts as bytes: unsigned 32-bit integers, little-endian."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.words: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {"\n": SEPARATOR}
        self.by_word = is_word_level(path)
        if path.endswith(".model"):
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library = lambda texts: pieces.encode(texts, num_threads=1)
            return
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        model = Tokenizer.from_file(path)
        self.library = lambda texts: [e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)]
        if self.by_word:
            self.ends = np.zeros(model.get_vocab_size(), bool)
            self.ends[[i for t, i in model.get_vocab().items() if t.endswith("</w>")]] = True
            # plain units are normalised and cut already: the same model, held once, without those steps
            self.bare = Tokenizer(model.model)
            self.bare.normalizer = normalizers.Sequence([])
            self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(ids, "<u4").tobytes() for ids in self.library(texts)]

    def _learn_units(self, units: list[str]) -> None:
        for k in range(0, len(units), 256):
            some = units[k : k + 256]
            ids = np.asarray(self.bare.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = (np.flatnonzero(self.ends[ids]) * 4 + 4).tolist()
            if len(stops) != len(some):  # not met: every unit ends with a word end
                self.units.update(zip(some, self._library(some), strict=True))
                continue
            held = ids.tobytes()
            self.units.update(zip(some, [held[a:b] for a, b in zip([0, *stops], stops, strict=False)], strict=True))

    def _learn_words(self, words: list[str]) -> None:
        joined = "\n".join(words)
        if not PLAIN.fullmatch(joined) or "<|" in joined:
            match = PLAIN.fullmatch
            plain = [w for w in words if match(w) and "<|" not in w]
            other = list(set(words).difference(plain))
            self.words.update(zip(other, self._library(other), strict=True))
            words, joined = plain, "\n".join(plain)
        if not words:
            return
        cut = UNIT.findall(joined.lower())
        units = self.units
        self._learn_units([u for u in set(cut) if u not in units])
        held = b"".join([units[u] for u in cut])
        stops = (np.flatnonzero(np.frombuffer(held, "<u4") == 0xFFFFFFFF) * 4).tolist()
        self.words.update(zip(words, [held[a + 4 : b] for a, b in zip([-4, *stops], [*stops, len(held)], strict=True)], strict=True))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._library(texts)
        split = [t.replace("\n", " ").split(" ") for t in texts]
        known = self.words
        if missing := [w for w in set().union(*split) if w not in known]:
            self._learn_words(missing)
        out = [b"".join([known[w] for w in ws]) for ws in split]
        for w in [w for w in missing if len(w) > LONGEST]:
            del known[w]
        if len(known) > MOST_WORDS:
            known.clear()
        if len(self.units) > MOST_UNITS or any(len(w) > LONGEST for w in missing):
            self.units = {"\n": SEPARATOR}
        return out


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and tokenizer."""
    return Encoder(path)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", rows: int = 1024, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows and, but for single long texts, few bytes. At their end memory that is not used goes back to the system:
    workers stay for the tasks after, which may need it elsewhere on the machine."""
    for batch in batches:
        n = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(np.cumsum(n[at : at + rows]), size, "right"))
            yield batch.slice(at, max(1, fits))
            at += max(1, fits)
        del batch, n
    give_back()


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the usual C library
    if trim:
        trim(0)
