"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists every vocabulary piece that ends at each character; dynamic programming carries the best score and its number of pieces, nothing else, in a
window as long as the longest piece. Rules as in the public unigram tokenizers: sums in double precision; among candidates for one end the longest is tried first and
a later one must be strictly better; a character without a one-character piece may be unknown, at the least score less 10; an unknown character counts as its UTF-8 bytes where
the vocabulary has byte pieces, else a run of unknown characters counts as one piece.

Texts are cut where every segmentation must cut: before a blank mark that follows another character, if no piece holds a blank mark there. Short segments are remembered.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoweave.llm.common import packed, unpacked

BLANK = "▁"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6  # fixed values: piece types of the model file


def _fields(data: bytes):
    """(number, value) of the fields of one protocol-buffer message; values are integers or bytes."""
    at = 0

    def varint():
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at:at + size]
            at += size


def read_vocabulary(model: bytes) -> dict:
    """Pieces with scores and the flags of the normaliser of a SentencePiece model file. Models with a character map are refused: their normalisation is not done here."""
    import struct
    pieces, flags = [], {"prefix": True, "squeeze": True}
    for number, value in _fields(model):
        if number == 1:
            f = dict(_fields(value))
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 3:
            f = dict(_fields(value))
            if f.get(2):
                raise ValueError("the model has a character map")
            flags = {"prefix": bool(f.get(3, 1)), "squeeze": bool(f.get(4, 1))}
    scores = {p: s for p, s, kind in pieces if kind == NORMAL}
    return {"scores": scores, "bytes": sum(kind == BYTE for _, _, kind in pieces) == 256, "unknown": min(scores.values()) - UNKNOWN_PENALTY, **flags}


class Counts:
    """Piece counts of normalised strings under one vocabulary."""

    def __init__(self, vocabulary: dict, remember: int = 1 << 18, short: int = 48):
        self.v, self.short = vocabulary, short
        self.longest = max(map(len, vocabulary["scores"]))
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary["scores"].items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        inner = re.compile(f"[^{BLANK}]{BLANK}")
        self.cuts = not any(inner.search(p) for p in vocabulary["scores"])
        self.known = lru_cache(maxsize=remember)(self.viterbi)

    def viterbi(self, text: str) -> int:
        """Number of pieces of the best segmentation."""
        size, unknown, by_bytes = self.longest + 1, self.v["unknown"], self.v["bytes"]
        best, count, fused = [0.0] * size, [0] * size, [False] * size  # ring: of each end the best score, its pieces, whether it ends in an unknown run
        matches, n = self.automaton.iter(text), len(text)
        end, ended = next(matches, (n, None))
        for i in range(n):
            here, top, single = (i + 1) % size, None, False
            found = []
            while end == i:
                found.append(ended)
                end, ended = next(matches, (n, None))
            found.sort(reverse=True)
            for length, score in found:
                start = (i + 1 - length) % size
                single = single or length == 1
                total = best[start] + score
                if top is None or total > top:
                    top, pieces = total, count[start] + 1
                    loose = False
            if not single:
                start = i % size
                total = best[start] + unknown
                if top is None or total > top:
                    top, loose = total, True
                    pieces = count[start] + (len(text[i].encode("utf-8", "replace")) if by_bytes else 0 if fused[start] else 1)
            best[here], count[here], fused[here] = top, pieces, loose
        return count[n % size] if n else 0

    def normalised(self, text: str) -> str:
        if self.v["squeeze"]:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (BLANK if self.v["prefix"] else "") + text.replace(" ", BLANK)

    def count(self, text: str | None) -> int:
        text = self.normalised(text or "")
        if not self.cuts:
            return self.viterbi(text)
        total = 0
        for word, times in Counter(re.findall(f"{BLANK}*[^{BLANK}]+|{BLANK}+", text)).items():
            total += times * (self.known(word) if len(word) <= self.short else self.viterbi(word))
        return total


@lru_cache(maxsize=2)
def _counts(model: bytes) -> Counts:
    return Counts(read_vocabulary(model))


def model_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def with_token_counts(docs: DataFrame, model_path: str, name: str = "n_tokens") -> DataFrame:
    """The rows of `docs` with the number of tokens of `text`. Null and empty texts have 0; every other column stays as it is.

    The vocabulary is a file of fixed size, sent to every executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model_bytes(docs.sparkSession, model_path))

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        counter = _counts(shared.value)
        return pd.Series([counter.count(t) for t in texts], dtype="int64")

    return unpacked(packed(docs), docs.columns, **{name: count("text")})
