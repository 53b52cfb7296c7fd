"""Operator 9, token counts: overlap resynchronisation.

Counts the tokens that the tokenizer library gives for every whole text. Texts
of up to ``CHUNK`` characters are encoded as they are. Longer ones are encoded
as overlapping chunks with offsets; two neighbouring chunks are spliced at a
boundary that both encodings have inside their overlap and that is *proven
stable*: no token of any encoding of the whole text can cross it, and what
stands left of it does not change the tokens right of it, nor the other way
round. When the overlap holds no such boundary it is widened (doubled) and the
chunk encoded again, up to the rest of the text.

Stable boundaries for a byte-level BPE with the usual splitting pattern
(``'s|'t|...| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``; merges never
cross its matches): between a character that is no white space and one that
is (no alternative takes white space after other characters, and the pattern
looks ahead only inside white space), and between a letter and a digit. The
strings of special tokens hold neither, so the library cuts them out alike on
both sides.

The same boundaries let short texts be counted in pieces: a piece (white space
and the word after it) has the same tokens wherever it stands, so each worker
encodes a distinct piece once and remembers its count (in ``MEMO`` bytes,
of memory, of which the older half goes when full). Special strings count as the library's default
has it.

Nothing is shuffled; a text is one row of one task, and a task holds one Arrow
batch and one chunk's encoding at a time.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows
are counted each; an empty table gives an empty result; other columns of the
table are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ravenhunt.llm.common import Memo

CHUNK = 1 << 16
OVERLAP = 1 << 10
MEMO = 64 << 20
_LETTER_DIGIT = re.compile(r"(?<=[^\W\d_])(?=\d)|(?<=\d)(?=[^\W\d_])")
_PIECE = re.compile(r"\s*\S+|\s+")
_LOADED: dict = {}


def tokenizer(path: str):
    """The library's tokenizer of a file, loaded once per worker."""
    if path not in _LOADED:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        tok.no_padding()
        _LOADED[path] = tok
    return _LOADED[path]


def stable(text: str, p: int) -> bool:
    """Is ``p`` a proven stable boundary of ``text``?"""
    if not 0 < p < len(text):
        return False
    if not text[p - 1].isspace() and text[p].isspace():
        return _white(text[p])
    return _LETTER_DIGIT.match(text, p) is not None and text[p - 1].isascii() and text[p].isascii()


def _white(c: str) -> bool:
    """White space for the tokenizer too (Python also counts U+001C-U+001F)."""
    return not "\x1c" <= c <= "\x1f"


def spliced_count(text: str, tok, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text from overlapping chunks."""
    start, total = 0, 0
    while True:
        reach = overlap
        while True:
            end = min(len(text), start + chunk + reach)
            left = tok.encode(text[start:end], add_special_tokens=False).offsets
            if end == len(text):
                return total + len(left)
            # the next chunk begins `reach` before this one's end; splice where both have a stable boundary
            nxt = end - reach
            right = tok.encode(text[nxt:min(len(text), end + reach)], add_special_tokens=False).offsets
            ends = {start + b for _, b in left if nxt < start + b < end}
            begins = {nxt + a for a, _ in right}
            common = [p for p in ends & begins if stable(text, p)]
            if common:
                cut = min(common, key=lambda p: (abs(p - (nxt + end) // 2), p))
                total += sum(1 for _, b in left if start + b <= cut)
                start = cut
                break
            reach *= 2


def piece_counts(texts: list[str], tok, memo: Memo) -> list[int]:
    """Tokens of each text, from the counts of its pieces; unknown pieces are
    encoded in one call."""
    split = [_PIECE.findall(t) if _plain(t) else [t] for t in texts]
    known = {p: memo.get(p) for ps in split for p in ps}
    new = [p for p, n in known.items() if n is None]
    for i in range(0, len(new), 4096):
        part = new[i : i + 4096]
        for p, found in zip(part, tok.encode_batch_fast(part, add_special_tokens=False), strict=True):
            known[p] = n = len(found)
            memo.put(p, n, 2 * len(p))
    return [sum(map(known.__getitem__, ps)) for ps in split]


def _plain(text: str) -> bool:
    """Python and the tokenizer agree on the white space of this text."""
    return not any(c in text for c in "\x1c\x1d\x1e\x1f")


def token_counts(docs: DataFrame, path: str, limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        memo = _LOADED.get((path, "memo")) or _LOADED.setdefault((path, "memo"), Memo(MEMO))
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            counts = [0] * len(texts)
            short, held = [], 0
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    counts[i] = spliced_count(t, tok, chunk, overlap)
                else:
                    short.append(i)
                    held += len(t)
                if held > 1 << 20 or i == len(texts) - 1:
                    for j, n in zip(short, piece_counts([texts[j] for j in short], tok, memo), strict=True):
                        counts[j] = n
                    short, held = [], 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array(counts, pa.int64()), pa.array([n > limit for n in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
