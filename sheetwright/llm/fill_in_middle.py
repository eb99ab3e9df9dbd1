"""Fill-in-the-middle: whole texts cut at line ends into prefix, middle and suffix, and put in another order.

Where a text is cut is decided by hashes of its id, as numbers of units; a unit is a line with its
line feed, or a last line without one. Places are found on the UTF-8 bytes of a whole Arrow batch,
seen as 64-bit words: unit-ending bytes are marked arithmetically, a population count per word and
its running sum answer "how many ends are before this byte" and, searched, "in which word is the
k-th end"; within the word a multiplication makes the counts up to each of its bytes, and their
comparison gives the byte. A line feed is never part of another character in UTF-8, so a
cut never splits one. Only the text and two numbers go to Python, and three numbers come back.

Edge cases: null texts count as empty; empty texts, and texts that hold one of the three marks, stay
plain (a mark in a text would make the output ambiguous); a null doc_id is hashed as empty text;
rows with the same doc_id and number of units are cut alike; each row gives one row, and the
input's columns are kept in the struct ``doc``, so their names can't clash; an empty table gives none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: The byte 0x0A, 0x7F, 0x80 and 0x01 in each of the eight bytes of a word.
ENDS, LOW, HIGH, ONES = (np.uint64(int.from_bytes(bytes([b]) * 8)) for b in (0x0A, 0x7F, 0x80, 0x01))


class LineEnds:
    """Rank and select of line feeds in a buffer of bytes."""

    def __init__(self, data: np.ndarray):
        padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
        padded[: len(data)] = data
        x = padded.view("<u8") ^ ENDS
        self.marks = ~(((x & LOW) + LOW) | x | LOW)  # the high bit of each byte that is a line feed
        self.before = np.zeros(len(self.marks) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.marks), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of line feeds among the first ``at`` bytes."""
        below = (np.uint64(1) << ((at & 7) << 3).astype(np.uint64)) - np.uint64(1)
        return self.before[at >> 3] + np.bitwise_count(self.marks[at >> 3] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place behind the k-th line feed, k from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        nth = (k - self.before[word]).astype(np.uint64)
        counts = (self.marks[word] >> np.uint64(7)) * ONES  # byte i: ends in bytes 0 to i
        reached = ((counts | HIGH) - nth * ONES) & HIGH
        return word * 8 + 8 - np.bitwise_count(reached) + 1


def cuts(text: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text: its number of units n, and the bytes behind h1 % (n+1) and h2 % (n+1) units, in order."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    body = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(text) else np.zeros(0, np.uint8)
    start, stop = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    ends = LineEnds(body)
    ahead = ends.rank(start)
    closed = ends.rank(stop) - ahead
    n = closed + ((stop > start) & (ends.rank(np.maximum(stop - 1, start)) - ahead == closed))
    out = []
    for units in np.sort([h1 % (n + 1), h2 % (n + 1)], axis=0):
        inner = (units > 0) & (units < n)
        place = np.where(units == n, stop - start, 0)
        place[inner] = ends.select((ahead + units)[inner]) - start[inner]
        out.append(place)
    return n, *out


def _cuts(text: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
    found = cuts(text, h1.to_numpy(zero_copy_only=False), h2.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["n", "prefix", "middle"])


def restore(output: Column, form: Column) -> Column:
    """The text that an output of this form was made of."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)  # a mark comes first, so the first part is empty
    part = lambda i: F.get(parts, i)
    psm, spm = F.concat(part(1), part(3), part(2)), F.concat(part(2), part(3), part(1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """doc (the input row), n (units), form, prefix, middle, suffix (null where plain), output.

    rate: per cent of the texts to change; spm: per cent of these that put the suffix first.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), text_or_empty(F.col("doc_id"))), 256)
    group = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")
    places = F.arrow_udf(_cuts, "struct<n: long, prefix: long, middle: long>")
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"),
        text_or_empty(F.col("text")).alias("body"),
        *(group(i).alias(f"h{i + 1}") for i in range(4)),
    ).withColumn("cut", places("body", "h1", "h2"))
    body, marked = F.col("body"), [F.contains("body", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    plain = (body == "") | marked[0] | marked[1] | marked[2] | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm, "spm").otherwise("psm")
    data, first, second = body.cast("binary"), F.col("cut.prefix").cast("int"), F.col("cut.middle").cast("int")
    piece = lambda start, size: F.when(~plain, F.substring(data, start + 1, size).cast("string"))
    rows = rows.select(
        "doc", "body", F.col("cut.n").alias("n"), form.alias("form"),
        piece(F.lit(0), first).alias("prefix"), piece(first, second - first).alias("middle"), piece(second, F.length(data)).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm_ = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm_).otherwise(F.col("body"))
    return rows.select("doc", "n", "form", "prefix", "middle", "suffix", output.alias("output"))
