"""Fill-in-middle: cuts found by a Fenwick tree over the blocks of a text."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.llm.rows import column, unwrapped, wrapped

#: Control strings before the prefix, the suffix and the middle. A text that holds one stays plain.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
#: Hundredths of the texts that stay plain, and of the others those whose suffix comes first.
PLAIN_SHARE, SPM_SHARE = 50, 80
#: Bytes of a block.
BLOCK = 4096

_RESULT = "n long, form string, prefix_chars long, middle_chars long, output binary"


class Blocks:
    """A text's UTF-8 bytes in fixed blocks, with the units and code points that end in each.

    A unit is a word with the white space before it, or white space at the end of the text. The
    counts lie in two Fenwick trees, so a cut descends to its block in a logarithm of the blocks and looks at
    the bytes of that block only. White space is ASCII, hence all bytes of other characters belong to words.
    """

    def __init__(self, text: bytes, size: int = BLOCK) -> None:
        self._bytes, self._size = np.frombuffer(text, dtype=np.uint8), size
        starts = np.arange(0, len(text), size)
        count = lambda marks: np.add.reduceat(marks, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
        units, points = count(self._ends(0, len(text))), count(self._first_bytes(0, len(text)))
        self.units, self.points = int(units.sum()), int(points.sum())
        self._unit_tree, self._point_tree = _fenwick(units), _fenwick(points)

    def _ends(self, start: int, stop: int) -> np.ndarray:
        """Whether a unit ends with each byte."""
        here = self._bytes[start : stop + 1]
        white = (here == 0x20) | ((here >= 0x09) & (here <= 0x0D))
        if stop < len(self._bytes):
            return ~white[:-1] & white[1:]
        return np.append(~white[:-1] & white[1:], True) if len(here) else white

    def _first_bytes(self, start: int, stop: int) -> np.ndarray:
        """Whether a code point starts with each byte."""
        return (self._bytes[start:stop] & 0xC0) != 0x80

    def cut(self, units: int) -> tuple[int, int]:
        """Bytes and code points of the text's first ``units`` units."""
        if units == 0:
            return 0, 0
        block, before, points = 0, 0, 0
        step = 1 << (len(self._unit_tree) - 1).bit_length()
        while step:
            after = block + step
            if after < len(self._unit_tree) and before + self._unit_tree[after] < units:
                block = after
                before += self._unit_tree[after]
                points += self._point_tree[after]
            step >>= 1
        start = block * self._size
        stop = min(start + self._size, len(self._bytes))
        end = start + int(np.flatnonzero(self._ends(start, stop))[units - before - 1]) + 1
        return end, int(points) + int(self._first_bytes(start, end).sum())


def _fenwick(counts: np.ndarray) -> np.ndarray:
    """Entry k sums the last ``k & -k`` of the first k counts."""
    sums = np.concatenate(([0], np.cumsum(counts)))
    k = np.arange(len(sums))
    return sums - sums[k & (k - 1)] if len(counts) else sums


def draws(key: int | str | None, seed: int = SEED) -> list[int]:
    """Four numbers that depend on the seed and the document's key only; a NULL key has no digits."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def arranged(text: bytes, key: int | str | None, seed: int = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE) -> tuple:
    """Units, form, code points of prefix and middle, and output of one text."""
    blocks = Blocks(text)
    h1, h2, h3, h4 = draws(key, seed)
    if not text or any(x.encode() in text for x in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - plain_share:
        return blocks.units, "plain", None, None, text
    first, last = sorted((h1 % (blocks.units + 1), h2 % (blocks.units + 1)))
    (start, prefix_chars), (stop, chars) = blocks.cut(first), blocks.cut(last)
    prefix, middle, suffix = text[:start], text[start:stop], text[stop:]
    form = "spm" if h4 % 100 < spm_share else "psm"
    parts = ((SUFFIX, suffix), (PREFIX, prefix)) if form == "spm" else ((PREFIX, prefix), (SUFFIX, suffix))
    output = b"".join(mark.encode() + part for mark, part in (*parts, (MIDDLE, middle)))
    return blocks.units, form, prefix_chars, chars - prefix_chars, output


def fill_in_middle(
    docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, plain_share: int = PLAIN_SHARE, spm_share: int = SPM_SHARE
) -> DataFrame:
    """``docs`` with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and ``output`` (replaced if there are such).

    Two cuts between units, drawn from the key, part a text into prefix, middle and suffix. ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix, prefix, middle) or ``plain`` (the text as it is, and no lengths).
    A NULL text is empty; empty texts and texts with a control string are plain. Rows with equal keys are cut by equal
    numbers, a NULL key draws its own. Every row is arranged by itself, without a shuffle.
    """

    @F.pandas_udf(_RESULT)
    def arrange(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        found = [arranged(bytes(t), k, seed, plain_share, spm_share) for k, t in zip(keys, texts, strict=True)]
        table = pd.DataFrame(found, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        return table.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = wrapped(docs, key=key, text=text)
    whole = F.coalesce("text", F.lit("")).cast("binary")
    made = rows.withColumn("made", arrange(F.col("key").cast("string"), whole))
    added = [F.col(f"made.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars")]
    names = {"n", "form", "prefix_chars", "middle_chars", "output"}
    return unwrapped(made, [c for c in docs.columns if c not in names], *added, F.col("made.output").cast("string").alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of :func:`fill_in_middle` was made from."""
    rest = F.substring(output, F.lit(len(PREFIX) + 1), F.char_length(output))
    front, middle = F.substring_index(rest, MIDDLE, 1), F.substring_index(rest, MIDDLE, -1)
    first, second = (lambda mark: F.substring_index(front, mark, 1)), (lambda mark: F.substring_index(front, mark, -1))
    return (
        F.when(form == "psm", F.concat(first(SUFFIX), middle, second(SUFFIX)))
        .when(form == "spm", F.concat(second(PREFIX), middle, first(PREFIX)))
        .otherwise(output)
    )
