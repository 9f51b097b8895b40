"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

A document's segments (the whole text, its paragraphs, its lines, its runs of lines that read like a licence) are normalised
to words; each has a set of word bigrams. A run goes on until a line of two words and more of whose bigrams less than half are
any template's, so a licence of many paragraphs, and a notice in a paragraph with other text, is one segment.
A template is compared only if the two sizes allow the threshold at all: with a and b bigrams, the coefficient is at most
2 * min(a, b) / (a + b). The same bound says how many of a segment's bigrams must be some template's at least, so that one
numpy pass over all bigrams of many texts finds the few segments to compare. Nothing is shuffled.
"""

from __future__ import annotations

import re
from math import ceil, floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._license_texts import TEMPLATES
from ._scratch import small_batches
from ._words import _table, grams, tidy, words

_ALNUM = _table((0x30, 0x39), (0x61, 0x7A))
_NOTICE = re.compile(rb"copyright[ \t]*(?:\(c\)|\xc2\xa9|[0-9])")  # in lower case


def template_words(text: str) -> list[str]:
    """Lower-cased runs of ASCII letters and digits."""
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Sizes that a set can have to reach the threshold with one of n bigrams."""
    return ceil(threshold * n / (2 - threshold) - 1e-9), floor((2 - threshold) * n / threshold + 1e-9)


def _prepared(templates: dict[str, list[str]], threshold: float):
    """(name, bigram hashes, smallest and largest size to compare with), all hashes, and the least number of common ones."""
    out = []
    for name, texts in sorted(templates.items()):
        for t in texts:
            (w,) = words(pa.array([" ".join(template_words(t))]), _ALNUM)
            b = np.unique(grams(w.h, 2))
            if len(b):
                out.append((name, b, *size_bounds(len(b), threshold)))
    if not out:
        return [], np.empty(0, np.uint64), 1
    return out, np.unique(np.concatenate([b for _, b, _, _ in out])), max(1, min(ceil(threshold * (low + len(b)) / 2 - 1e-9) for _, b, low, _ in out))


def _scan(prepared, threshold: float):
    templates, known, least = prepared

    def judge(b: np.ndarray):
        """(-dice, name) of the best template for a set of bigrams."""
        best = None
        for name, mine, low, high in templates:
            if low <= len(b) <= high:
                dice = 2 * len(np.intersect1d(b, mine, assume_unique=True)) / (len(b) + len(mine))
                if dice >= threshold and (best is None or (-dice, name) < best):
                    best = (-dice, name)
        return best

    def rows(batches):
        for batch in batches:
            ids = batch.column(0)
            for w in words(batch.column(1), _ALNUM, lower=True):
                best: list[list[tuple[float, str]]] = [[] for _ in range(w.hi - w.lo)]
                if len(w) > 1 and len(known):
                    _block(w, batch.column(1), best)
                top = [min(x, default=(0.0, None)) for x in best]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(w.lo, w.hi - w.lo), pa.array([x[1] for x in top], pa.string()), pa.array([-x[0] + 0.0 for x in top]), pa.array([",".join(sorted({n for _, n in x})) for x in best])],
                    names=["doc_id", "license", "dice", "licenses"],
                )

    def _block(w, col, best):
        first = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in col.slice(w.lo, w.hi - w.lo).to_pylist()])])[:-1]
        begins = np.unique(np.concatenate([first[first < len(w.buf)], np.flatnonzero(w.buf == 10) + 1]))  # of lines
        ends = np.append(begins[1:], len(w.buf))
        inked = np.concatenate([[0], np.cumsum(~np.isin(w.buf, [9, 10, 13, 32]))])
        blank = inked[ends] == inked[np.minimum(begins, len(w.buf))]
        blank[np.isin(begins, first)] = True  # a text begins a paragraph
        mark = np.frombuffer(b"copyright", np.uint8)
        notice = np.zeros(len(begins), bool)
        fit = np.flatnonzero(begins + len(mark) <= ends)
        fit = fit[(w.buf[begins[fit][:, None] + np.arange(len(mark))] == mark).all(axis=1)]
        notice[fit] = [_NOTICE.match(w.buf[a:b]) is not None for a, b in zip(begins[fit], ends[fit], strict=True)]
        line = np.searchsorted(begins, w.s, "right") - 1
        keep = ~notice[line]
        h, line, row = w.h[keep], line[keep], w.rows()[keep]
        g = grams(h, 2)
        hit = np.isin(g, known)
        one = (line[1:] == line[:-1]) & (row[1:] == row[:-1])
        pairs, hits = (np.bincount(line[:-1][x], minlength=len(begins)) for x in (one, one & hit[: len(one)]))
        other = 2 * hits < pairs  # a line of other text is a run of its own
        cut = other | np.isin(begins, first)
        cut[1:] |= other[:-1]
        for seg in (row, np.cumsum(blank)[line], line, np.cumsum(cut)[line]):
            inside = (seg[1:] == seg[:-1]) & (row[1:] == row[:-1])
            at = np.flatnonzero(hit & inside)
            if not len(at):
                continue
            found, count = np.unique(seg[:-1][at], return_counts=True)
            for s in found[count >= least]:
                a, b = np.searchsorted(seg, [s, s + 1])
                if (m := judge(np.unique(g[a : b - 1]))) is not None:
                    best[row[a]].append(m)

    return rows


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """For each row doc_id, license (of the best match; null if none reaches the threshold), dice (of that match, else 0)
    and licenses (the best template of each segment that matches one: distinct names, sorted, comma-joined).

    Words are runs of ASCII letters and digits, A-Z lower-cased; lines that begin with `copyright` and `(c)`, its sign or a digit are left out. Two licences
    one after the other are told apart by paragraphs and lines only, as they are one run. `templates` may hold longer texts,
    such as whole licences by name; they go to tasks as hashes, so keep them to some thousands of pages. Segments
    with fewer than two words match nothing. Equally good matches go by name. A null or empty text matches nothing. Rows
    are scanned each for itself, also with one id; a null id is kept; an empty table gives an empty result; other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(tidy(_scan(_prepared(templates, threshold), threshold)), "doc_id long, license string, dice double, licenses string")
