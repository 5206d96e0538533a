"""Lines, gaps and owners of many pages' glyphs at once, on flat NumPy arrays; ``page`` numbers the page of each glyph.

Missing measures are NaN: such a glyph begins no line by itself and counts in no median.
"""

from __future__ import annotations

import numpy as np

#: Unicode white space; a glyph of it leaves a gap between words.
SPACES = frozenset([*map(chr, range(9, 14)), " ", "\x85", "\xa0", " ", *map(chr, range(0x2000, 0x200B)), " ", " ", " ", " ", "　"])
TIE, OWNS_NOTHING = 1e-6, 9


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Whether each place differs from the one before it in any of the sorted ``keys``."""
    out = np.ones(len(keys[0]), bool)
    if len(out):
        out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def ordered(*keys: np.ndarray) -> np.ndarray:
    """The order by ``keys``, of which the first counts most. Rows in order already, as text has them, are not sorted."""
    tied = np.ones(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        if (tied & ~(k[:-1] <= k[1:])).any():
            return np.lexsort(keys[::-1])
        tied &= k[:-1] == k[1:]
    return np.arange(len(keys[0]))


def tolerances(page: np.ndarray, width: np.ndarray, n_pages: int, least: float = 0.5) -> np.ndarray:
    """The upper median of each page's widths, ``least`` at least."""
    real = np.flatnonzero(~np.isnan(width))
    order = real[ordered(page[real], width[real])]
    counts = np.bincount(page[real], minlength=n_pages)
    starts = np.cumsum(counts) - counts
    out = np.full(n_pages, least)
    some = np.flatnonzero(counts)
    out[some] = np.maximum(width[order[starts[some] + counts[some] // 2]], least)
    return out


def cut_lines(page: np.ndarray, no: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, h: np.ndarray, n_pages: int) -> tuple[np.ndarray, np.ndarray]:
    """Glyphs in order of (page, centre height, left edge, number), and the line of each in that order.

    A line begins where the order leaves the band of its first glyph, and where the gap to the last glyph is a column
    gutter; a gutter does not move the band.
    """
    cy = y + h / 2
    order = ordered(page, cy, x, no)
    page_of, centre, left, wide = page[order], cy[order], x[order], w[order]
    tolerance = tolerances(page, w, n_pages)
    # only where the height changes can a band end
    at = np.flatnonzero(firsts(page_of, centre))
    begins, last, band = [], -1, 0.0
    for i, p, c, t in zip(at.tolist(), page_of[at].tolist(), centre[at].tolist(), tolerance[page_of[at]].tolist()):
        if p != last or abs(c - band) > t:
            begins.append(i)
            last, band = p, c
    new_band = np.zeros(len(order), bool)
    new_band[begins] = True
    gutter = np.zeros(len(order), bool)
    if len(order):
        gutter[1:] = left[1:] - (left[:-1] + wide[:-1]) > np.maximum(2 * wide[1:], 12.0)
    steps = np.cumsum(new_band | gutter)
    starts = np.flatnonzero(firsts(page_of))
    counts = np.diff(np.append(starts, len(order)))
    return order, (steps - np.repeat(steps[starts], counts)).astype(np.int32)


def gaps(new_line: np.ndarray, x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Whether each glyph stands further from the one before it in its line than a quarter of its width."""
    out = np.zeros(len(x), bool)
    if len(x):
        out[1:] = x[1:] - (x[:-1] + w[:-1]) > w[1:] * 0.25
    return out & ~new_line


def owners(page: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, regions: dict[str, np.ndarray], first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each glyph the place (in its page's regions) of the one that covers most of it, -1 for none.

    ``regions``: flat x0, y0, x1, y1, priority, claim_rank; those of page p are ``count[p]`` from ``first[p]`` on. Near
    equal areas go to the earlier claim, taken in order of regions.
    """
    best, area, rank = np.full(len(page), -1), np.zeros(len(page)), np.zeros(len(page), np.int64)
    for k in range(int(count.max(initial=0))):
        r = np.where(count > k, first + k, 0)
        owns = (count > k) & (regions["priority"][r] != OWNS_NOTHING)
        # an empty height for pages without such a region; widths only where heights meet
        top, bottom = np.where(owns, regions["y0"][r], np.inf)[page], np.where(owns, regions["y1"][r], -np.inf)[page]
        high = np.minimum(bottom, y1) - np.maximum(top, y0)
        of = np.flatnonzero(high > 0)
        r_of = r[page[of]]
        wide = np.minimum(regions["x1"][r_of], x1[of]) - np.maximum(regions["x0"][r_of], x0[of])
        meets = wide > 0
        of, a, claim = of[meets], (wide * high[of])[meets], regions["claim_rank"][r_of[meets]]
        held = area[of]
        takes = (best[of] < 0) | (a > held) | (np.abs(a - held) <= held * TIE) & (claim < rank[of])
        at = of[takes]
        best[at], area[at], rank[at] = k, a[takes], claim[takes]
    return best
