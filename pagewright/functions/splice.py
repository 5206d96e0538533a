"""Putting blocks into Markdown: replacements found despite reflow, and image links at their visual places.

Plain Python over one page's text, free of Spark.
"""

from __future__ import annotations

import re
from bisect import bisect_right


def replace_spaced(md: str, needle: str, block: str) -> str | None:
    """The first place where the needle's words stand with any white space between them, exchanged; null if none."""
    parts = needle.split()
    if not parts:
        return None
    found = re.search(r"\s+".join(map(re.escape, parts)), md)
    return found and md[: found.start()] + block + md[found.end() :]


def splice(md: str, replacements: list[tuple[str, str]]) -> str:
    """Each needle's first occurrence exchanged for its block; blocks whose needle is not found follow at the end."""
    left = []
    for needle, block in replacements:
        needle = needle.strip()
        if needle and needle in md:
            md = md.replace(needle, block, 1)
        elif needle and (found := replace_spaced(md, needle, block)) is not None:
            md = found
        else:
            left.append(block)
    return md + "".join(f"\n\n{b}" for b in left)


def normalized(text: str) -> tuple[str, list[int], list[int]]:
    """White space runs as one space, none at the ends; and where each word begins there and in ``text``."""
    parts, here, there, at = [], [], [], 0
    for found in re.finditer(r"\S+", text):
        parts.append(found[0])
        here.append(at)
        there.append(found.start())
        at += len(found[0]) + 1
    return " ".join(parts), here, there


def alt_of(text: str, max_bytes: int = 120) -> str | None:
    """A caption as alternative text, cut at a word; null for what is no caption."""
    words = text.split()
    if len(words) < 2 or words[0].rstrip(".:").lower() not in ("figure", "fig", "table", "abb", "plate") or not re.search("[0-9A-Za-z]", words[1]):
        return None
    out = ""
    for w in words:
        if len(out.encode()) + len(w.encode()) + 1 > max_bytes:
            out += "…"
            break
        out = f"{out} {w}" if out else w
    return out.replace("[", "").replace("]", "")


def place_images(md: str, lines: list[tuple[float, float, str]], images: list[tuple[float, float, str]]) -> str:
    """Image links before the lines that follow them on the page.

    ``lines``: (top, bottom, text), ``images``: (top, bottom, link target), both top-down. An image goes before the
    first line that begins below it, after the line of the image before it; the line is looked for in the text from
    where the last one was found, whole, then by its first eight words, then by four. A caption near the image's lower
    edge becomes its alternative text. Images without a line stay out, for a gallery.
    """
    lines = sorted(lines, key=lambda line: line[0])
    plain, here, there = normalized(md)
    found, cursor, at = [], 0, 0
    for _, bottom, source in sorted(images, key=lambda i: i[0]):
        anchor = next((k for k in range(at, len(lines)) if lines[k][0] >= bottom - 0.5), None)
        if anchor is None:
            continue
        at = anchor + 1
        near = [(t - bottom if t >= bottom else bottom - b, alt) for t, b, text in lines[max(anchor - 4, 0) : anchor + 2] if (alt := alt_of(text)) is not None]
        alt = min(near, key=lambda n: n[0])[1] if near else ""
        words = lines[anchor][2].split()
        for needle in (" ".join(words), " ".join(words[:8]), " ".join(words[:4])):
            hit = plain.find(needle, cursor) if needle else -1
            if hit >= 0:
                word = bisect_right(here, hit) - 1
                start = md.rfind("\n", 0, there[word] + hit - here[word]) + 1
                found.append((start, f"\n\n![{alt}]({source})\n\n"))
                cursor = hit + len(needle)
                break
    for start, link in reversed(found):
        md = md[:start] + link + md[start:]
    return md
